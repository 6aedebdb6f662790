"""Language identification with spans: script ranges, per-word scores, Viterbi with a switching penalty.

A language model is a table of log-probabilities of hashed letter n-grams (one to four letters, with word ends).
The letters of a word name its script, and only languages written in it are candidates. The best path of
languages over the words of a text pays `penalty` for each change, so that a text in several languages falls
into spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
SMOOTH = 0.5
PENALTY = 12.0
TRAIN_ROWS = 4000        # expected number of training texts of each language
SCRIPT_SHARE = 0.01      # a language is written in a script that has this share of its letters
OUTSIDE = 1000.0         # what a word in another script costs a language
BLOCK = 1 << 16          # letters scored at once
CHUNK = 6 << 20          # bytes of text labelled at once

# First code point of Unicode script ranges (letters); 0 is any other script.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "other"), (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"),
    (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"),
    (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"),
    (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"),
    (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"),
    (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"), (0x20000, "Han"), (0x32000, "other")]
STARTS = np.array([s for s, _ in SCRIPT_STARTS])
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


@dataclass(frozen=True)
class Model:
    languages: list[str]
    table: np.ndarray    # BUCKETS x languages, log-probabilities
    allowed: np.ndarray  # scripts x languages


def lowered(texts: pa.Array) -> pa.Array:
    return pc.utf8_split_whitespace(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))


def letters_of(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words one after the other, each followed by a 0, other characters than letters as 0; word starts."""
    joined = np.frombuffer("\0".join([*found, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.flatnonzero(np.concatenate([[True], joined[:-1] == 0]))
    kinds, at = np.unique(joined, return_inverse=True)
    alpha = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
    return np.where(alpha[at], joined, 0).astype(np.int64), starts


def grams(points: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and buckets of the n-grams that hold letters, with word ends outside only."""
    ahead = np.concatenate([[0], points, np.zeros(order, np.int64)])
    parts = [ahead[j:len(points) + 1 + j] for j in range(order)]
    keep = np.ones(len(points) + 1, bool)
    for part in (parts[1:-1] if order > 2 else parts):
        keep &= part > 0
    if order == 2:
        keep = (parts[0] > 0) | (parts[1] > 0)
    places = np.flatnonzero(keep)
    h = np.full(len(places), order, np.uint64)
    for part in parts:
        h = (h * np.uint64(0x100000001B3)) ^ part[places].astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # The zero in front shifts places by one; a gram belongs to the word of its first letter.
    first = np.where(parts[0][places] > 0, places - 1, places)
    return np.minimum(first, len(points) - 1), (h >> np.uint64(48)).astype(np.int64)


def blocks(found: list[str]) -> Iterator[list[str]]:
    """The words in runs of about BLOCK letters."""
    ends = np.cumsum([len(w) + 1 for w in found]) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(found)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield found[a:b]


def scores(found: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihoods (words x languages) and numbers of letters. A word without letters scores 0 everywhere."""
    out, sizes = [], []
    for part in blocks(found):
        points, starts = letters_of(part)
        total = np.zeros((len(part), len(model.languages)))
        word_at = np.zeros(len(points), np.int64)
        word_at[starts[starts < len(points)][1:]] = 1
        word_at = np.minimum(np.cumsum(word_at), len(part) - 1)
        for order in ORDERS:
            places, bucket = grams(points, order)
            owner = word_at[places]
            for k in range(len(model.languages)):
                total[:, k] += np.bincount(owner, model.table[bucket, k], minlength=len(part))
        letter = points > 0
        sizes.append(np.bincount(word_at[letter], minlength=len(part)))
        script = SCRIPT_OF[np.searchsorted(STARTS, points[letter], "right") - 1]
        first_at = np.full(len(part), -1, np.int64)
        first_at[word_at[letter][::-1]] = script[::-1]
        total /= len(ORDERS)
        known = first_at >= 0
        total[known] -= np.where(model.allowed[first_at[known]], 0, OUTSIDE)
        out.append(total)
    if not out:
        return np.zeros((0, len(model.languages))), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(sizes)


def paths(score: np.ndarray, words: np.ndarray, offsets: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of every word, for all texts of a chunk at once, step by step through the words."""
    sizes = np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    start, size = offsets[:-1][order], sizes[order]
    label = np.zeros(len(words), np.int32)
    longest = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(longest), "left")  # texts with more than t words
    best = np.zeros((len(size), score.shape[1]))
    came = np.empty((int(live.sum()), score.shape[1]), np.int16 if score.shape[1] > 127 else np.int8)
    base = np.concatenate([[0], np.cumsum(live)])
    own = np.arange(score.shape[1])
    for t in range(longest):
        n = live[t]
        if t == 0:
            came[:n] = own
        else:
            top = best[:n].argmax(1)
            jump = best[np.arange(n), top] - penalty
            stay = best[:n] >= jump[:, None]
            came[base[t]:base[t] + n] = np.where(stay, own, top[:, None])
            best[:n] = np.maximum(best[:n], jump[:, None])
        best[:n] += score[words[start[:n] + t]]
    state = best.argmax(1)
    for t in range(longest - 1, -1, -1):
        n = live[t]
        label[start[:n] + t] = state[:n]
        state[:n] = came[base[t]:base[t] + n][np.arange(n), state[:n]]
    return label


SPAN = pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("letters", pa.int64()), ("lang", pa.string())])


def label_batch(texts: pa.Array, model: Model, penalty: float) -> pa.Array:
    lists = lowered(texts)
    offsets = np.asarray(lists.offsets, np.int64)
    offsets = offsets - offsets[0]
    coded = lists.flatten().dictionary_encode()
    score, sizes = scores(coded.dictionary.to_pylist(), model)
    words = np.asarray(coded.indices, np.int64)
    label = paths(score, words, offsets, penalty)
    text_of = np.repeat(np.arange(len(texts)), np.diff(offsets))
    cut = np.ones(len(words), bool)
    cut[1:] = (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1])
    at = np.flatnonzero(cut)
    n_words = np.diff(np.append(at, len(words)))
    letters = np.add.reduceat(sizes[words], at) if len(at) else np.zeros(0, np.int64)
    spans = pa.StructArray.from_arrays(
        [pa.array((at - offsets[:-1][text_of[at]]).astype(np.int32)), pa.array(n_words.astype(np.int32)),
         pa.array(letters.astype(np.int64)), pa.array(np.array(model.languages, object)[label[at]], pa.string())],
        fields=list(SPAN))
    per_text = np.concatenate([[0], np.cumsum(np.bincount(text_of[at], minlength=len(texts)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per_text), spans)


def chunks(batch: pa.RecordBatch, text: int = 1) -> Iterator[pa.RecordBatch]:
    """Row runs of about CHUNK bytes of text, which is in the column of that number."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    at = np.cumsum(sizes) // CHUNK
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Model:
    """Letter n-gram tables from labelled texts.

    About `rows` texts of each language are read, chosen by a hash of `key`; languages with fewer are read whole.
    Texts without label are ignored. What reaches the driver is one count for each n-gram bucket and language.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    # As many entries as the model has languages; a join would bring the texts of a language together.
    sizes = {r["_lang"]: r["_rows"] for r in labelled.groupBy(F.col(lang).cast("string").alias("_lang")).agg(
        F.count(F.lit(1)).alias("_rows")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.ones((len(SCRIPTS), 0), bool))
    of_language = F.element_at(F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]), F.col(lang).cast("string"))
    chosen = labelled.filter(common.luck(key) * of_language < rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in chunks(whole):
                names = np.asarray(batch.column(0).to_pylist(), object)
                for name in set(names.tolist()):
                    mine = batch.column(1).filter(pa.array(names == name))
                    coded = lowered(mine).flatten().dictionary_encode()
                    often = np.bincount(np.asarray(coded.indices, np.int64), minlength=len(coded.dictionary))
                    found = coded.dictionary.to_pylist()
                    sums = total.setdefault(name, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                    done = 0
                    for part in blocks(found):
                        points, starts = letters_of(part)
                        first = np.zeros(len(points), np.int64)
                        first[starts[starts < len(points)][1:]] = 1
                        weight = often[done:done + len(part)][np.minimum(np.cumsum(first), len(part) - 1)]
                        for order in ORDERS:
                            places, bucket = grams(points, order)
                            sums[:BUCKETS] += np.bincount(bucket, weight[places], minlength=BUCKETS).astype(np.int64)
                        letter = points > 0
                        script = SCRIPT_OF[np.searchsorted(STARTS, points[letter], "right") - 1]
                        sums[BUCKETS:] += np.bincount(script, weight[letter], minlength=len(SCRIPTS)).astype(np.int64)
                        done += len(part)
        for name, sums in total.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

    counted = (chosen.select(F.col(lang).cast("string"), F.col(text)).mapInArrow(count, "lang string, bucket bigint, n bigint")
               .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))).toArrow()
    languages = sorted(set(counted.column("lang").to_pylist()))
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    if languages:
        which = pc.index_in(counted.column("lang"), pa.array(languages)).to_numpy()
        sums[counted.column("bucket").to_numpy(), which] = counted.column("n").to_numpy()
    grams_, letters = sums[:BUCKETS] + SMOOTH, sums[BUCKETS:]
    allowed = letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1)
    allowed[~allowed.any(1)] = True  # a script that no language uses rules nobody out
    return Model(languages, np.log(grams_ / grams_.sum(0)).astype(np.float32), allowed)


def label_spans(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(key, text's spans) of every row: array<struct<first_word, n_words, letters, lang>>, words split at white space.

    Null, empty and blank texts have no spans; neither has any text when the model knows no language.
    Repeated rows are labelled each; no shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole):
                spans = (label_batch(batch.column(1), model, penalty) if model.languages
                         else pa.array([[]] * batch.num_rows, pa.list_(SPAN)))
                yield pa.RecordBatch.from_arrays([batch.column(0), spans], [key, "spans"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, spans array<struct<first_word:int,n_words:int,letters:bigint,lang:string>>")


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", penalty: float = PENALTY) -> DataFrame:
    """(key, lang_pred, score): the language with most letters, and its share of them; `und` and 0 without letters.

    Of languages with equally many letters the alphabetically last is taken.
    """
    per = F.transform(F.array(*map(F.lit, model.languages)) if model.languages else F.array().cast("array<string>"),
                      lambda name: F.struct(F.aggregate(
                          F.filter("spans", lambda s: s["lang"] == name), F.lit(0).cast("bigint"),
                          lambda total, s: total + s["letters"]).alias("letters"), name.alias("lang")))
    whole = F.aggregate("spans", F.lit(0).cast("bigint"), lambda total, s: total + s["letters"])
    best = common.let(per, lambda p: F.array_max(p))
    return (label_spans(docs, model, key, text, penalty).withColumn("_best", best).withColumn("_all", whole)
            .select(key, F.when(F.col("_all") > 0, F.col("_best.lang")).otherwise("und").alias("lang_pred"),
                    F.when(F.col("_all") > 0, F.col("_best.letters") / F.col("_all")).otherwise(0.0).alias("score")))


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5, penalty: float = PENALTY) -> DataFrame:
    """The rows of `docs` whose text has letters and gives one language at least `least` of them. No shuffle.

    With a model without languages there is nothing to go by, and all rows stay.
    """
    if not model.languages:
        return docs
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, at):
                spans = label_batch(batch.column(at), model, penalty)
                row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(spans.offsets)))
                found = spans.flatten()
                letters = np.zeros((batch.num_rows, len(model.languages)))
                which = np.asarray(pc.index_in(found.field("lang"), pa.array(model.languages)))
                np.add.at(letters, (row, which), np.asarray(found.field("letters")))
                total = letters.sum(1)
                yield batch.filter(pa.array((total > 0) & (letters.max(1) >= least * total)))

    return docs.mapInArrow(run, docs.schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.filter(~held_out))
    return predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
