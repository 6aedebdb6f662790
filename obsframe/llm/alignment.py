"""Alignment of two tokenizers by galloping intersection of the byte offsets at which their tokens end.

The shorter list of ends drives an exponential and then a binary search into the longer one. Ends in both lists cut
the tokens of both sides into groups; the differences of their ranks are how many tokens each side of a group has.

A space after a non-space ends a token on both sides, so a text is cut there first and each distinct piece is encoded
and aligned once for a worker, thousands of pieces in one pair of lists. Documents are sums over their pieces.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.llm.tokenfiles import per_worker
from obsframe.session import cut_lineage, ensure_checkpoint_dir

STRIDE = 64             # of the drivers that are placed first; those between start from there
JOINED = 512            # pieces that the byte-level tokenizer gets as one text
NEW = 8192              # pieces aligned at once
KNOWN = 250_000         # remembered pieces; the memory starts afresh beyond
WIDE = 1 << 14          # a group with more links than this is counted by its distinct ids
HEAVY = 1 << 18         # at most so many id pairs are sent to every executor
HELD = 1 << 22          # ids of pairs that a task counts at once


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each element of `short` its place in `long`, -1 where it is missing. Both ascend strictly."""
    if not len(short) or not len(long):
        return np.full(len(short), -1, np.int64)
    last = len(long) - 1

    def reach(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        """The first place at or after `start` whose value is not below x; `last` + 1 if there is none."""
        low, high, step = start.copy(), np.minimum(start, last), 1
        open_ = np.flatnonzero((start <= last) & (long[high] < x))
        while open_.size:
            low[open_] = high[open_] + 1
            high[open_] = np.minimum(high[open_] + step, last)
            step *= 2
            open_ = open_[(low[open_] <= last) & (long[high[open_]] < x[open_])]
        open_ = np.flatnonzero(low < high)
        while open_.size:
            middle = (low[open_] + high[open_]) >> 1
            below = long[middle] < x[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    first = reach(short[::STRIDE], np.zeros((len(short) + STRIDE - 1) // STRIDE, np.int64))
    place = reach(short, np.repeat(first, STRIDE)[:len(short)])
    return np.where(long[np.minimum(place, last)] == short, np.where(place <= last, place, -1), -1)


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in `a` and in `b` of the ends that both hold."""
    if len(a) <= len(b):
        at = gallop(a, b)
        return np.flatnonzero(at >= 0), at[at >= 0]
    at = gallop(b, a)
    return at[at >= 0], np.flatnonzero(at >= 0)


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... with counts[0] elements, then the same of the others."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def links_of(a: np.ndarray, b: np.ndarray, start_a: np.ndarray, start_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
             width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair, links): the id pairs of each group and how often it links them; a pair may come in several rows."""
    wide = size_a * size_b > WIDE
    narrow = np.flatnonzero(~wide)
    group = np.repeat(narrow, size_a[narrow] * size_b[narrow])
    nth = spread(np.zeros(len(narrow), np.int64), size_a[narrow] * size_b[narrow])
    left, right = a[start_a[group] + nth // size_b[group]], b[start_b[group] + nth % size_b[group]]
    groups, pairs, links = [group], [left * width + right], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(wide).tolist():
        x, many_x = np.unique(a[start_a[g]:start_a[g] + size_a[g]], return_counts=True)
        y, many_y = np.unique(b[start_b[g]:start_b[g] + size_b[g]], return_counts=True)
        pairs.append((x[:, None] * width + y[None, :]).ravel())
        links.append((many_x[:, None] * many_y[None, :]).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return tuple(np.concatenate(c) for c in (groups, pairs, links))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values[:0]


def letters_as_bytes() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: itself if it is printable, else 256 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Both tokenizers: ids of pieces, and the bytes of every id."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte_of, size = letters_as_bytes(), self.a.get_vocab_size()
        self.bytes_a = [b""] * size
        for token, i in self.a.get_vocab().items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        found = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(found)]
        self.width = len(self.bytes_b)
        if any("▁" in p.lstrip("▁") for p in found):
            raise ValueError("a piece of the second vocabulary goes over a space, so texts cannot be cut at spaces")
        self.sizes_a, self.sizes_b = (np.array([len(t) for t in x], np.int64) for x in (self.bytes_a, self.bytes_b))

    def each_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)

    def joined_a(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As `each_a`, for texts that begin with a space and end with none: hundreds are encoded as one."""
        flat, _ = self.each_a(["".join(texts[i:i + JOINED]) for i in range(0, len(texts), JOINED)])
        ends, cuts = np.cumsum(self.sizes_a[flat]), np.cumsum([len(t.encode()) for t in texts])
        upto = np.searchsorted(ends, cuts, "right")
        if len(texts) and (not upto.all() or not np.array_equal(ends[upto - 1], cuts)):
            return self.each_a(texts)
        return flat, np.diff(upto, prepend=0)

    def ids_a(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and the number of ids of each. A piece follows a space of its own."""
        texts = [" " + p for p in pieces]
        # A piece that ends with white space, or is nothing else, would meet the space of the next.
        alone = np.array([t[-1].isspace() for t in texts], bool)
        flat, counts = self.joined_a([t for t, x in zip(texts, alone) if not x])
        if not alone.any():
            return flat, counts
        odd, odd_counts = self.each_a([t for t, x in zip(texts, alone) if x])
        sizes = np.zeros(len(texts), np.int64)
        sizes[~alone], sizes[alone] = counts, odd_counts
        out, owner = np.empty(sizes.sum(), np.int64), np.repeat(alone, sizes)
        out[~owner], out[owner] = flat, odd
        return out, sizes

    def ids_b(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # A lone space at the end of a text; the library gives nothing for an empty text of its own.
        space = [self.b.piece_to_id("▁")]
        found = [f if p else space for p, f in zip(pieces, self.b.encode(pieces, num_threads=1))]
        return np.array([i for f in found for i in f], np.int64), np.array([len(f) for f in found], np.int64)

    def same(self, pieces: list[str], flat: np.ndarray, counts: np.ndarray, table: list[bytes]) -> np.ndarray:
        """Which pieces, each after its space, are what the bytes of their ids joined are."""
        parts = list(map(table.__getitem__, flat.tolist()))
        ends = np.cumsum(counts).tolist()
        return np.array([b"".join(parts[e - n:e]) == (" " + p).encode() for e, n, p in zip(ends, counts.tolist(), pieces)], bool)


@dataclass
class Known:
    """What is remembered of pieces: numbers, digest texts and links, by the place that `at` gives."""
    at: dict[str, int] = field(default_factory=dict)
    digest: list[str] = field(default_factory=list)
    numbers: list[np.ndarray] = field(default_factory=list)   # good, tokens of a and b, groups, links, distinct pairs
    pairs: list[np.ndarray] = field(default_factory=list)
    links: list[np.ndarray] = field(default_factory=list)


class Aligner:
    """Alignments of texts under two tokenizers."""

    def __init__(self, path_a: str, path_b: str):
        self.tokens = Tokens(path_a, path_b)
        self.width = self.tokens.width
        self.after_space = regex.compile(r"(?<=\S)(?= )")
        self.doubtful = regex.compile(r"\s ")
        names = lambda n, end: [f"{i}{end}" for i in range(n)]
        n_a, n_b = len(self.tokens.bytes_a), self.width
        self.shown = [*names(n_a, ","), *names(n_a, "|"), *names(n_b, ","), *names(n_b, ";")]
        self.known = Known()

    def pieces(self, text: str) -> list[str]:
        """The text cut at spaces that follow a non-space; each piece stands for itself after one space."""
        full = " " + text
        if self.doubtful.search(full):
            return [p[1:] for p in self.after_space.split(full)]
        return text.split(" ")

    def groups(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """Starts and sizes of the groups of two id lists over the same bytes, and the offsets at which they end."""
        ends_a, ends_b = (np.cumsum(s[x]) for s, x in ((self.tokens.sizes_a, a), (self.tokens.sizes_b, b)))
        at_a, at_b = common_ends(ends_a, ends_b)
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        return at_a + 1 - size_a, at_b + 1 - size_b, size_a, size_b, ends_a[at_a]

    def learn(self, new: list[str]) -> None:
        known, first = self.known, len(self.known.digest)
        a, count_a = self.tokens.ids_a(new)
        b, count_b = self.tokens.ids_b(new)
        good = self.tokens.same(new, a, count_a, self.tokens.bytes_a) & self.tokens.same(new, b, count_b, self.tokens.bytes_b)
        a, b = a[np.repeat(good, count_a)], b[np.repeat(good, count_b)]
        count_a, count_b = count_a * good, count_b * good
        start_a, start_b, size_a, size_b, _ = self.groups(a, b)
        owner = np.searchsorted(np.cumsum(count_a), start_a, "right")
        group, pair, links = links_of(a, b, start_a, start_b, size_a, size_b, self.width)
        span = len(self.tokens.bytes_a) * self.width
        keys, links = summed(owner[group] * span + pair, links)
        # Each side's ids in the order of the digest; the last of a group carries the group's mark.
        n_a = len(self.tokens.bytes_a)
        code_a, code_b = a.copy(), b + 2 * n_a
        code_a[start_a + size_a - 1] += n_a
        code_b[start_b + size_b - 1] += self.width
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(start_b, size_a)] = code_a
        order[np.arange(len(b)) + np.repeat(start_a + size_a, size_b)] = code_b
        shown = list(map(self.shown.__getitem__, order.tolist()))
        ends = np.cumsum(count_a + count_b).tolist()
        known.digest += ["".join(shown[s:e])[:-1] for s, e in zip([0, *ends], ends)]
        n = len(new)
        known.numbers.append(np.stack([good.astype(np.int64), count_a, count_b, np.bincount(owner, minlength=n),
                                       np.bincount(owner, size_a * size_b, minlength=n).astype(np.int64),
                                       np.bincount(keys // span, minlength=n)], 1))
        known.pairs.append(keys % span)
        known.links.append(links)
        known.at.update(zip(new, range(first, first + n)))

    def learned(self, texts: list[list[str]]) -> None:
        """Remember every piece of `texts`."""
        if len(self.known.at) > KNOWN:
            self.known = Known()
        new = list(set().union(*texts).difference(self.known.at))
        for at in range(0, len(new), NEW):
            self.learn(new[at:at + NEW])
        known = self.known
        if len(known.numbers) > 1:
            known.numbers, known.pairs, known.links = ([np.concatenate(c)] for c in (known.numbers, known.pairs, known.links))

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Numbers (tokens of a and b, groups, links) and digest of each text; offsets, pairs and links of all."""
        cut = [self.pieces(t) if t else [] for t in texts]
        self.learned(cut)
        known, number = self.known, np.zeros((len(texts), 4), np.int64)
        if not known.numbers:
            return number, [""] * len(texts), np.zeros(len(texts) + 1, np.int64), *(np.empty(0, np.int64) for _ in range(2))
        of, starts = known.numbers[0], np.cumsum(known.numbers[0][:, 5]) - known.numbers[0][:, 5]
        digest, docs, used, times = [], [], [], []
        for i, found in enumerate(cut):
            at = np.fromiter(map(known.at.__getitem__, found), np.int64, len(found))
            if not len(at) or not of[at, 0].all():
                digest.append("")
                continue
            number[i] = of[at, 1:5].sum(0)
            digest.append(hashlib.sha256(";".join(map(known.digest.__getitem__, at.tolist())).encode()).hexdigest())
            one, many = np.unique(at, return_counts=True)
            docs.append(np.full(len(one), i))
            used.append(one)
            times.append(many)
        if not used:
            return number, digest, np.zeros(len(texts) + 1, np.int64), *(np.empty(0, np.int64) for _ in range(2))
        docs, used, times = map(np.concatenate, (docs, used, times))
        counts, span = of[used, 5], len(self.tokens.bytes_a) * self.width
        place = spread(starts[used], counts)
        keys, links = summed(np.repeat(docs, counts) * span + known.pairs[0][place], np.repeat(times, counts) * known.links[0][place])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(keys // span, minlength=len(texts)))])
        return number, digest, offsets, keys % span, links


def aligner(path_a: str, path_b: str) -> Aligner:
    return per_worker(("aligner", path_a, path_b), lambda: Aligner(path_a, path_b))


def batches_of(batch: pa.RecordBatch, rows: int = 256, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with few rows and, but for single long texts, few bytes of the last column."""
    lengths = [len(t.as_buffer()) if (t := v).is_valid else 0 for v in batch.column(batch.num_columns - 1)]
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= rows or held + n > size):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def overlaps(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, group_no, from_byte, to_byte, a_ids, b_ids): the groups of every text, offsets in space + text.

    Texts that have no tokens by the rule of `alignments` have no groups.
    """
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                cut = own.pieces(value) if value else []
                (a, n_a), (b, n_b) = (f(cut) if cut else (np.empty(0, np.int64),) * 2 for f in (own.tokens.ids_a, own.tokens.ids_b))
                if not cut or not (own.tokens.same(cut, a, n_a, own.tokens.bytes_a) & own.tokens.same(cut, b, n_b, own.tokens.bytes_b)).all():
                    continue
                start_a, start_b, size_a, size_b, ends = own.groups(a, b)
                for at in range(0, len(ends), 4096):
                    part = slice(at, at + 4096)
                    lists = [[x[s:s + n].tolist() for s, n in zip(starts[part].tolist(), sizes[part].tolist())]
                             for x, starts, sizes in ((a, start_a, size_a), (b, start_b, size_b))]
                    begins = np.concatenate([[0], ends])[:-1][part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i] * len(begins), batch.schema.field(0).type), pa.array(np.arange(at, at + len(begins))), pa.array(begins),
                         pa.array(ends[part]), *(pa.array(x, pa.list_(pa.int64())) for x in lists)],
                        [id_col, "group_no", "from_byte", "to_byte", "a_ids", "b_ids"])

    return docs.select(id_col, text).mapInArrow(run, (
        f"`{id_col}` {kind.simpleString()}, group_no bigint, from_byte bigint, to_byte bigint, a_ids array<bigint>, b_ids array<bigint>"))


COUNTS = "n_a", "n_b", "n_groups", "n_links"


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str, text: str) -> DataFrame:
    """(uid, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, links) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["uid", id_col, *COUNTS, "groups_sha256", "pairs", "links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(path_a, path_b)
        for batch in batches:
            for part in batches_of(batch):
                number, digest, offsets, pairs, links = own.align(part.column(2).to_pylist())
                at = pa.array(offsets, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), *map(pa.array, number.T.copy()), pa.array(digest, pa.string()),
                     *(pa.ListArray.from_arrays(at, pa.array(x, pa.int64())) for x in (pairs, links))], names)

    return docs.select(F.monotonically_increasing_id().alias("uid"), id_col, text).mapInArrow(run, (
        f"uid bigint, `{id_col}` {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, groups_sha256 string, pairs array<bigint>, links array<bigint>"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, docs): in how many rows each id pair is linked. Tasks count before they shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, size = np.empty(0, np.int64), np.empty(0, np.int64), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new = np.concatenate(fresh) if fresh else np.empty(0, np.int64)
            return summed(np.concatenate([keys, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "docs"])

        for batch in batches:
            fresh.append(batch.column(0).flatten().to_numpy())
            size += len(fresh[-1])
            if size > HELD:
                keys, counts = merged()
                fresh, size = [], 0
                if len(keys) > HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield out()

    return rows.select("pairs").mapInArrow(run, "pair bigint, docs bigint").groupBy("pair").agg(F.sum("docs").alias("docs"))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of `docs`.

    A encodes space + text, B, which adds the space itself, the text. A null or empty text, or one whose joined
    token bytes differ from space + text on either side, has no tokens: zeros and an empty digest. Rows that repeat
    an id, and rows without one, are documents of their own.

    A pair's count is the number of rows that link it. Pairs that hold at least 1 of `heavy` parts of all counts are
    sent to every executor, and there are at most `heavy` of them; the rest, of which none is frequent, is joined.
    """
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/alignment-{uuid.uuid4()}"
    written = lambda df, name: (df.write.option("compression", "zstd").parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
    rows = written(aligned(docs, path_a, path_b, id_col, text), "rows")
    counted = written(pair_counts(rows), "counts")
    width = Tokens(path_a, path_b).width
    total = counted.agg(F.sum("docs")).first()[0] or 0
    # One row for each id of the first vocabulary.
    best = counted.groupBy(F.floor(F.col("pair") / F.lit(width)).alias("a")).agg(F.max("docs").alias("best"))
    often = (F.col("docs").cast("decimal(38,0)") * heavy) >= total
    held = [counted.filter(often).select("pair", "docs").orderBy("pair").toArrow(), best.toArrow()]
    keys, docs_of = (held[0].column(c).to_numpy() for c in ("pair", "docs"))
    top = np.zeros(int(max(held[1].column("a").to_numpy(), default=0)) + 1, np.int64)
    top[held[1].column("a").to_numpy()] = held[1].column("best").to_numpy()
    shared = spark.sparkContext.broadcast((keys, docs_of, docs_of == top[keys // width]))
    names = ["uid", id_col, *COUNTS, "groups_sha256", "n_best", "count_sum", "pairs", "links"]

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_of, is_best = shared.value
        for batch in batches:
            lists = [batch.column(c) for c in ("pairs", "links")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), sizes)
            pairs, links = (c.flatten().to_numpy() for c in lists)
            at = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
            met = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], row[met], links[met] * is_best[at[met]])
            np.add.at(sums[1], row[met], links[met] * docs_of[at[met]])
            left = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~met], minlength=batch.num_rows))]), pa.int32())
            rest = [pa.ListArray.from_arrays(left, pa.array(x[~met])) for x in (pairs, links)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-4]), *map(pa.array, sums), *rest], names)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema} | {"n_best": "bigint", "count_sum": "bigint"}
    done = written(rows.select(*names[:-4], "pairs", "links").mapInArrow(resolve, ", ".join(f"`{c}` {kinds[c]}" for c in names)), "resolved")
    seldom = (done.filter(F.size("pairs") > 0).select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("x"))
              .select("uid", F.col("x.pairs").alias("pair"), F.col("x.links").alias("links")))
    known = counted.filter(~often).withColumn("a", F.floor(F.col("pair") / F.lit(width))).join(F.broadcast(best), "a").drop("a")
    more = (seldom.join(known, "pair").groupBy("uid").agg(
        F.sum(F.when(F.col("docs") == F.col("best"), F.col("links")).otherwise(0)).alias("more_best"),
        F.sum(F.col("docs") * F.col("links")).alias("more_sum")))
    return (done.drop("pairs", "links").join(more, "uid", "left")
            .select(id_col, *COUNTS, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
                    (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256"))


def vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE beside piece BPE on every text of `documents`."""
    return alignments(common.table(spark, sf_dir, "documents"), *vocabularies())
