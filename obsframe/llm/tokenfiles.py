"""Token-ID files: one zstandard dictionary for all documents, one frame for each.

A file set is two Parquet tables that Spark writes and reads on any store. `dictionary` is one row: sha256 and
bytes. `shards` holds runs of documents in ascending order: the frames one after the other as `payload`, and beside
them ids, frame offsets and token counts. A frame is the zstandard form of a document's ids (2 bytes each, 4 for
vocabularies over 65,536), so one short document is read by decoding one slice of one payload.
"""

from __future__ import annotations

import hashlib
import re
import sys
import types
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.llm import common
from obsframe.session import ensure_checkpoint_dir, shuffle_width

END = 0                      # appended to every document
DICTIONARY_BYTES = 1 << 16
SAMPLE_DOCS = 2000           # expected number of documents the dictionary is trained on
SAMPLE_IDS = 2048            # ids taken of each, from a place that depends on its text
SHARD_BYTES = 2 << 20        # a shard is closed once its frames reach this
KNOWN = 300_000             # cached pieces, and as many pre-tokens; beyond, the cache starts afresh or keeps the more frequent half
GROUP_CHARS = 1 << 20       # characters of plain texts that are cut into pre-tokens at once
LAST_PLAIN = "\u024f"       # up to here, the end of the Latin letters, library and patterns know the same letters
LEVEL = 3

# Fixed value: the pre-token pattern of byte-level BPE vocabularies.
PRE_TOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def plain_classes() -> np.ndarray:
    """Class of each character up to LAST_PLAIN in PRE_TOKEN: 0 letter, 1 number, 2 other, 3 white space."""
    kinds = (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]", r"\s")
    return np.array([next(k for k, kind in enumerate(kinds) if regex.fullmatch(kind, chr(i))) for i in range(ord(LAST_PLAIN) + 1)], np.uint8)


def pre_token_starts(codes: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether PRE_TOKEN starts a match at each of the plain characters `codes`; `first` marks the first ones of texts."""
    kind = classes[codes]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last white space before something else is cut off, and a space goes with what follows.
    last = (kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:]
    start[:-1] |= last
    start[1:] &= ~(last & (codes[:-1] == ord(" ")))
    at = np.flatnonzero((codes == ord("'")) & start)
    longer = np.concatenate([codes, [0, 0, 0]])
    inside = ~np.concatenate([first, [True] * 3])
    one, two = longer[at + 1], longer[at + 2]
    short = inside[at + 1] & np.isin(one, [ord(c) for c in "sdmt"])
    double = inside[at + 1] & inside[at + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in ("ll", "ve", "re")])
    start[at[short | double] + 1] = False
    ends = np.concatenate([at[short] + 2, at[double] + 3])
    start[ends[ends < len(start)]] = True
    return start


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object that lives as long as the Python worker, so that its caches outlast a task."""
    holder = sys.modules.setdefault("_token_files_worker", types.ModuleType("_token_files_worker"))
    state = holder.__dict__.setdefault("state", {})
    if key not in state:
        state[key] = make()
    return state[key]


class Encoder:
    """Ids of whole texts from a `tokenizers` file, each distinct piece encoded once.

    Pre-tokens are independent of each other. A text of plain characters is cut into them at once; each has a number,
    and the ids of all numbers lie in one array. In other texts a space after a non-space always starts a pre-token, so
    they are cut at such spaces and pieces are cut into pre-tokens. Only new pre-tokens go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.default = Tokenizer.from_file(path)
        self.marks = [t.content for t in self.default.get_added_tokens_decoder().values()]
        self.width = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        marked = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            marked[i] = token.startswith("Ġ")
        self.opens = marked
        self.after_space = regex.compile(r"(?<=\S)(?= )")
        self.doubtful = regex.compile(r"\s ")
        self.pre_token = regex.compile(PRE_TOKEN)
        self.plain = regex.compile(f" [\t\n\r!-{LAST_PLAIN}]+")
        self.plain_text = re.compile(f"[\t\n\r -{LAST_PLAIN}]*")
        self.classes = plain_classes()
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.numbers: dict[str, int] = {}                            # known plain pre-tokens
        self.pool = np.empty(0, self.width)                          # ids of pre-tokens, one after the other
        self.starts, self.sizes, self.seen = (np.empty(0, np.int64) for _ in range(3))   # by number
        self.pieces: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return np.array(ids, self.width).tobytes()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [self.packed(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn_numbers(self, new: list[str]) -> None:
        """Give the plain pre-tokens `new` the numbers after the known ones. Most go to the library in long strings, whose ids are cut again at tokens with a space in front or at line ends that separate pre-tokens
        without white space."""
        kinds: tuple[list[str], ...] = ([], [], [])
        for t in new:
            kinds[0 if t[-1].isspace() else 1 if t[0] == " " else 2].append(t)
        ids, sizes = [self.pool], [self.sizes]
        for kind, every in enumerate(kinds):
            every.sort()                                             # neighbours share merges
            for at in range(0, len(every), 64):
                part = every[at:at + 64]
                if kind and (kind == 1 or len(self.newline) == 1):
                    got = np.frombuffer(self.whole(["".join(part) if kind == 1 else "\n".join([*part, ""])])[0], self.width)
                    is_cut = self.opens[got] if kind == 1 else got == self.newline[0]
                    cuts = np.flatnonzero(is_cut)
                    if len(cuts) == len(part):
                        ids.append(got if kind == 1 else got[~is_cut])
                        sizes.append(np.diff(cuts, append=len(got)) if kind == 1 else np.diff(cuts, prepend=-1) - 1)
                        continue
                raw = self.whole(part)
                ids.append(np.frombuffer(b"".join(raw), self.width))
                sizes.append(np.array([len(r) // self.width.itemsize for r in raw], np.int64))
        ordered = [t for every in kinds for t in every]
        self.pool, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])
        self.numbers.update(zip(ordered, range(len(self.numbers), len(self.seen))))

    def forget(self) -> None:
        """Keep the more frequent half of the pre-tokens, under new numbers."""
        keep = np.sort(np.argsort(-self.seen, kind="stable")[:KNOWN // 2])
        names, sizes = list(self.numbers), self.sizes[keep]
        self.pool, self.numbers = self.gathered(keep), {names[i]: n for n, i in enumerate(keep.tolist())}
        self.starts, self.sizes, self.seen = np.cumsum(sizes) - sizes, sizes, self.seen[keep] // 2

    def gathered(self, at: np.ndarray) -> np.ndarray:
        """The ids of pre-tokens with these numbers, one after the other."""
        sizes = self.sizes[at]
        before = np.cumsum(sizes) - sizes
        return self.pool[np.repeat(self.starts[at] - before, sizes) + np.arange(sizes.sum())]

    def encode_numbered(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts of plain characters. Pre-tokens lie side by side in the joined texts, of which they are
        slices; each different one is looked up once."""
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        codes = np.frombuffer(joined.encode("utf-16-le"), "<u2")
        of_text = np.array([0, *map(len, texts)]).cumsum()
        first = np.zeros(len(codes), bool)
        first[of_text[of_text < len(codes)]] = True
        begins, wide = np.flatnonzero(pre_token_starts(codes, first, self.classes)), np.flatnonzero(codes >= 128)
        places = np.concatenate([begins, [len(codes)]])
        places = (places + np.searchsorted(wide, places)).astype(np.int32)           # a wide character has two bytes
        cut = pa.StringArray.from_buffers(len(begins), pa.py_buffer(places), pa.py_buffer(joined.encode())).dictionary_encode()
        names = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [n for n in names if n not in self.numbers]
        if new:
            self.learn_numbers(new)
        at = np.fromiter(map(self.numbers.__getitem__, names), np.int64, len(names))
        of_token = cut.indices.to_numpy()
        self.seen[at] += np.bincount(of_token, minlength=len(at))
        at = at[of_token]
        raw = self.gathered(at).tobytes()
        of_text = np.searchsorted(begins, of_text)
        cuts = (np.concatenate([[0], self.sizes[at].cumsum()])[of_text] * self.width.itemsize).tolist()
        if len(self.numbers) > KNOWN:
            self.forget()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]

    def learn_tokens(self, new: list[str]) -> None:
        spaced = [t for t in new if t[0] == " " and len(t) > 1 and not t[1].isspace()]
        for at in range(0, len(spaced), 512):
            part = spaced[at:at + 512]
            ids = np.array(self.tokenizer.encode("".join(part), add_special_tokens=False).ids, self.width)
            cuts = np.flatnonzero(self.opens[ids])
            if len(cuts) == len(part):
                raw, step = ids.tobytes(), self.width.itemsize
                ends = [*(cuts[1:] * step).tolist(), len(raw)]
                self.tokens.update(zip(part, (raw[a:b] for a, b in zip((cuts * step).tolist(), ends))))
            else:
                self.tokens.update(zip(part, self.whole(part)))
        rest = [t for t in new if not (t[0] == " " and len(t) > 1 and not t[1].isspace())]
        self.tokens.update(zip(rest, self.whole(rest)))

    def learn(self, new: list[str]) -> None:
        """Fill `pieces` for new pieces; a piece is what follows a space, up to the next one."""
        if len(self.pieces) > KNOWN:
            self.pieces.clear()
        if len(self.tokens) > KNOWN:
            self.tokens.clear()
        # Outside the Latin letters, library and pattern might know different letters: such pieces go whole.
        # ASCII letters alone and digits alone are one pre-token.
        own = [p for p in new if p.isascii() and p.isalnum() or self.plain.fullmatch(" " + p)]
        other = list(set(new).difference(own))
        split = [[" " + p] if p.isascii() and (p.isalpha() or p.isdigit()) else self.pre_token.findall(" " + p) for p in own]
        self.learn_tokens(sorted({t for s in split for t in s}.difference(self.tokens)))
        get = self.tokens.__getitem__
        self.pieces.update((p, b"".join(map(get, s))) for p, s in zip(own, split))
        self.pieces.update(zip(other, self.whole([" " + p for p in other])))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. One that holds the string of an added token goes to the library whole."""
        out: list[bytes] = [b""] * len(texts)
        ways: dict[Callable, list[int]] = {self.encode_marked: [], self.encode_numbered: [], self.encode_pieces: []}
        for i, t in enumerate(texts):
            way = (self.encode_marked if any(m in t for m in self.marks)
                   else self.encode_numbered if self.plain_text.fullmatch(t) else self.encode_pieces)
            ways[way].append(i)
        for way, rows in ways.items():
            groups = np.cumsum([len(texts[i]) for i in rows]) // GROUP_CHARS
            for part in np.split(np.array(rows, np.int64), np.flatnonzero(np.diff(groups)) + 1):
                for i, raw in zip(part.tolist(), way([texts[i] for i in part.tolist()]) if len(part) else ()):
                    out[i] = raw
        return out

    def encode_marked(self, texts: list[str]) -> list[bytes]:
        return [self.packed(self.default.encode(t, add_special_tokens=False).ids) for t in texts]

    def encode_pieces(self, texts: list[str]) -> list[bytes]:
        parts, heads = [], []
        for text in texts:
            if self.doubtful.search(text):
                head, *found = self.after_space.split(text)
                found = [f[1:] for f in found]
            else:
                head, *found = text.split(" ")
            heads.append(head)
            parts.append(found)
        starts = self.whole(heads)
        out = []
        for at in range(0, len(parts), 256):
            group = parts[at:at + 256]
            new = set().union(*group).difference(self.pieces)
            if new:
                self.learn(list(new))
                lost = set().union(*group).difference(self.pieces) if not len(self.pieces) > len(new) else ()
                if lost:
                    self.learn(list(lost))
            get = self.pieces.__getitem__
            out += [b"".join(map(get, p)) for p in group]
        return [a + b for a, b in zip(starts, out)]


def encoder(path: str) -> Encoder:
    return per_worker(("encoder", path), lambda: Encoder(path))


def train_dictionary(docs: DataFrame, path: str, text: str = "text", docs_bound: int = SAMPLE_DOCS,
                     size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialized id arrays, trained in one task on at most a few MB.

    About `docs_bound` documents are taken, chosen by a hash of their text, and up to 2,048 ids of each. Where
    that is too little to train on, the samples themselves are the dictionary; without any it is empty.
    """
    total = docs.count()
    # Of equal texts, which are drawn together, one is taken.
    chosen = docs.select(text).filter(F.col(text).isNotNull()).filter(
        common.luck(text) * total < docs_bound).groupBy(F.xxhash64(text)).agg(F.first(text).alias(text)).select(text)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out = []
            for raw in own.encode(batch.column(0).to_pylist()):
                step = own.width.itemsize
                room = max(1, len(raw) // step - SAMPLE_IDS + 1)
                at = zlib.crc32(raw) % room * step
                out.append(raw[at:at + SAMPLE_IDS * step])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["sample"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = sorted(s for b in batches for s in b.column(0).to_pylist() if s)
        try:
            found = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples
            found = b"".join(samples)[:size]
        yield pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["dictionary"])

    rows = (chosen.mapInArrow(sample, "sample binary").repartition(1)
            .mapInArrow(train, "dictionary binary").collect())
    return bytes(rows[0]["dictionary"]) if rows else b""


def frame_dictionary(dictionary: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


SHARDS = ("slice int, shard int, dictionary_sha256 string, id_bytes int, first_token bigint, n_tokens bigint, "
          "first_id bigint, last_id bigint, doc_ids array<bigint>, offsets array<bigint>, counts array<bigint>, payload binary")


def write(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text: str = "text", end: int = END) -> str:
    """Encode every row, append `end`, and write the files to `folder` in ascending id order. Returns `folder`.

    Null texts are empty ones, null ids come first, rows with equal ids keep no stated order among them. Repeated
    rows are written each. An empty table gives an empty file set.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, text)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary)], "sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    at, _ = common.slices(rows.filter("id IS NOT NULL"), "id")
    salt = F.pmod(F.xxhash64("text"), F.lit(shuffle_width(spark))) - shuffle_width(spark)  # null ids: negative slices
    ordered = (rows.withColumn("slice", F.when(F.col("id").isNull(), salt).otherwise(at).cast("int"))
               .repartition(shuffle_width(spark), "slice").sortWithinPartitions("slice", "id"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=frame_dictionary(dictionary)).compress
        tail, step = own.packed([end]), own.width.itemsize
        current, shard, before = None, 0, 0
        ids, counts, frames = [], [], []

        def close() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            real = [i for i in ids if i is not None]
            row = [current, shard, name, step, before, sum(counts), min(real, default=None), max(real, default=None),
                   list(ids), offsets.tolist(), list(counts), b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)],
                                              [c.split()[0] for c in SHARDS.split(", ")])

        held = 0
        for batch in batches:
            for at_row in range(0, batch.num_rows, 1024):
                part = batch.slice(at_row, 1024)
                slices = part.column("slice").to_pylist()
                for one, doc, raw in zip(slices, part.column("id").to_pylist(), own.encode(part.column("text").to_pylist())):
                    if ids and (one != current or held >= SHARD_BYTES):
                        yield close()
                        before = before + sum(counts) if one == current else 0
                        shard = shard + 1 if one == current else 0
                        ids, counts, frames, held = [], [], [], 0
                    if one != current:
                        shard, before = 0, 0
                    current = one
                    raw += tail
                    frames.append(squeeze(raw))
                    held += len(frames[-1])
                    ids.append(doc)
                    counts.append(len(raw) // step)
        if ids:
            yield close()

    ordered.mapInArrow(pack, SHARDS).write.parquet(f"{folder}/shards")
    return folder


def unpacked(dictionaries: dict[str, bytes]) -> Callable[[str, int, bytes], np.ndarray]:
    """A function from a shard's dictionary hash, width and one frame to the ids."""
    open_: dict[str, Callable] = {}

    def ids(name: str, step: int, frame: bytes) -> np.ndarray:
        if name not in open_:
            found = dictionaries[name]
            if hashlib.sha256(found).hexdigest() != name:
                raise ValueError("the dictionary does not match the hash in the shards")
            open_[name] = zstandard.ZstdDecompressor(dict_data=frame_dictionary(found)).decompress
        return np.frombuffer(open_[name](frame), f"<u{step}")
    return ids


def dictionaries_of(spark: SparkSession, folder: str) -> dict[str, bytes]:
    return {r["sha256"]: bytes(r["dictionary"]) for r in spark.read.parquet(f"{folder}/dictionary").collect()}


def placed(spark: SparkSession, folder: str) -> DataFrame:
    """Shards with `start`, the number of ids before them. The sums run over slices, whose number is bounded."""
    shards = spark.read.schema(SHARDS).parquet(f"{folder}/shards")
    sums = shards.groupBy("slice").agg(F.sum("n_tokens").alias("n"))
    over = Window.partitionBy(F.lit(0)).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("slice", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("base"))
    return shards.join(F.broadcast(bases), "slice").withColumn("start", F.col("base") + F.col("first_token")).drop("base")


def read(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents, or of the given few: then only their shards are read
    and only their frames decoded."""
    return decoded(spark, folder, doc_ids, "doc_id bigint, start bigint, n_tokens bigint, ids array<bigint>", lambda found: pa.array(
        [f.astype(np.int64) for f in found], pa.list_(pa.int64())))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents, from the decoded files."""
    return decoded(spark, folder, None, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", lambda found: pa.array(
        [zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()))


def decoded(spark: SparkSession, folder: str, doc_ids: list[int] | None, schema: str,
            last: Callable[[list[np.ndarray]], pa.Array]) -> DataFrame:
    ids = unpacked(dictionaries_of(spark, folder))
    shards = placed(spark, folder)
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        shards = shards.filter(F.lit(False) if not wanted else F.exists(
            F.array(*map(F.lit, sorted(wanted))), lambda d: (d >= F.col("first_id")) & (d <= F.col("last_id"))))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                counts = np.array(row["counts"], np.int64)
                starts = row["start"] + np.concatenate([[0], np.cumsum(counts)[:-1]])
                keep = [i for i, d in enumerate(row["doc_ids"]) if wanted is None or d in wanted]
                view = memoryview(row["payload"])
                for at in range(0, len(keep), 256):
                    part = keep[at:at + 256]
                    found = [ids(row["dictionary_sha256"], row["id_bytes"], view[row["offsets"][i]:row["offsets"][i + 1]]) for i in part]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["doc_ids"][i] for i in part], pa.int64()), pa.array(starts[part], pa.int64()),
                         pa.array(counts[part], pa.int64()), last(found)], names)

    return shards.select("start", "dictionary_sha256", "id_bytes", "doc_ids", "offsets", "counts", "payload").mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-files-{uuid.uuid4()}"


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(spark, write(common.table(spark, sf_dir, "documents"), new_folder(spark), vocabulary()))
