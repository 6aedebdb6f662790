"""Repeated passages by suffix arrays: common-prefix interval trees over anchored suffixes.

Only some suffixes are looked at: a 100-byte window is represented by the smallest of its 20-byte hashes, so two
equal windows have their anchor at the same place. An anchor's context is what any window with this anchor can
hold: 80 bytes to the left, 100 to the right. Equal contexts are settled by their hashes, first within a batch and
then in a sorted shuffle, so copies by the thousand never meet as text. The different contexts of an anchor are
fetched and their suffixes sorted; a stack scan of the common prefixes gives the interval tree, and within an
interval a second one over the reversed left sides tells where occurrences differ to the left. What differs on
both sides is a maximal repeat, and all its occurrences are known. Longer repeats come as a chain of contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.llm.neardup import mix
from obsframe.session import shuffle_width

LENGTH = 100
GRAM = 20
LEFT = LENGTH - GRAM        # a window starts at most so far before its anchor
CHUNK = 1 << 19             # bytes hashed at once
GROUP = 50_000              # different contexts of an anchor that one task sorts (9 MB); beyond, windows are compared by hash
PLACE = (1 << 31) - 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hashes of the 20-byte pieces at all places, by doubling."""
    h = mix(np.arange(256, dtype=np.uint64), 21)[data]
    four = None
    for width in (1, 2, 4, 8):
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + h[width:]
        if width == 2:
            four = h
    n = len(data) - GRAM + 1
    return mix(h[:n] * np.uint64(0xD6E8FEB86659FD93) + four[16:16 + n], 22)


def window_minima(values: np.ndarray) -> np.ndarray:
    """The minimum of every 81 neighbours."""
    m = values
    for width in (1, 2, 4, 8, 16, 32):
        m = np.minimum(m[:-width], m[width:])
    rest = LENGTH - GRAM + 1 - 64
    return np.minimum(m[:-rest], m[rest:])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor of each 100-byte window, hash of the 20 bytes at each place); of equal hashes the rightmost is the anchor."""
    h = gram_hashes(data)
    ranked = (h & ~np.uint64(PLACE)) | (np.uint64(PLACE) - np.arange(len(h), dtype=np.uint64))
    return (PLACE - (window_minima(ranked) & np.uint64(PLACE)).astype(np.int64)), h


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, from, to) with about CHUNK bytes. Every window of a long text is within one of its pieces."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for start in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
            end = min(len(text), start + CHUNK + LENGTH - 1)
            held.append((i, start, end))
            size += end - start
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def found_in(keys: np.ndarray, texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, context hash, key, packed place) of the first occurrence of each context, and spans of others.

    Packed: place, bytes to the left and to the right of the context. A span row has minus its end there, and its
    start as context hash.
    """
    full = np.array([len(t) for t in texts])
    for part in pieces(texts):
        data = np.frombuffer(b"".join(texts[i][a:b] for i, a, b in part), np.uint8)
        owner = np.array([i for i, _, _ in part])
        sizes = np.array([b - a for _, a, b in part])
        ends = np.cumsum(sizes)
        at, h = anchors(data)
        which = np.repeat(np.arange(len(part)), sizes)[:len(at)]
        at, which = at[np.arange(len(at)) + LENGTH <= ends[which]], which[np.arange(len(at)) + LENGTH <= ends[which]]
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        at, which = at[new], which[new]
        text_of = owner[which]
        place = at - (ends - sizes)[which] + np.array([a for _, a, _ in part])[which]
        left, right = np.minimum(place, LEFT), np.minimum(full[text_of] - place, LENGTH)
        digest = xxhash.xxh3_64_intdigest
        views = {i: memoryview(texts[i]) for i in set(owner.tolist())}
        context = np.fromiter((digest(views[t][p - a:p + b], a) for t, p, a, b in zip(
            text_of.tolist(), place.tolist(), left.tolist(), right.tolist())), np.uint64, len(at)).view(np.int64)
        anchor = h[at].view(np.int64)
        key = keys[text_of]
        order = np.lexsort((place, key, context, anchor))
        anchor, context, key, place, left, right = (x[order] for x in (anchor, context, key, place, left, right))
        first = np.ones(len(anchor), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
        yield anchor[first], context[first], key[first], (place << 16 | left << 8 | right)[first]
        k, lo, hi = merged(key[~first], (place - left)[~first], (place + right)[~first])
        yield mix(k.view(np.uint64), 23).view(np.int64), lo, k, -hi


def merged(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of spans, key by key; spans that touch are one."""
    if not len(key):
        return key, lo, hi
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    fresh = np.concatenate([[True], key[1:] != key[:-1]])
    room = np.cumsum(fresh) * (1 << 32)
    reach = np.maximum.accumulate(hi + room)
    start = np.concatenate([[True], (lo + room)[1:] > reach[:-1]])
    last = np.concatenate([start[1:], [True]])
    return key[start], lo[start], (reach - room)[last]


def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            texts = [t.encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            for columns in found_in(np.asarray(part.column("key"), np.int64), texts):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "context", "key", "place"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context, key and place: spans of contexts seen before, and wanted contexts of
    anchors that have several. Only the row before is remembered between batches."""
    def rows(key, wanted, x, y) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), wanted)), pa.array(x), pa.array(y)],
                                          ["key", "wanted", "x", "y"])

    before = None   # the last row: anchor, context, key, place
    pending = None  # the last first occurrence, and whether it was given out
    for batch in batches:
        anchor, context, key, place = (np.asarray(batch.column(c), np.int64) for c in ("anchor", "context", "key", "place"))
        span = place < 0
        yield rows(key[span], False, context[span], -place[span])
        anchor, context, key, place = (x[~span] for x in (anchor, context, key, place))
        if not len(anchor):
            continue
        last = before or (anchor[0] + 1 if anchor[0] < 0 else anchor[0] - 1, 0, 0, 0)
        prior = [np.concatenate([[p], x[:-1]]) for p, x in zip(last, (anchor, context, key, place))]
        same = (prior[0] == anchor) & (prior[1] == context)
        twice = same & (prior[2] == key) & (prior[3] == place)
        again = same & ~twice
        at, left, right = place >> 16, place >> 8 & 255, place & 255
        yield rows(*[x for x in (key[again],)], False, (at - left)[again], (at + right)[again])
        before = (anchor[-1], context[-1], key[-1], place[-1])
        head = np.flatnonzero(~same)
        if not len(head):
            continue
        a, k, p = anchor[head], key[head], place[head]
        given = np.zeros(len(a), bool)
        if pending is not None:
            a, k, p = (np.concatenate([[q], x]) for q, x in zip(pending, (a, k, p)))
            given = np.concatenate([[pending[3]], given])
        several = np.zeros(len(a), bool)
        several[1:] |= a[1:] == a[:-1]
        several[:-1] |= a[1:] == a[:-1]
        several[0] |= given[0]
        out = several & ~given
        yield rows(k[out], True, a[out], p[out])
        pending = (a[-1], k[-1], p[-1], bool(several[-1]))


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they come, and the text around wanted anchors."""
    for whole in batches:
        for first in range(0, whole.num_rows, 512):
            batch = whole.slice(first, 512)
            lists = batch.column("parts")
            row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
            parts = lists.flatten()
            wanted = np.asarray(parts.field("wanted").cast(pa.int8())).astype(bool)
            x, y = np.asarray(parts.field("x"), np.int64), np.asarray(parts.field("y"), np.int64)
            keys = np.asarray(batch.column("key"), np.int64)
            k, lo, hi = merged(keys[row][~wanted], x[~wanted], y[~wanted])
            row, x, y = row[wanted], x[wanted], y[wanted]
            at, left, right = y >> 16, y >> 8 & 255, y & 255
            texts = {r: batch.column("text")[r].as_py().encode("utf-8", "surrogatepass") for r in set(row.tolist())}
            around = [texts[r][p - a:p + b] for r, p, a, b in zip(row.tolist(), at.tolist(), left.tolist(), right.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([mix(k.view(np.uint64), 24).view(np.int64), x])), pa.array(np.concatenate([k, keys[row]])),
                 pa.array(np.concatenate([lo, at])), pa.array(np.concatenate([hi, left])),
                 pa.array([*[None] * len(k), *around], pa.binary())], ["anchor", "key", "lo", "hi", "context"])


def intervals(prefix: list[int]) -> Iterator[tuple[int, int, int]]:
    """(from, to, common prefix) of all nodes of the interval tree with two or more suffixes, by one stack scan.

    `prefix[i]` is the common prefix of the suffixes i and i + 1; `to` is exclusive.
    """
    stack: list[tuple[int, int]] = []
    for i, value in enumerate([*prefix, -1]):
        start = i
        while stack and stack[-1][1] > value:
            start, depth = stack.pop()
            yield start, i + 1, depth
        if value >= 0 and (not stack or stack[-1][1] < value):
            stack.append((start, value))


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7 >> 3)


def sorted_prefixes(parts: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of byte strings and the common prefix of neighbours in it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    return order, [common_prefix(parts[i], parts[j]) for i, j in zip(order, order[1:])]


def maximal_repeats(lefts: list[bytes], rights: list[bytes], least: int = LENGTH) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes left, bytes right, occurrences) of all repeats of `least` bytes or more around a shared anchor that
    can be extended to neither side without losing an occurrence. `lefts` are reversed."""
    if len(rights) == 2:
        left, right = common_prefix(*lefts), common_prefix(*rights)
        if left + right >= least:
            yield left, right, [0, 1]
        return
    order, prefix = sorted_prefixes(rights)
    rank = [0] * len(lefts)
    for i, m in enumerate(sorted(range(len(lefts)), key=lefts.__getitem__)):
        rank[m] = i
    for start, end, right in intervals(prefix):
        members = order[start:end]
        # Children of the node: occurrences of one child go on alike to the right.
        child = np.cumsum([0, *(p == right for p in prefix[start:end - 1])]).tolist()
        child_of = dict(zip(members, child))
        members.sort(key=rank.__getitem__)
        left_prefix = [common_prefix(lefts[x], lefts[y]) for x, y in zip(members, members[1:])]
        for a, b, left in intervals(left_prefix):
            if left + right < least:
                continue
            group = members[a:b]
            if len({child_of[m] for m in group}) > 1:
                yield left, right, group


def group_spans(keys: list[int], places: list[int], lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of what maximal repeats cover at occurrences but their first. All hold the anchor, so what
    they cover at one is one span."""
    reach: dict[int, tuple[int, int]] = {}
    for left, right, group in maximal_repeats(lefts, rights):
        first = min(group, key=lambda m: (keys[m], places[m]))
        for m in group:
            if m != first:
                a, b = reach.get(m, (0, 0))
                reach[m] = (max(a, left), max(b, right))
    for m, (left, right) in reach.items():
        yield keys[m], places[m] - left, places[m] + right


def windows_of(keys: list[int], places: list[int], lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(key, start, hash) of all 100-byte windows around anchors."""
    for key, place, left, right in zip(keys, places, lefts, rights):
        text = left[::-1] + right
        for i in range(len(text) - LENGTH + 1):
            yield key, place - len(left) + i, xxhash.xxh3_64_intdigest(text[i:i + LENGTH]) - (1 << 63)


def tree_spans(limit: int):
    """Spans of the groups of each anchor, as rows (key, lo, hi, window null). A group beyond `limit` gives its windows
    instead, as rows (key, lo, null, hash); of equal windows within a thousand contexts only the first goes on."""
    names = ["spread", "key", "lo", "hi", "window"]

    def spans_of(found: list[tuple]) -> pa.RecordBatch:
        k, lo, hi = merged(*(np.array(c, np.int64) for c in zip(*found))) if found else (np.empty(0, np.int64),) * 3
        return pa.RecordBatch.from_arrays([pa.array(mix(k.view(np.uint64), 25).view(np.int64)), pa.array(k), pa.array(lo), pa.array(hi),
                                           pa.nulls(len(k), pa.int64())], names)

    def windows(group: tuple[list, ...]) -> Iterator[pa.RecordBatch]:
        first: dict[int, tuple[int, int]] = {}
        again = []
        for key, start, h in sorted(windows_of(*group)):
            if first.setdefault(h, (key, start)) != (key, start):
                again.append((key, start, start + LENGTH))
        yield spans_of(again)
        k, lo = (np.array(c, np.int64) for c in zip(*first.values())) if first else (np.empty(0, np.int64),) * 2
        h = np.array(list(first), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(k), pa.array(lo), pa.nulls(len(k), pa.int64()), pa.array(h)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple[list, ...] = ([], [], [], [])
        current, large, out = None, False, []
        for batch in batches:
            settled = pc.is_null(batch.column("context"))
            spans = batch.filter(settled)
            k = np.asarray(spans.column("key"), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(k.view(np.uint64), 25).view(np.int64)), *(spans.column(c) for c in ("key", "lo", "hi")),
                                              pa.nulls(len(k), pa.int64())], names)
            rest = batch.filter(pc.invert(settled)).to_pydict()
            for anchor, key, place, left, text in zip(*(rest[c] for c in ("anchor", "key", "lo", "hi", "context"))):
                if anchor != current:
                    if large:
                        yield from windows(group)
                    else:
                        out.extend(group_spans(*group))
                    if len(out) > 20_000:
                        yield spans_of(out)
                        out = []
                    current, large, group = anchor, False, ([], [], [], [])
                for column, value in zip(group, (key, place, text[:left][::-1], text[left:])):
                    column.append(value)
                if len(group[0]) >= (1000 if large else limit):
                    large = True
                    yield from windows(group)
                    group = ([], [], [], [])
        if large:
            yield from windows(group)
        else:
            out.extend(group_spans(*group))
        yield spans_of(out)
    return run


def later_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans as they come; of windows sorted by hash, key and place, spans of all but the first of each hash."""
    before = None
    for batch in batches:
        span = np.asarray(pc.is_null(batch.column("window")).cast(pa.int8())).astype(bool)
        key, lo = (np.asarray(batch.column(c), np.int64) for c in ("key", "lo"))
        hi = np.asarray(pc.fill_null(batch.column("hi"), 0), np.int64)
        h = np.asarray(pc.fill_null(batch.column("window"), 0), np.int64)[~span]
        again = np.zeros(len(h), bool)
        if len(h):
            # A window comes once for each anchor near it: it is no repeat of itself.
            k, x = key[~span], lo[~span]
            if before is not None:
                h, k, x = (np.concatenate([[b], c]) for b, c in zip(before, (h, k, x)))
            head = np.maximum.accumulate(np.where(np.concatenate([[True], h[1:] != h[:-1]]), np.arange(len(h)), 0))
            other = (k != k[head]) | (x != x[head])
            again = other[len(other) - len(again):]
            before = (h[-1], k[head[-1]], x[head[-1]])
        k, a, b = merged(np.concatenate([key[span], key[~span][again]]), np.concatenate([lo[span], lo[~span][again]]),
                         np.concatenate([hi[span], lo[~span][again] + LENGTH]))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(a), pa.array(b)], ["key", "lo", "hi"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (w.slice(a, 512) for w in batches for a in range(0, w.num_rows, 512)):
        out = []
        for r in range(batch.num_rows):
            text = (batch.column("text")[r].as_py() or "").encode("utf-8", "surrogatepass")
            parts = batch.column("spans").slice(r, 1).flatten()
            lo, hi = np.asarray(parts.field("lo"), np.int64), np.asarray(parts.field("hi"), np.int64)
            _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, np.minimum(hi, len(text)))
            kept = hashlib.sha256()
            end = 0
            for a, b in zip(lo.tolist(), hi.tolist()):
                kept.update(text[end:a])
                end = b
            kept.update(text[end:])
            out.append((len(text), int((hi - lo).sum()), len(lo), kept.hexdigest(), list(zip(lo.tolist(), hi.tolist()))))
        n, removed, spans, digest, where = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
             pa.array(digest, pa.string()),
             pa.array([[{"lo": a, "hi": b} for a, b in w] for w in where], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
            ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", group: int = GROUP) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, spans) of every row of `docs`.

    A byte is removed when a 100-byte string that covers it also starts earlier: in a document of smaller id or at
    an earlier place of the same one. Spans are maximal runs [lo, hi) of UTF-8 bytes. Ids should be unique: rows
    that repeat one get the spans of all of them. A null id stands for the text's hash and comes before all ids;
    null texts are empty ones, and texts under 100 bytes keep everything.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lit(-1 << 62) - F.shiftrightunsigned(F.xxhash64(body), 2)
    rows = (docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(id_col).cast("bigint"), low).alias("key"), body.alias("text")))
    width = shuffle_width(docs.sparkSession)
    # The text is dealt out once; both joins read the same shuffle.
    dealt = rows.repartition(width, "key")
    found = (rows.select("key", "text").mapInArrow(anchor_rows, "anchor bigint, context bigint, key bigint, place bigint")
             .repartition(width, "anchor").sortWithinPartitions("anchor", "context", "key", "place")
             .mapInArrow(settle, "key bigint, wanted boolean, x bigint, y bigint"))
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("wanted", "x", "y")).alias("parts"))
    around = dealt.join(per_text, "key").select("doc", "key", "text", "parts").mapInArrow(
        contexts, "anchor bigint, key bigint, lo bigint, hi bigint, context binary")
    spans = (around.repartition(width, "anchor").sortWithinPartitions("anchor", "key", "lo")
             .mapInArrow(tree_spans(group), "spread bigint, key bigint, lo bigint, hi bigint, window bigint")
             .repartition(width, "spread").sortWithinPartitions("window", "key", "lo")
             .mapInArrow(later_windows, "key bigint, lo bigint, hi bigint"))
    of_text = spans.groupBy("key").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
    return (dealt.join(of_text, "key", "left").select("doc", "text", F.coalesce("spans", none).alias("spans"))
            .mapInArrow(cut_out, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
                                 "spans array<struct<lo:bigint,hi:bigint>>")
            .withColumnRenamed("doc", id_col))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(common.table(spark, sf_dir, "documents")).drop("spans")
