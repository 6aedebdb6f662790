"""Repeat groups: which passages of 100 bytes or more repeat, and where all their occurrences are.

The groups are nodes of the interval trees in `repeats`, read here with their multiplicities. Contexts of an anchor
are counted before any text is fetched; text comes only for different contexts of anchors that occur again. A group
is found under each anchor within its bytes, and under anchors that some of its occurrences lack. The first kind
is complete by itself, so the leftmost stays; the second is told by the bytes alone and left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.llm import repeats
from obsframe.session import cut_lineage, shuffle_width

NULL_KEY = -1 << 62     # keys up to here stand for a null id


def context_hash(text: memoryview, place: int) -> int:
    """Hash of the bytes around an anchor; how many are to its left counts too."""
    left = min(place, repeats.LEFT)
    return xxhash.xxh3_64_intdigest(text[place - left:place + repeats.LENGTH], left) - (1 << 63)


def anchor_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor hash, context hash, key, place) of every anchor of every text."""
    for batch in (w.slice(a, 512) for w in batches for a in range(0, w.num_rows, 512)):
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        keys = batch.column("key").to_pylist()
        for part in repeats.pieces(texts):
            rows = []
            for i, start, end in part:
                at, h = repeats.anchors(np.frombuffer(texts[i], np.uint8, end - start, start))
                at = np.unique(at)
                view = memoryview(texts[i])
                rows += [(a, context_hash(view, p), keys[i], p) for a, p in zip(h[at].view(np.int64).tolist(), (at + start).tolist())]
            # Two pieces of a long text share windows, so an anchor between them comes from both.
            columns = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor", "context", "key", "place"])


def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes around the wanted anchors of each text. Of rows that repeat an id only those with the bytes count."""
    for batch in (w.slice(a, 512) for w in batches for a in range(0, w.num_rows, 512)):
        rows = []
        for text, parts in zip(batch.column("text").to_pylist(), batch.column("parts").to_pylist()):
            data = text.encode("utf-8", "surrogatepass")
            view = memoryview(data)
            for p in parts:
                if context_hash(view, p["place"]) == p["context"]:
                    left = min(p["place"], repeats.LEFT)
                    rows.append((p["anchor"], p["context"], p["n"], left, data[p["place"] - left:p["place"] + repeats.LENGTH]))
        anchor, context, n, left, around = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in (anchor, context, n, left)), pa.array(around, pa.binary())],
            ["anchor", "context", "n", "left", "around"])


def owns(passage: bytes, place: int) -> bool:
    """Whether the anchor at `place` is one of a window within the passage, and so of all its occurrences."""
    at, _ = repeats.anchors(np.frombuffer(passage, np.uint8))
    return bool((at == place).any())


def groups_of_anchor(counts: list[int], lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
    """(bytes left of the anchor, passage, contexts) of the maximal repeats; a context that occurs again is one too."""
    found = list(repeats.maximal_repeats(lefts, rights)) if len(lefts) > 1 else []
    found += [(len(lefts[m]), len(rights[m]), [m]) for m, n in enumerate(counts) if n > 1]
    widest: dict[tuple[int, bytes], list[int]] = {}
    for left, right, members in found:
        # A context may also be a node of the tree, where others go on beyond its end.
        passage = lefts[members[0]][:left][::-1] + rights[members[0]][:right]
        if len(members) > len(widest.get((left, passage), ())):
            widest[left, passage] = members
    for (left, passage), members in widest.items():
        if owns(passage, left):
            yield left, passage, members


def windows_of_anchor(lefts: list[bytes], rights: list[bytes]) -> Iterator[tuple[int, bytes, list[int]]]:
    """The windows that have this anchor, context by context."""
    for m, (left, right) in enumerate(zip(lefts, rights)):
        around = left[::-1] + right
        at, _ = repeats.anchors(np.frombuffer(around, np.uint8))
        for start in np.flatnonzero(at == len(left)).tolist():
            yield len(left) - start, around[start:start + repeats.LENGTH], [m]


def tree_groups(limit: int):
    """Of contexts sorted by anchor: a row (group, length, left, anchor, context, n) for each context in a group.

    An anchor with more than `limit` contexts gives its windows in place of maximal repeats, also those that occur
    once; the task holds no more than `limit` contexts.
    """
    names = ["group", "length", "left", "anchor", "context", "n"]

    def rows(anchor: int, held: list[tuple], large: bool) -> Iterator[pa.RecordBatch]:
        context, n, lefts, rights = (list(c) for c in zip(*held)) if held else ([],) * 4
        found = windows_of_anchor(lefts, rights) if large else groups_of_anchor(n, lefts, rights)
        out = [(xxhash.xxh3_128_hexdigest(w), len(w), left, anchor, context[m], n[m]) for left, w, members in found for m in members]
        for a in range(0, len(out), 20_000):
            group, *numbers = zip(*out[a:a + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(group), *(pa.array(c, pa.int64()) for c in numbers)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, before, large, held = None, None, False, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("anchor", "context", "n", "left", "around"))
            for anchor, context, n, left, around in zip(*columns):
                if anchor != current:
                    yield from rows(current, held, large)
                    current, before, large, held = anchor, None, False, []
                if context == before:
                    continue  # rows that repeat id and text
                before = context
                held.append((context, n, around[:left][::-1], around[left:]))
                if len(held) > (1000 if large else limit):
                    large = True
                    yield from rows(anchor, held, True)
                    held = []
        yield from rows(current, held, large)
    return run


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = repeats.GROUP) -> DataFrame:
    """(group, length, id, lo): one row for each occurrence of each repeated passage, `lo` its first UTF-8 byte.

    `group` is a hash of the passage. A passage has 100 bytes or more and occurs at least twice, in one document
    (overlaps count) or several, and each group has all occurrences in the corpus. It cannot be made longer to a
    side without losing one, unless it ends at the bounds of its anchor's context (80 bytes left, 100 right):
    longer repeats are a chain of overlapping groups. Every 100-byte string that repeats lies in a group with the
    same number of occurrences. An anchor with over `limit` different contexts gives its 100-byte strings as groups.

    Null ids come out null; documents of a null id and equal text count as one, as do rows that repeat id and text.
    Null, empty and short texts have no rows, nor has an empty table.
    """
    width = shuffle_width(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lit(NULL_KEY) - F.shiftrightunsigned(F.xxhash64(body), 2)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), low).alias("key"), body.alias("text"))
    places = cut_lineage(rows.mapInArrow(anchor_places, "anchor bigint, context bigint, key bigint, place bigint")
                         .dropDuplicates())
    contexts = places.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "place")).alias("at"))
    again = contexts.groupBy("anchor").agg(F.sum("n").alias("m")).filter("m > 1").select("anchor")
    wanted = (contexts.join(again, "anchor", "left_semi").groupBy(F.col("at.key").alias("key"))
              .agg(F.collect_list(F.struct("anchor", "context", "n", F.col("at.place").alias("place"))).alias("parts")))
    members = cut_lineage(
        rows.join(wanted, "key").select("text", "parts")
        .mapInArrow(fetched, "anchor bigint, context bigint, n bigint, left bigint, around binary")
        .repartition(width, "anchor").sortWithinPartitions("anchor", "context")
        .mapInArrow(tree_groups(limit), "group string, length bigint, left bigint, anchor bigint, context bigint, n bigint"))
    whole = members.groupBy("group").agg(F.min("left").alias("left"), F.sum("n").alias("n")).filter("n > 1").drop("n")
    return (members.drop("n").join(whole, ["group", "left"]).join(places, ["anchor", "context"])
            .select("group", "length", F.when(F.col("key") > NULL_KEY, F.col("key")).alias(id_col), (F.col("place") - F.col("left")).alias("lo")))
