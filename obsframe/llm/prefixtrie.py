"""Prefix trie of conversations by truncation peeling.

A conversation is an array of turn hashes (128 bits of role and text, and the length of the text). The sweep starts
at the greatest depth. At each depth the conversations that end there are merged with the nodes that survive from
the depth below, whose last turn has been stripped: one map-side aggregate that discovers the nodes of this depth and
sums what their subtrees hold at once. Copies vanish in the first merge, so every level holds nodes, not conversations.

Turns below the last one that two different conversations share belong to one conversation and its copies; such a tail
is peeled off in one step. So the sweep takes as many Spark jobs as the longest shared prefix has turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.session import cut_lineage, shuffle_width

CHUNK = 1 << 16     # bytes of joined ids that travel as one row
EMPTY = hashlib.sha256(b"").hexdigest()
PATH = "array<struct<a:bigint,b:bigint,bytes:bigint>>"


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path) of every conversation; texts are hashed row by row, before the shuffle.

    Turns are ordered by number, null first; equal numbers by role and then by a hash of the text. Null roles and
    texts are empty ones. Rows without a conversation id belong to none and are left out. Repeated rows are turns
    of their own.
    """
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    step = F.struct(F.col(turn).isNotNull().alias("known"), F.col(turn).alias("turn"), who.alias("role"),
                    F.xxhash64(who, said).alias("a"), F.xxhash64(F.lit(13), said, who).alias("b"),
                    F.octet_length(said).cast("bigint").alias("bytes"))
    found = (turns.filter(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), step.alias("step"))
             .groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("steps")))
    return found.select("conv_id", F.transform("steps", lambda s: F.struct(s["a"], s["b"], s["bytes"])).cast(PATH).alias("path"))


def with_heads(paths: DataFrame, donor: Column, head: Column, most: int) -> DataFrame:
    """Conversations whose first `head` turns (at most `most`) are those of the conversation `donor`.

    All of the donor's turns if it has fewer, none if there is no such conversation; the own turns after the
    first `head` follow.
    """
    asked = paths.withColumn("_donor", donor).withColumn("_head", head.cast("int"))
    # A donor gives only the turns that somebody may ask for.
    givers = paths.select(F.col("conv_id").alias("_donor"), F.slice("path", 1, most).alias("_given"))
    given = F.slice(F.coalesce("_given", F.array().cast(PATH)), F.lit(1), F.col("_head"))
    own = F.slice("path", F.col("_head") + 1, F.greatest(F.size("path"), F.lit(1)))
    return asked.join(givers, "_donor", "left").select("conv_id", F.concat(given, own).alias("path"))


def node_id(path: Column) -> tuple[Column, Column]:
    return F.xxhash64(path), F.xxhash64(F.lit(13), path)


def joined_ids(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) from (k1, k2, conv_id): a hash of the ascending ids of each node, comma-joined.

    The ids are sorted in ranges of (node, id), so a node with many ends is spread over many tasks, and leave them
    joined into chunks. The hash itself cannot be split: one task reads a node's chunks in order, holding one.
    """
    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, held, size = None, 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([first], pa.int64()),
                 pa.array([",".join(held).encode()], pa.binary())], ["k1", "k2", "first", "chunk"])

        for batch in batches:
            for k1, k2, conv in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (k1, k2) != now or size >= CHUNK:
                    if held:
                        yield close()
                    now, first, held, size = (k1, k2), conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield close()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []
        for batch in batches:
            for k1, k2, chunk in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "chunk"))):
                if (k1, k2) == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = (k1, k2), hashlib.sha256()
                state.update(chunk)
            if len(done) > 4096:
                yield rows(done)
                done = []
        if now is not None:
            yield rows([*done, (*now, state.hexdigest())])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.string()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], ["k1", "k2", "ends_sha256"])

    width = shuffle_width(ends.sparkSession)
    ranged = ends.repartitionByRange(width, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    cut = ranged.mapInArrow(chunks, "k1 bigint, k2 bigint, first bigint, chunk binary")
    return (cut.repartition(width, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
            .mapInArrow(hashes, "k1 bigint, k2 bigint, ends_sha256 string"))


def shared_depths(ended: DataFrame) -> DataFrame:
    """(conv_id, shared) of every row of `ended` (path, conv_id): how many first turns it shares with some other row."""
    upto = lambda seed: F.transform(F.sequence(F.lit(1), F.size("path")), lambda d: F.xxhash64(F.lit(seed), F.slice("path", F.lit(1), d)))
    prefixes = cut_lineage(ended.filter(F.size("path") > 0).select(
        "conv_id", F.posexplode(F.arrays_zip(upto(1).alias("a"), upto(2).alias("b")))).select(
        "conv_id", (F.col("pos") + 1).alias("depth"), F.col("col.a").alias("a"), F.col("col.b").alias("b")))
    common_ones = (prefixes.groupBy("a", "b").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
                   .filter("lo < hi").select("a", "b"))
    return prefixes.join(common_ones, ["a", "b"]).groupBy("conv_id").agg(F.max("depth").alias("shared"))


def trie(paths: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the given (conv_id, path), from the root (depth 0) down.

    conv_id is the smallest member, parent_conv_id the parent's (null for the root), n_convs the number of members,
    n_children that of child nodes, n_leaves that of nodes without children in the subtree, saved_tokens the sum
    over the subtree of (n_convs - 1) times the bytes of a node's last text, ends_sha256 the hash of the ids that
    end at the node. Conversation ids must be distinct. Without conversations the result is empty.
    """
    paths = cut_lineage(paths)
    # Whole conversations that are equal are one row from here on.
    whole = cut_lineage(paths.groupBy("path").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")))
    ended = cut_lineage(whole.join(shared_depths(whole), "conv_id", "left").select(
        "path", "conv_id", "n_convs", F.size("path").alias("depth"), F.coalesce("shared", F.lit(0)).alias("shared")))
    deepest = ended.agg(F.max("shared")).first()[0]
    if deepest is None:
        return paths.sparkSession.createDataFrame([], (
            "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
            "saved_tokens bigint, ends_sha256 string"))
    sums = "n_convs", "n_children", "n_leaves", "saved_tokens"
    below = lambda first: (F.col("n_convs") - 1) * F.aggregate(
        F.slice("path", first, F.greatest(F.col("depth"), F.lit(1))), F.lit(0).cast("bigint"), lambda s, t: s + t["bytes"])
    kept = lambda n: F.slice("path", F.lit(1), n)
    number = lambda n: F.lit(n).cast("bigint")
    tail = F.col("depth") > F.col("shared")
    # What is left of each conversation where others join it: the end itself, or the stump of its tail.
    stumps = cut_lineage(ended.select(
        "shared", kept(F.col("shared")).alias("path"), "conv_id", "n_convs", F.when(tail, 1).otherwise(0).cast("bigint").alias("n_children"),
        F.when(tail, 1).otherwise(0).cast("bigint").alias("n_leaves"),
        F.when(tail, below(F.col("shared") + 1)).otherwise(0).cast("bigint").alias("saved_tokens")))
    levels, above = [], None
    for depth in range(deepest, -1, -1):
        nodes = stumps.filter(F.col("shared") == depth).drop("shared")
        if above is not None:
            nodes = nodes.unionByName(above.select(
                kept(F.lit(depth)).alias("path"), "conv_id", "n_convs", number(1).alias("n_children"), "n_leaves", "saved_tokens"))
        again = (F.col("n_convs") - 1) * F.element_at("path", -1)["bytes"] if depth else F.lit(0)
        above = cut_lineage(nodes.groupBy("path").agg(F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums))
                            .withColumn("n_leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("bigint"))
                            .withColumn("saved_tokens", (F.col("saved_tokens") + again).cast("bigint")))
        levels.append(named(above, number(depth), F.col("path"), kept(F.lit(max(depth - 1, 0))), sums))
    top = above.first()["conv_id"]
    nodes = levels[0]
    for level in levels[1:]:
        nodes = nodes.unionByName(level)
    tails = named(ended.filter(tail).withColumn("d", F.explode(F.sequence(F.col("shared") + 1, F.col("depth"))))
                  .withColumns({"n_children": (F.col("d") < F.col("depth")).cast("bigint"), "n_leaves": number(1),
                                "saved_tokens": below(F.col("d")).cast("bigint")}),
                  F.col("d").cast("bigint"), kept(F.col("d")), kept(F.col("d") - 1), sums, "shared", "d")
    # Inside a tail the parent is the same conversation's; the root needs no join either. The children of another hot
    # parent lie in one join partition, which AQE splits.
    inner = tails.filter("d > shared + 1").drop("shared", "d").withColumn("parent_conv_id", F.col("conv_id"))
    rest = nodes.unionByName(tails.filter("d = shared + 1").drop("shared", "d"))
    parents = nodes.filter("depth > 0 AND n_children > 0").select(
        F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    low = rest.filter("depth > 1").join(parents, ["p1", "p2"])
    high = rest.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top)).cast("bigint"))
    k1, k2 = node_id(F.col("path"))
    hashes = joined_ids(paths.select(k1.alias("k1"), k2.alias("k2"), "conv_id"))
    return (high.unionByName(low).unionByName(inner).join(hashes, ["k1", "k2"], "left")
            .select("conv_id", "depth", "parent_conv_id", *sums, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")))


def named(df: DataFrame, depth: Column, path: Column, parent: Column, sums: tuple[str, ...], *more: str) -> DataFrame:
    """Nodes with 128-bit names of their own and their parent's prefix in place of the arrays."""
    (k1, k2), (p1, p2) = node_id(path), node_id(parent)
    return df.select(depth.alias("depth"), k1.alias("k1"), k2.alias("k2"), p1.alias("p1"), p2.alias("p2"), "conv_id", *sums,
                     *(F.col(c).alias(c) for c in more))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of `conversations` after each has taken its first turns from the first of its five."""
    c = F.col("conv_id")
    head = F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(9))
    return trie(with_heads(sequences(common.table(spark, sf_dir, "conversations")), c - c % 5, head, 8))
