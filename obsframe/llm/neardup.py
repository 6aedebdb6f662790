"""Near-duplicate documents: one-permutation hashing with optimal densification.

Every document is reduced in one pass to a 128-bit key of its shingle set and 24 band keys of three minima each.
Documents of one set are one class from there on. Within a bucket only star edges are made, from the members to
one hub; each is confirmed on the full sets, unless both ends share a component already from the bands before.
In buckets whose members are then still in several components all pairs between components are compared. Before
that a member leaves that shares too few shingles with all other components together to be linked with any, and a
pair is made only if sizes and parity bits of the two sets allow a link; both bounds are exact. At a similarity of 0.75 two sets share no bucket with
probability (1 - 0.75^3)^24 = 2e-6, above it with less. Of two sets that fill the bins, the full sets are fetched
only if at least 32 of the 72 minima agree: at 0.75 fewer do with a probability below 3e-7.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common
from obsframe.llm.components import components
from obsframe.session import cut_lineage, ensure_checkpoint_dir, shuffle_width

WORDS, PERCENT = 5, 75
BANDS, ROWS = 24, 3
BINS = BANDS * ROWS
STEPS = (2,)        # after so many bands components are joined before the next bands make pairs
AGREE = 32          # minima that two sets of FILLED or more shingles share before their full sets are compared
FILLED = 4 * BINS
SIGNS = [f"s{i}" for i in range(8)]     # 512 bits of each set: whether an odd number of its shingles falls to each
SHARE = 2048            # members of a bucket that one task compares with the others of the bucket
SEND_IDS = 1_000_000    # ids up to this are sent to every executor (about 50 MB), more are shuffled
TOP = np.uint64(2**64 - 1)


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def donors() -> np.ndarray:
    """For every bin the order in which it asks other bins for a minimum when it has none."""
    tries = 64 * BINS
    grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(tries) + np.arange(tries, dtype=np.uint64)[None, :]
    return (mix(grid, 5) % np.uint64(BINS)).astype(np.int64)


DONORS = donors()


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the 5-word shingles of a text.

    Words are split at ASCII white space and A-Z lower-cased. Fewer than five words are one shingle; a null text
    or one without words has none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, found), np.uint64, len(found))
    width = min(len(h), WORDS)
    total = np.full(len(h) - width + 1, np.uint64(width))
    for j in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15 | 1) + h[j:len(h) - width + 1 + j]
    return np.unique(mix(total, 1))


def sketch(h: np.ndarray) -> np.ndarray:
    """The minimum of each bin; an empty bin takes that of the first non-empty bin in its own random order."""
    bins = (mix(h, 2) % np.uint64(BINS)).astype(np.int64)
    values = np.full(BINS, TOP)
    values[bins[::-1]] = h[::-1]  # ascending, so the smallest is written last
    full = np.zeros(BINS, bool)
    full[bins] = True
    if full.all():
        return values
    empty = np.flatnonzero(~full)
    source = DONORS[empty]
    open_ = full[source]
    first = open_.argmax(1)
    # A row of 64 * BINS tries without a full bin has probability below e^-64; then the smallest hash stands in.
    values[empty] = np.where(open_.any(1), values[source[np.arange(len(empty)), first]], h[0])
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key for each band; the lowest five bits are the band's number."""
    band = key = np.arange(BANDS, dtype=np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(31) + column, 3)
    return (key & ~np.uint64(31) | band).view(np.int64)


def signs(h: np.ndarray) -> np.ndarray:
    """Parity bits of a set: two sets differ in at least as many shingles as their bits differ in places."""
    odd = np.bincount((mix(h, 6) % np.uint64(64 * len(SIGNS))).astype(np.int64), minlength=64 * len(SIGNS)) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_sums(h: np.ndarray) -> tuple[int, int]:
    """128 bits over a set, as two signed words."""
    return tuple(int(mix(h, s).sum(dtype=np.uint64).view(np.int64)) for s in (7, 8))


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, one, two, bands = [], [], [], []
        for text in batch.column(1):
            h = shingles(text.as_py())
            n.append(len(h))
            a, b = set_sums(h) if len(h) else (0, 0)
            one.append(a)
            two.append(b)
            bands.append(band_keys(sketch(h)) if len(h) else np.empty(0, np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
             pa.array(bands, pa.list_(pa.int64()))], ["id", "n", "k1", "k2", "bands"])


def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(t.as_py()) for t in part.column(1)]
            # 16 bits of each minimum tell unequal ones apart but for one in 65,536.
            minima = [mix(sketch(h), 4).astype("<u2").view(np.int16) if len(h) >= FILLED else np.empty(0, np.int16) for h in sets]
            bits = np.array([signs(h) for h in sets]).T
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(h) for h in sets], pa.int64()), *(pa.array(b, pa.int64()) for b in bits),
                 pa.array(minima, pa.list_(pa.int16())),
                 pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["id", "n", *SIGNS, "minima", "items"])


def in_reach(percent: int) -> Column:
    """Whether sizes n, m and parity bits s0.., t0.. of two sets allow a link; false only where there is none."""
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(other(s)))) for s in SIGNS), F.lit(0))
    return ((F.col("n") * 100 >= percent * F.col("m")) & (F.col("m") * 100 >= percent * F.col("n"))
            & (apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)))


def other(sign: str) -> str:
    return sign.replace("s", "t")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`pairs` (u, v) that are in reach, without those of long texts whose minima agree too seldom for links."""
    left = sets.select(F.col("id").alias("u"), "n", *SIGNS, F.col("minima").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("n").alias("m"), *(F.col(s).alias(other(s)) for s in SIGNS), F.col("minima").alias("b"))
    agreeing = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x == y), lambda same: same))
    return (pairs.join(left, "u").join(right, "v").filter(in_reach(percent))
            .filter((F.size("a") == 0) | (F.size("b") == 0) | (agreeing >= AGREE)).select("u", "v"))


def linkable(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`rest` (key, id, component), with sizes, parity bits and the shares to cut their bucket into, without the
    members that no set of their bucket in another component can be alike enough to.

    What a set shares with one set of another component it shares with all of them together, so the shingles that
    stand in several components bound every intersection. A repeated id has the sets of all its texts.
    """
    held = sets.join(rest.select("id", "component").distinct(), "id").select("id", "n", "component", F.explode("items").alias("item"))
    across = held.groupBy("item").agg((F.min("component") < F.max("component")).cast("int").alias("across"))
    most = held.join(across, "item").groupBy("id", "n").agg(F.sum("across").alias("most"))
    known = rest.join(sets.select("id", "n", *SIGNS).join(most, ["id", "n"]), "id")
    least = F.greatest(F.col("least"), F.col("n") * percent / 100)
    buckets = known.groupBy("key").agg(F.min("n").alias("least"), F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
    return (known.join(buckets, "key")
            .filter(F.col("most") * (100 + percent) >= percent * (F.col("n") + least)).drop("most", "least"))


def sent(ids: DataFrame) -> DataFrame:
    """Broadcast below a stated number of rows, so that texts stay where they are; beyond, Spark shuffles."""
    return F.broadcast(ids) if ids.count() <= SEND_IDS else ids


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` (u, v) whose full sets are alike enough."""
    left = sets.select(F.col("id").alias("u"), F.col("items").alias("a"))
    right = sets.select(F.col("id").alias("v"), F.col("items").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(left, "u").join(right, "v").withColumn("both", both)
            .filter(100 * F.col("both") >= percent * (F.size("a") + F.size("b") - F.col("both"))).select("u", "v"))


def dealt(sets: DataFrame) -> tuple[DataFrame, Callable[[], object]]:
    """`sets` as a table in buckets of their id, so that the joins of every round move pairs and not sets; and what
    takes the table's name out of the catalog again. Its files lie in the shared checkpoint folder."""
    spark, name, width = sets.sparkSession, f"near_sets_{uuid.uuid4().hex}", shuffle_width(sets.sparkSession)
    (sets.repartition(width, "id").write.format("parquet").option("path", f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}")
     .bucketBy(width, "id").sortBy("id").saveAsTable(name))
    return spark.table(name), lambda: spark.sql(f"DROP TABLE {name}")


def joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """`label` (id, component) after the components that `links` (u, v) connect have become one."""
    if links.isEmpty():
        return label
    edges = (links.join(label.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u")
             .join(label.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").select("cu", "cv"))
    merged = components(edges.toDF("u", "v")).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    return cut_lineage(label.join(merged, "component", "left").select("id", F.coalesce("whole", "component").alias("component")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of `docs`.

    Documents are linked when 100 * |intersection| >= `percent` * |union| of their shingle sets. A component is
    named by its smallest id, and `kept` marks that one. Documents without words are linked with nothing. Rows
    with a null id are linked with nothing, have a null component and are kept. Repeated ids are one document
    with several texts: it is linked through each. Other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).alias("text"))
    all_ = cut_lineage(rows.mapInArrow(sketches, "id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"))
    linked = all_.filter("id IS NOT NULL AND n > 0")
    # One class for each set: thousands of exact copies meet in a map-side minimum.
    classes = cut_lineage(linked.groupBy("k1", "k2").agg(
        F.min("id").alias("rep"), F.min("n").alias("n"), F.min("bands").alias("bands")))  # equal within a class
    # A repeated id may stand for several classes: each has its own rows here.
    firsts = classes.select(F.col("rep").alias("id"), F.explode("bands").alias("key")).repartition(shuffle_width(docs.sparkSession), "key")
    hubs = firsts.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    shared = cut_lineage(firsts.join(hubs.select("key", "hub"), "key").distinct())
    wanted = cut_lineage(shared.select("id").distinct())
    bits = ", ".join(f"{s} bigint" for s in SIGNS)
    sets, forget = dealt(rows.join(sent(wanted), "id", "left_semi").mapInArrow(
        full_sets, f"id bigint, n bigint, {bits}, minima array<smallint>, items array<bigint>"))

    # Texts of one repeated id are linked through it.
    members = cut_lineage(linked.select("id", "k1", "k2").join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep").distinct())
    texts_of = members.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi")
    label = wanted.union(members.select("rep")).distinct().select("id", F.col("id").alias("component"))
    label = joined(cut_lineage(label), cut_lineage(
        members.join(texts_of, "id").filter("rep <> lo").select(F.col("rep").alias("u"), F.col("lo").alias("v"))))

    def tested(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (u, v) that are linked."""
        return cut_lineage(confirmed(cut_lineage(likely(pairs, sets, percent)), sets, percent))

    # One star for each bucket. After the first bands most copies share a component and need no further pair.
    ends = F.greatest("id", "hub").alias("u"), F.least("id", "hub").alias("v")
    stars = shared.filter("id <> hub").select(F.col("key").bitwiseAND(31).alias("band"), "id", "hub")
    for low, high in zip((0, *STEPS), (*STEPS, BANDS)):
        of_hub = label.select(F.col("id").alias("hub"), F.col("component").alias("other"))
        some = stars.filter((F.col("band") >= low) & (F.col("band") < high)).select("id", "hub").distinct()
        label = joined(label, tested(some.join(label, "id").join(of_hub, "hub").filter("component <> other").select(*ends).distinct()))

    named = shared.filter("id <> hub").select("key", "id").join(label, "id")
    mixed = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
    rest = cut_lineage(named.join(mixed.select("key"), "key", "left_semi").select("key", "id", "component"))
    if not rest.isEmpty():
        rest = cut_lineage(linkable(rest, sets, percent))
        ones = rest.withColumn("share", F.pmod(F.xxhash64("id"), F.col("shares")))
        others = rest.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), F.col("id").alias("hub"),
                             F.col("component").alias("other"), F.col("n").alias("m"), *(F.col(s).alias(other(s)) for s in SIGNS))
        pairs = ones.join(others, ["key", "share"]).filter(
            (F.col("id") > F.col("hub")) & (F.col("component") != F.col("other")) & in_reach(percent))
        label = joined(label, tested(pairs.select(*ends).distinct()))

    forget()
    named = (members.join(label.withColumnRenamed("id", "rep"), "rep", "left")
             .select("id", F.coalesce("component", "rep").alias("component")).distinct())
    return (all_.select("id", "n").join(named, "id", "left")
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                    F.coalesce("component", "id").alias("component_id"),
                    F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(True)).alias("kept")))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
