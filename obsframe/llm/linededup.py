"""Fuzzy line deduplication by MinHash, with built-in functions only.

Equal lines are one class. The pieces (eight characters in the query) of a line are hashed as rows; the low bits
of a hash pick one of 19 bands, and each band keeps its least hash, its greatest and the least in a third order,
which make one key. Of lines that share a bucket, each of 12 groups of pieces also marks them in 64 bits. Members of a bucket are
paired with the smallest line of the bucket, and once links are united, in buckets that still hold several components,
all members of different components, of which 4,096 bits are then made too. The bits are an
exact bound: pairs that they tell apart are no links. All others are confirmed by the Jaccard similarity of the whole
sets of pieces, and confirmed links are united.
At a similarity of 0.75 two lines share no bucket with probability (1 - 0.75^3)^19 = 3e-5.
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.llm import common
from obsframe.llm.components import components
from obsframe.session import cut_lineage, ensure_checkpoint_dir, held, shuffle_width, shuffles_dropped

SHINGLE = 8             # of the query and of without_repeats: one edit inside a line of 63 characters still links
WIDE = 12               # unless the caller of fuzzy_lines says otherwise
PERCENT = 75
BUCKETS = 19            # bands of a line, each with one key
TURN = 0x5A5A5A5A5A5A5A5A  # a third order of hashes: the least of them with these bits turned begins unlike the least and the greatest
BINS = 24
BANDS = [f"{i:02}" for i in range(BINS // 2)]
SHARE = 2048            # members of a bucket that one task compares with the others of the bucket
SEND_ROWS = 1_000_000   # keys or lines up to this are sent to every executor (about 50 MB), more are shuffled


# Groups that an aggregate keeps in its first table, as a power of two; only for the one step that groups pieces, as each task sets the table up.
GROUPS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def piece(wide: Column, at: Column, k: int) -> Column:
    """The hash of `k` characters from byte `at` on. `wide` has four bytes for each, so that no line is walked."""
    return F.xxhash64(F.substring(wide, at, F.lit(4 * k)))


def places(wide: Column, k: int) -> Column:
    """The bytes, counted from 1, where the pieces of a line begin; a shorter line is one piece."""
    return F.sequence(F.lit(1), F.greatest(F.length(wide) - (4 * k - 1), F.lit(1)), F.lit(4))


def shingle_hashes(line: Column, k: int) -> Column:
    """Hashes of all `k`-character pieces of a line; a shorter line is one piece, null and empty lines too."""
    return common.let(F.encode(F.coalesce(line, F.lit("")), "UTF-32"), lambda b: F.transform(places(b, k), lambda at: piece(b, at, k)))


def pieces_of(texts: DataFrame, k: int, *columns: str) -> DataFrame:
    """(node, columns, h) of lines (node, norm, columns): the hash of each piece as a row."""
    return (texts.select("node", *columns, F.encode("norm", "UTF-32").alias("wide"))
            .select("node", *columns, "wide", F.explode(places(F.col("wide"), k)).alias("at"))
            .select("node", *columns, piece(F.col("wide"), F.col("at"), k).alias("h")))


def bin_of() -> Column:
    return F.pmod("h", F.lit(BINS))


def band_keys(texts: DataFrame, k: int) -> DataFrame:
    """(node, key) of lines (node, norm): a row for each band with pieces."""
    band = F.shiftrightunsigned(F.col("h").bitwiseAND((1 << 31) - 1) * F.lit(BUCKETS).cast("bigint"), 31).cast("int")
    return (pieces_of(texts, k).groupBy("node", band.alias("band"))
            .agg(F.min("h").alias("least"), F.max("h").alias("most"), F.min(F.col("h").bitwiseXOR(F.lit(TURN))).alias("turned"))
            .select("node", F.xxhash64("band", "least", "most", "turned").alias("key")))


def sketches(texts: DataFrame, k: int) -> DataFrame:
    """(node, n, s00..) of lines (node, norm): the number of pieces, and for each band 64 bits, of which each piece
    of the band sets one."""
    bit = F.expr("shiftleft(1L, cast(shiftrightunsigned(h, 6) & 63 as int))")
    of = lambda i: F.bit_or(F.when(F.shiftright(bin_of(), 1) == i, bit))
    return pieces_of(texts, k).groupBy("node").agg(
        F.count(F.lit(1)).alias("n"), *(F.coalesce(of(i), F.lit(0).cast("bigint")).alias(f"s{b}") for i, b in enumerate(BANDS)))


def wider(texts: DataFrame, k: int) -> DataFrame:
    """(node, words) of lines (node, norm): 4,096 bits as an array of 64 numbers, of which each piece sets one."""
    word = F.shiftrightunsigned("h", 12).bitwiseAND(63).cast("int").alias("word")
    bits = pieces_of(texts, k).groupBy("node", word).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(h, 6) & 63 as int)))").alias("bits"))
    at = bits.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("at"))
    return at.select("node", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.col("at")[i], F.lit(0).cast("bigint"))).alias("words"))


SIGNS = [f"s{b}" for b in BANDS]


def other(sign: str) -> str:
    return sign.replace("s", "t")


def in_reach(percent: int) -> Column:
    """Whether piece counts n, m and bits s00.., t00.. of two lines allow a link; false only where there is none.

    Each bit that one line alone sets stands for a piece that it alone has, and counts are no smaller than sets.
    """
    apart = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(other(s)))) for s in SIGNS), F.lit(0))
    return apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def wide_in_reach(percent: int) -> Column:
    """As `in_reach`, by the arrays x and y of `wider`."""
    apart = F.aggregate(F.zip_with("x", "y", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda all_, one: all_ + one)
    return apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def normal(line: Column) -> Column:
    """What is compared: lower case, without white space at the ends. The trim walks a line, so it is left out where nothing is to trim."""
    space = " \t\r\x0b\f"
    loose = reduce(or_, (end for c in space for end in (line.startswith(c), line.endswith(c))))
    return F.lower(F.when(loose, F.btrim(line, F.lit(space))).otherwise(line))


def lines_of(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, line_no, line) of every line, counted from 0; a null text has none, an empty text one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def alike(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(u, v, same) of `pairs`: whether their shingle sets are alike enough. Lines travel as text, an eighth of their sets."""
    left = texts.select(F.col("node").alias("u"), F.col("norm").alias("a"))
    right = texts.select(F.col("node").alias("v"), F.col("norm").alias("b"))
    # A filter would have each set made again wherever it is named.
    sets = (pairs.join(left, "u").join(right, "v")
            .select("u", "v", *(shingle_hashes(F.col(c), shingle).alias(c) for c in "ab")))
    return sets.select("u", "v", (100 * F.size(F.array_intersect("a", "b")) >= percent * F.size(F.array_union("a", "b"))).alias("same"))


def stored(df: DataFrame) -> DataFrame:
    """`df` as Parquet files in the shared checkpoint folder, which take a fraction of what a checkpoint of it does."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/lines-{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent(df: DataFrame) -> DataFrame:
    """Broadcast below a stated number of rows; beyond, Spark shuffles."""
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


def labelled(docs: DataFrame, id_col: str, text: str, percent: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, line_no, node, place) of every line, blank ones without a node, and (node, component) of linked nodes. Both are stored."""
    split = lines_of(docs, id_col, text).withColumn("norm", normal(F.col("line")))
    place = (F.coalesce(F.col("doc_id"), F.lit(-1 << 62)).cast("decimal(38,0)") * (1 << 31) + F.col("line_no")).cast("decimal(38,0)")
    hashed = F.xxhash64("norm").alias("node")
    different = split.filter("norm <> ''").select(hashed, "norm").groupBy("node").agg(F.first("norm").alias("norm"))
    keyed = band_keys(different, shingle).repartition(shuffle_width(docs.sparkSession), "key")
    bucket = Window.partitionBy("key")
    # What stays are buckets of different lines.
    with held(docs.sparkSession, GROUPS, "20"):
        shared = stored(keyed.withColumns({"hub": F.min("node").over(bucket), "last": F.max("node").over(bucket)})
                        .filter("hub < last AND node <> hub").select("key", "node", "hub"))
    # Bits and texts of all others are never asked for.
    members = cut_lineage(shared.select("node").union(shared.select("hub")).distinct()).select(F.col("node").alias("asked"))
    # Blank lines ask by their place, for else they would all meet in one task.
    asks = F.when(F.col("norm") != "", F.xxhash64("norm")).otherwise(F.xxhash64("doc_id", "line_no"))
    every = stored(split.withColumn("asks", asks).join(sent(members), F.col("asks") == F.col("asked"), "left").select(
        "doc_id", "line_no", F.when(F.col("norm") != "", F.col("asks")).alias("node"), F.when(F.col("asked").isNotNull(), F.col("norm")).alias("norm")))
    lines = every.select("doc_id", "line_no", "node").withColumn("place", place)
    known = stored(every.filter("node IS NOT NULL AND norm IS NOT NULL").groupBy("node").agg(F.first("norm").alias("norm")))
    bits = stored(sketches(known, shingle))
    left = bits.withColumnRenamed("node", "u")
    right = bits.select(F.col("node").alias("v"), F.col("n").alias("m"), *(F.col(s).alias(other(s)) for s in SIGNS))

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = cut_lineage(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
        return known.join(sent(wanted), "node", "left_semi")

    def near(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (u, v, n, m) that 4,096 bits do not tell apart. For many pairs of few lines."""
        pairs = cut_lineage(pairs)
        words = cut_lineage(wider(texts_of(pairs), shingle))
        return (pairs.join(words.toDF("u", "x"), "u").join(words.toDF("v", "y"), "v")
                .filter(wide_in_reach(percent)).select("u", "v"))

    def tested(pairs: DataFrame) -> DataFrame:
        """Those of `pairs` (u, v) that are linked."""
        pairs = cut_lineage(pairs)
        return cut_lineage(alike(pairs, texts_of(pairs), percent, shingle)).filter("same").select("u", "v")

    star = shared.select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct()
    links = tested(star.join(left, "u").join(right, "v").filter(in_reach(percent)).select("u", "v"))
    label = cut_lineage(components(links))
    named = (shared.select("key", "node").join(label, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    mixed = (named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.ceil(F.count(F.lit(1)) / SHARE).alias("shares"))
             .filter("lo < hi").select("key", "shares"))
    rest = cut_lineage(named.join(mixed, "key"))
    if not rest.isEmpty():
        rest = rest.join(bits, "node")
        ones = rest.withColumn("share", F.pmod(F.xxhash64("node"), F.col("shares"))).withColumnRenamed("node", "u")
        others = rest.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("share"), F.col("node").alias("v"),
                             F.col("component").alias("other"), F.col("n").alias("m"), *(F.col(s).alias(other(s)) for s in SIGNS))
        fresh = tested(near(ones.join(others, ["key", "share"]).filter(
            (F.col("u") > F.col("v")) & (F.col("component") != F.col("other")) & in_reach(percent)).select("u", "v", "n", "m").distinct()))
        if not fresh.isEmpty():
            label = cut_lineage(components(links.union(fresh)))
    return lines, label


def fuzzy_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT,
                shingle: int = WIDE) -> DataFrame:
    """(doc_id, line_no, kept, first_doc_id, first_line_no) of every line of every document.

    Lines are linked when 100 * |intersection| >= `percent` * |union| of their sets of pieces of `shingle`
    characters, compared in lower case and without white space at the ends. Of a component only its first line, in order of (doc_id, line_no),
    is kept; `first_*` name it. Blank lines are all kept. Null ids come before all others. Lines are told apart by
    64-bit hashes: among a billion different lines, two share one with probability 3 %.
    """
    with shuffles_dropped(docs.sparkSession):
        lines, label = labelled(docs, id_col, text, percent, shingle)
    nodes = lines.filter("node IS NOT NULL").groupBy("node").agg(F.min("place").alias("first"))
    named = nodes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = named.groupBy("component").agg(F.min("first").alias("first"))
    first_of = named.select("node", "component").join(firsts, "component").select("node", "first")
    out = lines.join(first_of, "node", "left").withColumn("first", F.coalesce("first", "place"))
    line_no = F.pmod("first", F.lit(1 << 31).cast("decimal(38,0)"))
    doc = ((F.col("first") - line_no) / (1 << 31)).cast("bigint")
    own = F.col("place") == F.col("first")
    return out.select(
        "doc_id", "line_no", own.alias("kept"),
        F.when(own, F.col("doc_id")).otherwise(F.when(doc != -1 << 62, doc)).alias("first_doc_id"),
        F.when(own, F.col("line_no")).otherwise(line_no.cast("int")).alias("first_line_no"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with repeated lines cut out of the text. Ids must be unique; a document of repeats alone becomes empty."""
    gone = (fuzzy_lines(docs, id_col, text, shingle=SHINGLE).filter(~F.col("kept")).groupBy("doc_id")
            .agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_doc"))
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone", i))
    return (docs.join(gone, F.col(id_col).eqNullSafe(F.col("_doc")), "left")
            .withColumn(text, F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n")))
            .drop("_doc", "_gone"))


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines(common.table(spark, sf_dir, "documents"), shingle=SHINGLE)
