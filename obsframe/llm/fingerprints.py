"""Winnowed document fingerprints, with built-in functions only.

Rolling hashes of `k` consecutive words are cut down to the minimum of every `window` neighbouring hashes; of
equal minima the rightmost is kept. Two texts that share a run of `window + k - 1` words always share a
fingerprint, and its positions say where.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from obsframe.llm import common

K, WINDOW = 4, 8
PLACE = (1 << 30) - 1  # a text has fewer words than this


def winnow(text: Column, k: int = K, window: int = WINDOW) -> Column:
    """array<struct<hash bigint, position int>> in text order; position is that of the k-gram's first word.

    Null, empty and blank texts give an empty array. A text of fewer than `k` words is one k-gram, and one of
    fewer than `window` k-grams one window. Hashes depend on the words alone.
    """
    def grams(h: Column) -> Column:
        return F.transform(common.upto(0, F.size(h) - (k - 1)),
                           lambda i: F.xxhash64(*(common.nth(h, i + j) for j in range(k))))

    # Smaller is better: the hash first, then the later place.
    def ranked(g: Column) -> Column:
        return F.transform(g, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 31), 30).bitwiseOR(
            (F.lit(PLACE) - i).cast("bigint")))

    def minima(v: Column) -> Column:
        if window == 1:
            return v
        return F.array_distinct(F.transform(
            common.upto(0, F.size(v) - (window - 1)),
            lambda i: F.least(*(common.nth(v, i + j) for j in range(window)))))

    def picked(g: Column) -> Column:
        return common.let(minima_of(g), lambda m: F.transform(m, lambda p: common.let(
            (F.lit(PLACE) - p.bitwiseAND(F.lit(PLACE))).cast("int"),
            lambda at: F.struct(common.nth(g, at).alias("hash"), at.alias("position")))))

    def minima_of(g: Column) -> Column:
        return common.let(ranked(g), minima)

    none = F.array().cast("array<struct<hash:bigint,position:int>>")
    return common.let(common.words(text), lambda w: F.when(F.size(w) == 0, none).otherwise(
        common.let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: common.let(grams(h), picked))))


def digest(prints: Column) -> Column:
    """32 hexadecimal digits over hashes and positions, the same for equal texts."""
    def part(seed: int) -> Column:
        return F.lpad(F.hex(F.xxhash64(prints, F.lit(seed))), 16, "0")
    return F.lower(F.concat(part(1), part(2)))


def hash_set(prints: Column) -> Column:
    return F.array_distinct(F.transform(prints, lambda p: p["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets; two empty sets are alike."""
    return common.let(F.size(F.array_intersect(a, b)), lambda both: F.when(
        (F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both)))


def fingerprints(df: DataFrame, text: str = "text", out: str = "prints", k: int = K, window: int = WINDOW) -> DataFrame:
    """Add the fingerprints of a text column. A row-by-row expression: no shuffle, any columns, repeated rows as they are."""
    return df.withColumn(out, winnow(F.col(text), k, window))


def shared_passages(left: DataFrame, right: DataFrame, id_col: str, prints: str = "prints") -> DataFrame:
    """(left_id, right_id, left_position, right_position) of every fingerprint in both: the places of common passages."""
    def rows(df: DataFrame, side: str) -> DataFrame:
        return (df.select(F.col(id_col).alias(f"{side}_id"), F.explode(prints).alias("p"))
                .select(f"{side}_id", F.col("p.hash").alias("hash"), F.col("p.position").alias(f"{side}_position")))
    return rows(left, "left").join(rows(right, "right"), "hash").drop("hash")


def edited_documents(docs: DataFrame) -> DataFrame:
    """Query of the operator: every text beside its edited form, whose last half comes from the next document.

    A null text is an empty one. A document without doc_id, and a table of one row, are their own next document.
    """
    def summary(text: Column) -> Column:
        return common.let(winnow(text), lambda p: F.struct(
            digest(p).alias("fingerprint"), hash_set(p).alias("set")))

    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    prepared = common.with_next(base, "doc_id", ["text", "set"], lambda d: d.withColumn(
        "own", summary(F.col("text"))).select(*d.columns, "own.fingerprint", "own.set"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left("text", F.length("text") - half), F.left(F.coalesce("next_text", "text"), half))
    measured = common.let(edited, lambda t: common.let(summary(t), lambda e: F.struct(
        F.sha2(F.encode(t, "UTF-8"), 256).alias("edited_sha256"), e["fingerprint"].alias("edited_fingerprint"),
        likeness(F.col("set"), e["set"]).alias("near_edited"))))
    return prepared.withColumn("edit", measured).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), "edit.edited_sha256", "fingerprint",
        "edit.edited_fingerprint", "edit.near_edited",
        likeness(F.col("set"), F.coalesce("next_set", "set")).alias("near_next"))


def op1_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_documents(common.table(spark, sf_dir, "documents"))
