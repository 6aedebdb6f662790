"""Helpers shared by the operators: local bindings, text pieces, order slices, components."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.session import cut_lineage, shuffle_width

LONG_RUN = 64  # a longer run of non-space is cut into pieces
# Fixed value: letters of scripts written without spaces; each is a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once, however often `body` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nth(values: Column, index: Column) -> Column:
    """The element at a 0-based index, null outside the array."""
    return F.get(values, index)


def upto(first: int, count: Column) -> Column:
    """`first`, `first` + 1, ... with `count` elements, at least one."""
    return F.sequence(F.lit(first), F.greatest(count, F.lit(1)) + (first - 1))


def luck(*keys: str | Column) -> Column:
    """A number from 0 to below 1 from a hash of the keys; null keys count as any other value."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))


def pieces(run: Column) -> Column:
    """A run of non-space cut at places that its characters alone decide, every eight characters on average.

    So a stretch that two runs share is cut alike in both, wherever it stands. No piece is longer than 64.
    """
    cut = lambda c, x, i: F.pmod(F.xxhash64(nth(c, i - 1), x), F.lit(8)) == 0
    spaced = let(F.split(run, ""), lambda c: F.array_join(F.transform(
        c, lambda x, i: F.when(cut(c, x, i), F.concat(x, F.lit(" "))).otherwise(x)), ""))
    return F.split(F.rtrim(F.regexp_replace(spaced, rf"(\S{{{LONG_RUN}}})(?=\S)", "$1 ")), " ")


def words(text: Column) -> Column:
    """Whitespace-separated words of a text; an empty array for null, empty and blank texts.

    A letter of a script written without spaces is a word, in short and long texts alike. Another run of more than
    64 characters without a space, and no other word of its text, is cut by `pieces`.
    """
    def split(t: Column) -> Column:
        trimmed = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))

    spaced = let(F.coalesce(text, F.lit("")), lambda t: F.when(
        F.rlike(t, F.lit(UNSPACED)), F.regexp_replace(t, f"({UNSPACED})", " $1 ")).otherwise(t))
    return let(let(spaced, split), lambda w: F.when(
        F.exists(w, lambda x: F.length(x) > LONG_RUN),
        F.flatten(F.transform(w, lambda x: F.when(F.length(x) > LONG_RUN, pieces(x)).otherwise(F.array(x))))).otherwise(w))


def slices(df: DataFrame, key: str, per_task: int = 4) -> tuple[Column, int]:
    """An expression that maps `key` to an order slice, and the number of slices.

    Slices are cut at approximate quantiles, `per_task` for each shuffle partition; what reaches the driver
    is that many keys, whatever the number of rows.
    """
    count = max(2, per_task * shuffle_width(df.sparkSession))
    at = [i / count for i in range(1, count)]
    found = df.agg(F.percentile_approx(key, at, 20 * count).alias("b")).first()["b"] or []
    bounds = sorted(set(found))
    if not bounds:
        return F.lit(0), 1
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    literal = F.array(*map(F.lit, bounds))
    return F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda low, step: F.when(
            (low + step <= len(bounds)) & (F.get(literal, low + step - 1) <= F.col(key)), low + step).otherwise(low),
    ), len(bounds) + 1


def with_next(df: DataFrame, key: str, columns: list[str], prepare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Add next_<column> from the row that follows in ascending `key`; the last row is followed by the first.

    `prepare` adds columns row by row before the shuffle; `columns` may name them. Rows with a null key follow
    nothing and get nulls. Rows with equal keys follow each other in no stated order. One shuffle of the rows:
    a slice holds neighbouring keys and, as a guard, a copy of the first row of the slice after it.
    """
    keyed = df.filter(F.col(key).isNotNull())
    at, _ = slices(keyed, key)
    firsts = cut_lineage(keyed.select(key).groupBy(at.alias("_slice")).agg(F.min(key).alias("_first")))
    # One row for each slice: their number is bounded by slices().
    every = Window.partitionBy(F.lit(0))
    following = firsts.select("_slice", F.coalesce(
        F.lead("_first").over(every.orderBy("_slice")), F.min("_first").over(every)).alias("_first"))
    guards = (keyed.join(F.broadcast(following), F.col(key) == F.col("_first")).drop("_first")
              .withColumn("_guard", F.lit(1)))
    rows = keyed.withColumn("_slice", at).withColumn("_guard", F.lit(0)).unionByName(guards)
    # The guard of the last slice is the very first row, so guards sort by being guards.
    order = Window.partitionBy("_slice").orderBy("_guard", key)
    out = prepare(rows).withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
    out = out.filter("_guard = 0").drop("_slice", "_guard")
    loose = prepare(df.filter(F.col(key).isNull()))
    kinds = {f.name: f.dataType for f in loose.schema}
    return out.unionByName(loose.withColumns({f"next_{c}": F.lit(None).cast(kinds[c]) for c in columns}))
