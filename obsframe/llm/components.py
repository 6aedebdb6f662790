"""Connected components of an edge table, as joins and aggregates that no hot node can pile up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsframe.session import cut_lineage, shuffle_width

TASK_ROWS = 50_000  # edges that a task takes at least, so that small tables make few files in each shuffle


def few(df: DataFrame, rows: int) -> DataFrame:
    """`df`, of about that many rows, in as many partitions as they need, four at least and no more than a shuffle has."""
    return df.coalesce(min(shuffle_width(df.sparkSession), max(4, -(-rows // TASK_ROWS))))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (u, v); the component is its smallest node.

    Alternating star contraction: each node hangs its larger neighbours under its smallest one, then its
    smaller ones, until nothing changes. The edge table never grows beyond its first size plus the nodes.
    Nulls and self-links are ignored; repeated edges count once; without edges the result is empty.
    """
    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    current = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                          .filter("u > v").distinct())
    before, now = None, mark(current)
    rows = now[0]
    current = few(current, rows)
    while now != before:
        both = few(current.union(current.select("v", "u")).toDF("u", "v"), 2 * rows)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(both.filter("v > u").join(few(least, rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), rows)
        lowest = few(large.groupBy("u").agg(F.min("v").alias("m")), rows)
        small = (large.join(lowest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(lowest.select("u", "m")))
        current = few(cut_lineage(few(few(small, rows).distinct(), rows)), rows)
        before, now = now, mark(current)
    return (current.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(current.select("v", "v").distinct()))
