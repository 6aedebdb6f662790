"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

A document's log weight is the sum of log(target / raw) over its hashed words and word pairs. Adding Gumbel noise
and taking the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.llm import common
from obsframe.llm.neardup import mix
from obsframe.session import cut_lineage

BUCKETS = 1 << 17
PRIOR = 2.0            # imagined occurrences in each bucket, in target and raw alike
TARGET_ROWS = 20_000   # expected number of labelled texts that the target model is fitted on
SEED = 29


def features(text: str | None) -> np.ndarray:
    """Buckets of the lower-cased words and word pairs of a text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    return (mix(np.concatenate([h, pairs]), 11) % np.uint64(BUCKETS)).astype(np.int64)


def fit(docs: DataFrame, good: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = TARGET_ROWS) -> np.ndarray:
    """log(target / raw) of each bucket, each count with `PRIOR` added so that rare n-grams say little.

    The raw model counts every document. The target model counts those named by `good` (a table of ids), of which
    about `rows` are taken by a hash of the id; that bound is why they may be broadcast. Without target or raw
    text all ratios are 0.
    """
    total = good.count()
    few = (good.select(F.col(id_col).alias("_good")).filter("_good IS NOT NULL").distinct().filter(
        common.luck("_good") * total < rows))
    marked = (docs.select(id_col, text).join(F.broadcast(few), F.col(id_col) == F.col("_good"), "left")
              .select(text, F.col("_good").isNotNull().alias("good")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [features(v.as_py()) for v in part.column(0)]
                good = [f for f, g in zip(found, part.column(1).to_pylist()) if g]
                sums[0] += np.bincount(np.concatenate(found), minlength=BUCKETS)
                if good:
                    sums[1] += np.bincount(np.concatenate(good), minlength=BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "raw", "target"])

    counted = (marked.mapInArrow(count, "bucket bigint, raw bigint, target bigint")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))).toArrow()
    sums = np.zeros((2, BUCKETS))
    at = counted.column("bucket").to_numpy()
    sums[:, at] = [counted.column("raw").to_numpy(), counted.column("target").to_numpy()]
    if not sums[1].any():
        return np.zeros(BUCKETS)
    expected = sums[0] * (sums[1].sum() / sums[0].sum())
    return np.log((sums[1] + PRIOR) / (expected + PRIOR))


def log_weights(docs: DataFrame, ratios: np.ndarray, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_features, log_weight) of every row; a text without words has weight 0 (log)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, weight = [], []
            for value in batch.column(1):
                at = features(value.as_py())
                n.append(len(at))
                weight.append(float(ratios[at].sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64())],
                                             [id_col, "n_features", "log_weight"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_features bigint, log_weight double")


def gumbel_top(weights: DataFrame, k: int, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """Add `key` (log weight plus Gumbel noise from a hash of the id) and `selected` (the k largest keys).

    Equal keys are taken in ascending id. The k-th key is found from counts of order slices; only the slice it
    lies in is ranked, in one task, and slices shrink as shuffle partitions grow.
    """
    luck = common.luck(id_col, F.lit(seed)) + 2.0 ** -54
    keyed = cut_lineage(weights.withColumn("key", F.col("log_weight") - F.ln(-F.ln(luck))))
    at, _ = common.slices(keyed, "key")
    sliced = keyed.withColumn("_slice", at)
    left, edge = k, -1
    for row in sorted(sliced.groupBy("_slice").count().collect(), reverse=True):  # one row for each slice
        if row["count"] > left:
            edge = row["_slice"]
            break
        left -= row["count"]
    rank = F.row_number().over(Window.partitionBy("_slice").orderBy(F.desc("key"), id_col))
    inside = sliced.filter(F.col("_slice") == edge).withColumn("selected", rank <= left)
    rest = sliced.filter(F.col("_slice") != edge).withColumn("selected", F.col("_slice") > edge)
    return rest.unionByName(inside).drop("_slice")


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", share: float | None = None) -> DataFrame:
    """(id, n_features, log_weight, key, selected) of every document.

    `labels` (id, quality, toxic) names the target: quality 1 and not toxic. `share` of the documents is drawn, by
    default the share of the target among the labels; without labels everything is.
    """
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select(id_col)
    if share is None:
        found = labels.filter("quality IS NOT NULL").agg(
            F.avg(F.when(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), 1.0).otherwise(0.0)).alias("s")).first()["s"]
        share = 1.0 if found is None else found
    weights = cut_lineage(log_weights(docs, fit(docs, good, id_col, text), id_col, text))
    return gumbel_top(weights, round(share * weights.count()), id_col)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
