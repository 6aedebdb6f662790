"""Mixing to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Built-in functions only. The corpus is summed to one cell for each (source, language, topic) in one map-side
aggregate; cells are scaled to each target marginal in turn until all three hold. A document's probability is
its cell's scaled weight by its observed one, times a rate that makes the expected tokens meet the budget with
no probability above 1.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsframe.llm import common
from obsframe.session import cut_lineage

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7       # default targets: observed shares to this power
BUDGET = 0.9       # share of the tokens that the sample is to hold
TOLERANCE = 1e-6   # of a marginal's target
SWEEPS = 100
AT_ONCE = 4        # sweeps in one job
STALLED = 0.98     # sweeps end when those of one job leave this share of the gap
SEED = 17


def topic(text: Column) -> Column:
    """A coarse topic by marks in the text; null texts are `empty`."""
    has = lambda *marks: F.greatest(*(F.contains(text, F.lit(m)) for m in marks)) if len(marks) > 1 else F.contains(text, F.lit(marks[0]))
    return (F.when(F.coalesce(text, F.lit("")) == "", "empty").when(has("icensed under", "http"), "legal")
            .when(has(" = \"", "{", "}"), "code").when(has("|", "\t"), "table").when(has("@"), "contact")
            .when(has("***", "$$$", "%%%"), "noise").otherwise("prose"))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def cells_of(weighed: DataFrame) -> DataFrame:
    """(source, lang, topic, observed, weight); cells without tokens are left out."""
    return (weighed.groupBy(*DIMENSIONS).agg(F.sum("tokens").cast("double").alias("observed")).filter("observed > 0")
            .withColumn("weight", F.col("observed")))


def tempered(cells: DataFrame, dimension: str, power: float = TEMPER) -> DataFrame:
    """Target shares (value, share): observed shares to a power, so that small parts weigh more."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("observed").alias("n"))
    total = sums.agg(F.sum(F.pow("n", F.lit(power))).alias("t")).first()["t"] or 1.0
    return sums.select("value", (F.pow("n", F.lit(power)) / F.lit(total)).alias("share"))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """Scale `weight` until each marginal is within `tolerance` of its target.

    Targets are (value, share) tables. A value without target, or with share 0, gets weight 0; null is a value
    like others. Shares are taken relative to the sum over the values present. The total weight stays. Targets that
    no weights of the cells can meet leave a gap: once sweeps stop to lower it, or after `sweeps`, a warning tells it.
    """
    current = cells
    for dimension, target in targets.items():
        current = (current.join(target.select(F.col("value").alias("_v"), F.col("share").alias(f"_{dimension}")),
                                same(F.col(dimension), F.col("_v")), "left").drop("_v"))
    current = cut_lineage(current.fillna(0.0, [f"_{d}" for d in targets])
                          .withColumn("weight", F.when(F.least(*(F.col(f"_{d}") for d in targets)) > 0, F.col("weight")).otherwise(0.0)))
    total = cells.agg(F.sum("observed").alias("t")).first()["t"]
    if not total:
        return current.drop(*(f"_{d}" for d in targets))
    present = {d: current.groupBy(d).agg(F.max(f"_{d}").alias("s")).agg(F.sum("s").alias("s")).first()["s"] or 1.0 for d in targets}

    def swept(frame: DataFrame) -> DataFrame:
        """Each marginal once. The windows run over cells, whose number does not grow with the documents."""
        frame = frame.withColumn("_gap", F.lit(0.0))
        for d in targets:
            wanted = F.col(f"_{d}") * F.lit(total / present[d])
            frame = (frame.withColumn("_sum", F.sum("weight").over(Window.partitionBy(d)))
                     .withColumn("_gap", F.greatest("_gap", F.when((F.col("_sum") > 0) & (wanted > 0), F.abs(F.col("_sum") / wanted - 1)).otherwise(0.0)))
                     .withColumn("weight", F.when(F.col("_sum") > 0, F.col("weight") * wanted / F.col("_sum")).otherwise(0.0)).drop("_sum"))
        return frame

    before, gap = None, None
    for _ in range(0, sweeps, AT_ONCE):
        for _ in range(AT_ONCE):
            current = swept(current)
        current = cut_lineage(current)
        before, gap = gap, current.agg(F.max("_gap")).first()[0]
        if gap <= tolerance or before is not None and gap > before * STALLED:
            break
    if gap > tolerance:
        warnings.warn(f"the targets are missed by up to {gap:.2g} of a marginal", stacklevel=2)
    return current.drop("_gap", *(f"_{d}" for d in targets))


def calibrate(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Add `probability` to cells: min(1, rate * weight / observed), the rate such that the expected tokens are
    `budget` times those of cells with weight. Each round fixes the cells at 1 and spreads the rest anew."""
    gain = F.col("weight") / F.col("observed")
    sums = raked.filter("weight > 0").agg(F.sum("observed").alias("o"), F.sum("weight").alias("w")).first()
    if not sums["w"]:
        return raked.withColumn("probability", F.lit(0.0))
    aim, rate = budget * sums["o"], budget * sums["o"] / sums["w"]
    while True:
        full = gain * F.lit(rate) >= 1
        found = raked.agg(F.sum(F.when(full, F.col("observed")).otherwise(0.0)).alias("fixed"),
                          F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not found["open"]:
            break
        better = max(rate, (aim - found["fixed"]) / found["open"])
        if better <= rate * (1 + 1e-12):
            break
        rate = better
    return raked.withColumn("probability", F.least(F.lit(1.0), gain * F.lit(rate)))


def weighed(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, source, lang, topic, tokens) of every document."""
    return docs.select(F.col(id_col), *DIMENSIONS[:2], topic(F.col(text)).alias("topic"), tokens(F.col(text)).alias("tokens"))


def sample(rows: DataFrame, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id",
           budget: float = BUDGET, seed: int = SEED) -> DataFrame:
    """Every row of `rows` (id, source, lang, topic, tokens) with `probability` and `sampled`.

    Without `targets` the observed shares to the power 0.7 are taken. A row is sampled when a hash of its id and
    the seed, as a number from 0 to 1, is below its probability: repeated rows share their fate. Rows without
    tokens carry no weight and are kept with probability 1; so are rows of a null id at their cell's probability,
    as one id. An empty table gives an empty result.
    """
    kept = cut_lineage(rows)
    cells = cut_lineage(cells_of(kept))
    goal = targets or {d: cut_lineage(tempered(cells, d)) for d in DIMENSIONS}
    shares = calibrate(rake(cells, goal), budget).select(
        *(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "probability")
    on = [same(F.col(d), F.col(f"_{d}")) for d in DIMENSIONS]
    return (kept.join(shares, on, "left").drop(*(f"_{d}" for d in DIMENSIONS))
            .withColumn("probability", F.when(F.col("tokens") > 0, F.coalesce("probability", F.lit(0.0))).otherwise(1.0))
            .withColumn("sampled", common.luck(id_col, F.lit(seed)) < F.col("probability")))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(weighed(common.table(spark, sf_dir, "documents")))
