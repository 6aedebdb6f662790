"""Ordered helpers against plain pandas, with one key holding most of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from obsframe.operators import ordered as O


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    n = 4000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abcdef"), n)),
                        "t": rng.integers(0, 50, n), "seq": np.arange(n), "v": rng.integers(-20, 20, n).astype(float)})
    return pdf, spark.createDataFrame(pdf)


def test_running_totals(skewed):
    pdf, df = skewed
    got = O.running_totals(df, ["k"], ["t", "seq"], {"run": F.col("v"), "n": F.lit(1)}, slices=7)
    slices = got.filter("k = 'hot'").select("_slice").distinct().count()
    assert slices > 2, "the hot key must be spread over slices"
    got = got.toPandas().set_index("seq").sort_index()
    want = pdf.sort_values(["k", "t", "seq"])
    want["run"], want["n"] = want.groupby("k")["v"].cumsum(), want.groupby("k").cumcount() + 1
    want = want.set_index("seq").sort_index()
    assert (got["run"] == want["run"]).all() and (got["n"] == want["n"]).all()


def test_previous_value(skewed):
    pdf, df = skewed
    order = ["t", "seq"]
    got = O.previous_value(O.range_slices(df, ["k"] + order, 7), ["k"], order, "v", "prev").toPandas().set_index("seq").sort_index()
    want = pdf.sort_values(["k"] + order)
    want["prev"] = want.groupby("k")["v"].shift()
    want = want.set_index("seq").sort_index()
    assert np.array_equal(got["prev"].to_numpy(dtype=float), want["prev"].to_numpy(dtype=float), equal_nan=True)


@pytest.mark.parametrize("n", [1, 5, 100])
def test_top_n(skewed, n):
    pdf, df = skewed
    got = O.top_n_per_key(df, ["k"], [F.desc("t"), F.desc("seq")], n).toPandas()
    want = pdf.sort_values(["t", "seq"], ascending=False).groupby("k").head(n)
    assert sorted(got["seq"]) == sorted(want["seq"])


def test_exact_percentiles(skewed):
    pdf, df = skewed
    got = O.exact_percentiles(df, ["k"], "v", {"p0": 0, "p50": 50, "p95": 95, "p100": 100}, slices=5).toPandas().set_index("k")
    for k, group in pdf.groupby("k"):
        want = np.percentile(group["v"], [0, 50, 95, 100])
        assert got.loc[k].to_numpy() == pytest.approx(want)
    whole = O.exact_percentiles(df, [], "v", {"p99": 99}, slices=5).first()
    assert whole["p99"] == pytest.approx(np.percentile(pdf["v"], 99))
