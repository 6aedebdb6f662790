import numpy as np
from pyspark.sql import functions as F

from obsframe.llm import mixing

from .conftest import by_id


def rows_of(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    data = [(i, None if rng.random() < 0.05 else f"s{min(int(rng.exponential(1.5)), 5)}", str(rng.choice(["en", "de", "fr"], p=[.7, .2, .1])),
             str(rng.choice(["prose", "code"])), int(rng.integers(1, 900))) for i in range(n)]
    return data, spark.createDataFrame(data, "doc_id bigint, source string, lang string, topic string, tokens bigint")


def raked_by_numpy(data, sweeps=200):
    cells = {}
    for _, s, g, t, n in data:
        cells[s, g, t] = cells.get((s, g, t), 0) + n
    keys, weight = list(cells), np.array(list(cells.values()), float)
    observed, total = weight.copy(), weight.sum()
    for _ in range(sweeps):
        for d in range(3):
            values = [k[d] for k in keys]
            sums = {v: sum(o for o, x in zip(observed, values) if x == v) for v in set(values)}
            norm = sum(s ** mixing.TEMPER for s in sums.values())
            for v, s in sums.items():
                mine = np.array([x == v for x in values])
                weight[mine] *= total * s ** mixing.TEMPER / norm / weight[mine].sum()
    return {k: (o, w) for k, o, w in zip(keys, observed, weight)}


def test_weights_and_probabilities(spark):
    data, rows = rows_of(spark)
    cells = mixing.cells_of(rows)
    raked = mixing.rake(cells, {d: mixing.tempered(cells, d) for d in mixing.DIMENSIONS}, tolerance=1e-4).collect()
    want = raked_by_numpy(data)
    for r in raked:
        o, w = want[r["source"], r["lang"], r["topic"]]
        assert r["observed"] == o and abs(r["weight"] - w) < 2e-3 * w
    out = mixing.sample(rows).collect()
    total = sum(r["tokens"] for r in out)
    assert abs(sum(r["tokens"] * r["probability"] for r in out) - mixing.BUDGET * total) < 1e-6 * total
    assert all(0 < r["probability"] <= 1 for r in out)
    # Below 1, probabilities are in proportion to weight by observed.
    gain = [(r["probability"], np.divide(*want[r["source"], r["lang"], r["topic"]][::-1])) for r in out if r["probability"] < 1]
    rates = [p / g for p, g in gain]  # up to the tolerance of the marginals
    assert max(rates) / min(rates) < 1.03
    assert abs(sum(r["sampled"] for r in out) / sum(r["probability"] for r in out) - 1) < 0.08


def test_given_targets(spark):
    _, rows = rows_of(spark, 2)
    share = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    cells = mixing.cells_of(rows)
    raked = mixing.rake(cells, {"lang": share([("en", 1.0), ("de", 1.0)]), "topic": share([("code", 3.0), ("prose", 1.0)])})
    sums = {r["lang"]: r["w"] for r in raked.groupBy("lang").agg(F.sum("weight").alias("w")).collect()}
    assert sums["fr"] == 0 and abs(sums["en"] / sums["de"] - 1) < 0.01
    assert mixing.calibrate(raked).filter("lang = 'fr' AND probability > 0").count() == 0


def test_edges(spark, docs):
    df = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "", "s", "en"), (None, "a b", "s", "en"), (3, "a@b.cc x", "s", None)],
                               "doc_id bigint, text string, source string, lang string").withColumn("probability", F.lit("clash"))
    out = mixing.sample(mixing.weighed(df)).collect()
    assert len(out) == 5 and all(r["sampled"] for r in out if r["tokens"] == 0)
    assert {r["doc_id"]: r["topic"] for r in out}[3] == "contact" and by_id(mixing.weighed(df))[1]["topic"] == "empty"
    assert mixing.sample(mixing.weighed(df.limit(0))).count() == 0
