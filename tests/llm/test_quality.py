import numpy as np

from obsframe.llm import quality

from .conftest import by_id, prose

GOOD, BAD = [prose(f"g{i}", 40) for i in range(60)], ["junk *** spam idiot " * 10 + prose(f"b{i}", 5) for i in range(40)]


def test_ratios_and_draw(spark, docs):
    texts = GOOD + BAD + ["", None]
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in range(0, 100, 2)] + [(61, 1, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = by_id(quality.resample(docs(texts), labels, share=0.6))
    ratios = quality.fit(docs(texts), labels.filter("quality = 1 AND toxic = 0").select("doc_id"))
    for i, t in enumerate(texts):
        at = quality.features(t)
        assert rows[i]["n_features"] == len(at) and abs(rows[i]["log_weight"] - ratios[at].sum()) < 1e-6
    counts = np.zeros((2, quality.BUCKETS))
    for i, t in enumerate(texts):
        np.add.at(counts[0], quality.features(t), 1)
        if i < 60 and i % 2 == 0:
            np.add.at(counts[1], quality.features(t), 1)
    expected = counts[0] * counts[1].sum() / counts[0].sum()
    assert np.allclose(ratios, np.log((counts[1] + quality.PRIOR) / (expected + quality.PRIOR)))
    order = sorted(rows.values(), key=lambda r: -r["key"])
    assert {r["doc_id"] for r in order[:round(0.6 * 102)]} == {r["doc_id"] for r in rows.values() if r["selected"]}
    assert sum(rows[i]["selected"] for i in range(60)) > 50 and sum(rows[i]["selected"] for i in range(60, 100)) < 10


def test_gumbel_top_on_ties_and_edges(spark, docs):
    flat = spark.range(500).selectExpr("id AS doc_id", "0.0 AS log_weight", "id AS _slice0")
    for k in (0, 1, 77, 499, 500, 900):
        rows = quality.gumbel_top(flat, k).collect()
        assert sum(r["selected"] for r in rows) == min(k, 500) and len(rows) == 500
    same = spark.createDataFrame([(7, 1.0)] * 9, "doc_id bigint, log_weight double")
    assert sum(r["selected"] for r in quality.gumbel_top(same, 4).collect()) == 4
    # Equal weights: everybody is drawn about equally often.
    hits = np.zeros(500)
    for seed in range(4):
        for r in quality.gumbel_top(flat, 250, seed=seed).filter("selected").collect():
            hits[r["doc_id"]] += 1
    assert 1.8 < hits.mean() < 2.2 and (hits == 0).sum() < 80
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert quality.resample(docs([(1, "x")]).limit(0), labels).count() == 0
    assert all(r["selected"] for r in quality.resample(docs(["a b", None]), labels).collect())
