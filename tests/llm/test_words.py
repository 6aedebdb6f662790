from pyspark.sql import functions as F

from obsframe.llm import common, decontam
from obsframe.llm import fingerprints as fp

from .conftest import by_id, prose

URL = "https://example.com/" + "/".join(prose("url", 40).split()) + "?q=Zm9vYmFyYmF6"
ITEM = "Which processes transport dissolved nutrients through different membranes whenever concentration gradients become sufficiently pronounced afterwards, generally speaking?"
HAN = "下列哪一种树木在每年秋天落叶并在来年春天重新长出新的叶子"


def test_only_long_runs_are_cut(spark, docs):
    texts = ["many processes " + URL + " transport nutrients", "a" * 64, "b" * 65, "x y " + "-" * 200, "", None, HAN[:3] + "abc"]
    got = by_id(docs(texts).select("doc_id", common.words(F.col("text")).alias("w")))
    first = got[0]["w"]
    assert first[:2] == ["many", "processes"] and first[-2:] == ["transport", "nutrients"]
    assert "".join(first[2:-2]) == URL and len(first) > 20 and all(first)
    assert got[1]["w"] == ["a" * 64] and "".join(got[2]["w"]) == "b" * 65 and max(map(len, got[2]["w"])) <= 64
    assert "".join(got[3]["w"][1:]) == "-" * 200
    assert got[4]["w"] == got[5]["w"] == [] and got[6]["w"] == [*HAN[:3], "abc"]


def test_leaks_beside_and_inside_long_runs(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, HAN), (3, URL)], "item_id bigint, text string")
    texts = [URL[:100] + " . " + ITEM, "=" * 200 + " . " + ITEM + " " + URL[::-1], "天地玄黄宇宙洪荒" * 9 + "甲" + HAN + "日月盈昃" * 20,
             "z" * 70 + URL + "q" * 90, URL[:100], prose(1, 30), HAN[:8] + HAN[::-1]]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs(texts), bench).collect()}
    assert {(0, 1), (1, 1), (2, 2), (3, 3)} <= got
    assert not {k for k in got if k[0] > 4}


def test_fingerprints_beside_and_inside_long_runs(spark, docs):
    text = " ".join([ITEM, ITEM[::-1], ITEM.upper()])
    got = by_id(docs([text, text + " " + URL]).select("doc_id", fp.hash_set(fp.winnow(F.col("text"))).alias("h")))
    assert set(got[0]["h"][:-2]) <= set(got[1]["h"])
    a, b = fp.fingerprints(docs(["q" * 67 + URL])), fp.fingerprints(docs([URL + "z" * 13]))
    assert fp.shared_passages(a, b, "doc_id").count() > 2
