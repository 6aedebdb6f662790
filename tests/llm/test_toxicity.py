"""Toxicity: the automaton against edit distances, planted terms, contexts and held-out labels."""

import random

import pytest
from pyspark.sql import functions as F

from obsframe.llm import toxicity as tox
from .toxic_words import CLEAN, distance

LABELS = "doc_id bigint, quality int, toxic int"


def test_automaton_against_edit_distances():
    terms = ["moron", "worthless", "idiot*", "scum", "scam*"]
    automaton, draw = tox.Automaton(terms), random.Random(5)
    words = {"", "moron", "idiotic", "idi", "scumm"}
    for _ in range(3000):
        word = list(draw.choice(terms).rstrip("*") + draw.choice(["", "", "ic", "s"]))
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(word) + 1)
            word[at:at + draw.randrange(2)] = draw.choice(["", "x", "o"])
        words.add("".join(word))
    for word in words:
        want = {}
        for i, term in enumerate(terms):
            stem = term.rstrip("*")
            ends = range(len(word) + 1) if term.endswith("*") else [len(word)]
            cost = min(distance(word[:n], stem) for n in ends)
            if word and cost <= tox.edits_of(term):
                want[i] = cost
        assert automaton.matches(word) == want, word


def test_pieces():
    assert tox.pieces('"(stu-pid),"') == ["stu-pid", "stu", "pid"]
    assert tox.pieces("...") == [] and tox.pieces("plain") == ["plain"] and tox.pieces("end.") == ["end"]


@pytest.fixture(scope="module")
def corpus(spark):
    """600 labelled texts; the toxic ones hold one of three insults, clean ones quote the third at times."""
    draw, rows, labels = random.Random(2), [], []
    for i in range(600):
        words = [draw.choice(CLEAN) + draw.choice(["", "", "s", "ed"]) for _ in range(draw.randrange(20, 120))]
        toxic = i % 6 == 0
        at = draw.randrange(len(words))
        if toxic:
            words[at:at] = ["you", draw.choice(["blockhead", "nitwit!", "knave"])]
        elif i % 7 == 0:
            words[at:at] = ["he", "said", '"the', "knave", 'there"']
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels, LABELS)


@pytest.fixture(scope="module")
def model(corpus):
    docs, labels = corpus
    return tox.fit(docs, labels.filter("doc_id % 4 <> 2"))


def scored(spark, model, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return {r["doc_id"]: r for r in tox.toxicity(frame, model).collect()}


def test_held_out(spark, corpus, model):
    docs, labels = corpus
    held = tox.toxicity(docs, model).join(labels.filter("doc_id % 4 = 2"), "doc_id")
    assert held.filter("predicted <> toxic").count() <= 2
    assert held.count() == 150


def test_misspelled_and_quoted(spark, model):
    plain = " ".join(CLEAN * 3)
    got = scored(spark, model, [
        plain, f"{plain} you blockhead", f"{plain} you blokhead {plain}", f"{plain} you BLOCKHEAD, and block-head",
        f"{plain} you knave {plain}", f'{plain} he said "the knave there" {plain}', None, "", " \n ", f"{plain} you blockhead"])
    assert [got[i]["predicted"] for i in (0, 1, 2, 3)] == [0, 1, 1, 1]
    assert got[2]["hits"][0]["edits"] == 1 and got[2]["hits"][0]["term"].startswith("block")
    assert got[4]["score"] > got[5]["score"] and got[5]["hits"][0]["quoted"] and not got[4]["hits"][0]["quoted"]
    assert got[6]["score"] == got[7]["score"] == got[8]["score"] == got[0]["score"] and got[6]["hits"] == []
    assert got[9]["score"] == got[1]["score"]


def test_very_long_text_is_read_whole(spark, model):
    text = " ".join(CLEAN * 20_000)
    got = scored(spark, model, [text, text + " you blockhead"])
    assert (got[0]["predicted"], got[1]["predicted"]) == (0, 1)


def test_without_labels_and_empty(spark, corpus):
    docs, _ = corpus
    none = tox.fit(docs, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in tox.toxicity(docs, none).collect()} == {0.05}
    nulls = tox.fit(docs, spark.createDataFrame([(None, 1, 1), (3, None, None)], LABELS))
    assert nulls.terms == []
    assert tox.toxicity(docs.limit(0), none).collect() == []


def test_copies_of_a_text_teach_no_terms(spark):
    long = " ".join(f"rare{i}word" for i in range(200))
    rows = [(i, f"{long} tail{i}") for i in range(8)] + [(100 + i, " ".join(CLEAN)) for i in range(90)]
    labels = [(i, 1, int(i < 100)) for i, _ in rows]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert tox.fit(frame, spark.createDataFrame(labels, LABELS)).terms == []


def test_query(spark, tmp_path, corpus):
    docs, labels = corpus
    docs.union(spark.createDataFrame([(None, "no id", "x")], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = tox.op11_toxicity(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 601
    assert got.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.3)").count() == 0
