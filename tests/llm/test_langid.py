import random

import numpy as np
import pytest

from obsframe.llm import langid

from .conftest import by_id

PARTS = {"aa": ["bra", "kel", "tor", "min", "sa"], "bb": ["öli", "uve", "zya", "qui", "xo"], "cc": ["вра", "кел", "тор", "мин", "са"]}


def text(lang, n, seed):
    draw = random.Random(f"{lang}{seed}")
    return " ".join("".join(draw.choice(PARTS[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, text(lang, 30, i), lang) for i in range(60) for lang in PARTS]
    rows += [(9990, None, "aa"), (9991, text("aa", 9, 1), None), (9992, "", "dd")]
    return langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))


def test_spans_of_mixed_text(spark, docs, model):
    mixed = text("aa", 12, "x") + " " + text("bb", 15, "y") + " 123 ... " + text("cc", 9, "z")
    spans = langid.label_spans(docs([mixed]), model).first()["spans"]
    assert [(s["lang"], s["n_words"]) for s in spans] == [("aa", 12), ("bb", 15), ("cc", 11)]  # words without letters go with what follows
    assert [s["first_word"] for s in spans] == [0, 12, 27]
    best = by_id(langid.predict(docs([mixed]), model))[0]
    letters = {s["lang"]: s["letters"] for s in spans}
    assert best["lang_pred"] == max(letters, key=letters.get) and abs(best["score"] - max(letters.values()) / sum(letters.values())) < 1e-9


def test_held_out_accuracy_and_edges(spark, docs, model):
    rows = [(i, text(lang, 20, f"new{i}")) for i, lang in enumerate(list(PARTS) * 30)]
    got = by_id(langid.predict(docs(rows), model))
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in enumerate(list(PARTS) * 30)]) > 0.98
    odd = docs([None, "", "12 34 -- !", "a" * 100_000, text("aa", 3000, 5), "漢字"], ", spans int, lang string", (1, "zz"))
    got = by_id(langid.predict(odd, model))
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and [got[i]["score"] for i in range(3)] == [0] * 3
    assert got[4]["lang_pred"] == "aa" and got[5]["lang_pred"] in PARTS and 0 < got[3]["score"] <= 1
    assert langid.predict(docs([(1, "x")]).limit(0), model).count() == 0


def test_accepted_and_no_labels(spark, docs, model):
    rows = docs(["12 34", None, text("aa", 9, 3), text("aa", 9, 3)], ", extra string", ("e",))
    kept = langid.accepted(rows, model)
    assert kept.columns == ["doc_id", "text", "extra"] and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    none = langid.fit(spark.createDataFrame([(1, "a b", None)], "doc_id bigint, text string, lang string"))
    assert none.languages == [] and by_id(langid.predict(rows, none))[2]["lang_pred"] == "und"
    assert langid.accepted(rows, none).count() == 4


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(4)
    sizes = [0, 1, 5, 3, 6]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    score = rng.normal(0, 3, (9, 3))
    words = rng.integers(0, 9, offsets[-1])
    got = langid.paths(score, words, offsets, 2.0)
    for a, b in zip(offsets, offsets[1:]):
        def value(path):
            return sum(score[w, p] for w, p in zip(words[a:b], path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
        paths = [()]
        for _ in range(b - a):
            paths = [(*p, x) for p in paths for x in range(3)]
        assert abs(max(map(value, paths)) - value(tuple(got[a:b]))) < 1e-9


def test_labelling_holds_a_few_megabytes_at_once():
    import pyarrow as pa
    texts = pa.array([" ".join([f"word{i}", "ein", "haus", "the", "house"] * 400) for i in range(1200)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(1200)), texts], ["id", "text"])
    parts = list(langid.chunks(batch))
    assert sum(p.num_rows for p in parts) == 1200
    assert max(sum(map(len, p.column(1).to_pylist())) for p in parts) <= 7 << 20
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], rng.random((langid.BUCKETS, 2)).astype(np.float32), np.ones((len(langid.SCRIPTS), 2), bool))
    whole = langid.label_batch(texts, model, 12.0).to_pylist()
    assert [x for p in parts for x in langid.label_batch(p.column(1), model, 12.0).to_pylist()] == whole
