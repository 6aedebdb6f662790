from obsframe.llm import decontam

from .conftest import prose

ITEMS = [
    (1, "A farmer called Anna sells 12 kg of apples to Boris and keeps 7 kg for her own pie. How many did Anna have at first?"),
    (2, "Which of the following trees loses its needles every autumn and grows them back again in spring?"),
    (3, "short item of trees"),
    (4, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (5, ""), (6, None), (None, "some text that has no id at all but is long enough to match"),
]


def found(spark, docs, texts, items=ITEMS, **more):
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs(texts, **more), bench).collect()}


def test_verbatim_and_new_parameters(spark, docs):
    q1, q2 = ITEMS[0][1], ITEMS[1][1]
    other = q1.replace("Anna", "Clara").replace("Boris", "Dmitri").replace("12 kg", "345 lb").replace("7 kg", "8 lb")
    mixed = q1.replace("Anna", "Clara", 1).replace("Anna have", "Dora have")
    texts = [prose(1, 50) + ". " + q1 + " " + prose(2, 20), prose(3, 9) + ". " + other, prose(4, 9) + ". " + mixed, q2.upper(),
             " ".join(q2.split()[:9]) + " " + prose(5, 30), " ".join(q2.split()[1:15]), "It is a short item of trees.", "short item of shrubs",
             "9 8 7 6 5 4 3 2 1 0 11 22 33", "", None, prose(6, 400), ITEMS[6][1]]
    got = found(spark, docs, texts)
    assert set(got) == {(0, 1), (1, 1), (3, 2), (5, 2), (6, 3)}
    assert got[0, 1]["verbatim"] and not got[1, 1]["verbatim"] and got[1, 1]["n_slots"] == got[0, 1]["n_slots"] >= 5
    assert got[0, 1]["n_windows"] == got[0, 1]["item_windows"]


def test_edges(spark, docs):
    assert found(spark, docs, ["text"], [(1, None)]) == {}
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontam.contaminated(docs([(1, "x")]).limit(0), bench).count() == 0
    assert decontam.contaminated(docs([(1, ITEMS[1][1])]), bench.limit(0)).count() == 0
    rows = [(None, ITEMS[1][1]), (4, ITEMS[1][1]), (4, ITEMS[1][1]), (5, "word " * 20000 + ". " + ITEMS[1][1])]
    got = found(spark, docs, rows, extra=", item string, hash int, at int", values=("i", 1, 2))
    assert set(got) == {(4, 2), (5, 2)}


def test_large_benchmark_is_shuffled(spark, docs, monkeypatch):
    texts = [prose(1, 9) + ". " + ITEMS[0][1], prose(2, 60)]
    want = set(found(spark, docs, texts))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert set(found(spark, docs, texts)) == want == {(0, 1)}
