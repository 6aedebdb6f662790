import hashlib

from pyspark.sql import functions as F

from obsframe.llm import fingerprints as fp

from .conftest import by_id, prose


def grams_of(text, k):
    w = text.split()
    return [tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def test_windows_keep_their_rightmost_minimum(spark, docs):
    texts = [prose(i, n) for i, n in enumerate((1, 3, 4, 11, 12, 40, 200))] + ["a " * 50]
    # Hashes of the k-grams by place, from Spark itself with a window of one.
    rows = docs(texts).select("doc_id", fp.winnow(F.col("text"), 4, 1).alias("all"), fp.winnow(F.col("text")).alias("p")).collect()
    for row in rows:
        h = [x["hash"] for x in sorted(row["all"], key=lambda x: x["position"])]
        order = [(x & (2 ** 64 - 1)) >> 31 for x in h]
        want = []
        for s in range(max(1, len(h) - 7)):
            window = range(s, min(s + 8, len(h)))
            at = min(window, key=lambda i: (order[i], -i))
            if (at, h[at]) not in want:
                want.append((at, h[at]))
        if texts[row["doc_id"]] != "a " * 50:
            assert [(x["position"], x["hash"]) for x in row["p"]] == want


def test_ties_take_the_later_place(spark, docs):
    row = docs(["a " * 20]).select(fp.winnow(F.col("text")).alias("p")).first()
    places = [x["position"] for x in row["p"]]
    assert places == list(range(7, 17))  # 17 equal k-grams, the last of each eight


def test_shared_runs_share_fingerprints(spark, docs):
    run = prose("run", 11)  # window + k - 1
    a, b = docs([prose(1, 60) + " " + run + " " + prose(2, 30)]), docs([prose(3, 17) + " " + run])
    found = fp.shared_passages(fp.fingerprints(a), fp.fingerprints(b), "doc_id").collect()
    assert any(60 <= r["left_position"] <= 67 and r["left_position"] - r["right_position"] == 43 for r in found)


def test_edge_texts(spark, docs):
    df = docs([None, "", " \n\t ", "one", "one", "x" * 1000, "漢" * 200]).withColumn("prints_", F.lit(1)).withColumn("hash", F.lit(2))
    got = by_id(fp.fingerprints(df).withColumn("d", fp.digest(F.col("prints"))))
    assert got[0]["prints"] == got[1]["prints"] == got[2]["prints"] == []
    assert got[3]["d"] == got[4]["d"] != got[5]["d"] and len(got[5]["prints"]) > 1 and len(got[6]["prints"]) > 1
    assert got[3]["prints_"] == 1 and got[3]["hash"] == 2


def edited(texts):
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        yield t[:len(t) - half] + after[:half]


def test_query(spark, docs):
    texts = [prose(i, 5 + i * 7) for i in range(40)] + ["", "é😀ü漢" * 30, "same text of five words", "same text of five words"]
    rows = [(i * 3 + 1, t or None) for i, t in enumerate(texts)]
    got = by_id(fp.edited_documents(docs(rows)))
    for (key, text), want, after in zip(rows, edited(texts), texts[1:] + texts[:1]):
        row = got[key]
        assert row["n_chars"] == len(text or "")
        assert row["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        if (text or "") == after:
            assert row["near_next"] == 1 and row["fingerprint"] == got[key + 3]["fingerprint"]
    assert len(got) == len(rows)
    middle = [got[k]["near_edited"] for k, t in rows if t and len(t.split()) > 60 and "漢" not in t]
    assert all(0.15 < n < 0.6 for n in middle)


def test_query_on_few_rows(spark, docs):
    assert fp.edited_documents(docs([(1, "x")]).limit(0)).count() == 0
    one = fp.edited_documents(docs([(7, "one two")])).first()
    assert one["near_next"] == 1 and one["n_chars"] == 7
    null = fp.edited_documents(docs([(None, "lost text"), (1, "a"), (1, "b")])).collect()
    assert len(null) == 3
