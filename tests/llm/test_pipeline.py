import corpus_pipeline as cp

from obsframe.llm import mixing, tokenfiles

from .conftest import prose
from .test_neardup import brute, changed

ITEM = "Which of the following trees loses its needles every autumn and grows them back again in spring?"


def corpus():
    rows = []
    for i in range(24):
        rows.append((i * 10, prose(i, 30 + i)))
    rows += [(i * 10 + 1, changed(prose(i, 30 + i), 1, i)) for i in range(6)] + [(i * 10 + 2, prose(i, 30 + i)) for i in range(3)]
    rows += [(301, None), (302, ""), (303, "123 -- 456"), (304, prose(80, 20) + ". " + ITEM), (305, prose(81, 25)), (305, prose(81, 25))]
    return [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in rows]


def test_stages_against_brute_force(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(corpus(), kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, sf_dir = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    columns, kept = docs.columns, [docs]
    for i, (name, stage) in enumerate(cp.STAGES):
        stage(spark, kept[-1], sf_dir).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
        if i < len(cp.STAGES) - 1:
            assert kept[-1].columns == columns, name
    texts = [[(r["doc_id"], r["text"]) for r in k.collect()] for k in kept[:-1]]
    assert sorted(k for k, _ in texts[1]) == sorted(k for k, _ in texts[0] if k not in (301, 302, 303))
    component = brute(dict(texts[1]).items())[0]
    assert sorted(k for k, _ in texts[2]) == sorted(k for k, c in component.items() if k == c)
    assert sorted(k for k, _ in texts[3]) == sorted(k for k, t in texts[2] if ITEM not in t)
    drawn = {r["doc_id"] for r in mixing.sample(mixing.weighed(kept[3])).collect() if r["sampled"]}
    assert {k for k, _ in texts[4]} == drawn and 0 < len(drawn) <= len(texts[3])
    from tokenizers import Tokenizer
    own, start = Tokenizer.from_file(tokenfiles.vocabulary()), 0
    rows = {r["doc_id"]: r for r in kept[-1].collect()}
    for key, text in sorted(texts[4]):
        n = len(own.encode(text, add_special_tokens=False).ids) + 1
        assert (rows[key]["start"], rows[key]["n_tokens"]) == (start, n)
        start += n
    assert len(rows) == len(texts[4])


def test_run_gives_what_the_stages_give(spark, tmp_path):
    kinds = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(corpus(), kinds).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, ITEM)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() == 0
