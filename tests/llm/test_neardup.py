import random
import re

from obsframe.llm import neardup
from obsframe.llm.components import components

from .conftest import by_id, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(texts):
    sets = {k: shingles(t) for k, t in texts}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}, sets


def changed(text, n, seed):
    w, draw = text.split(), random.Random(seed)
    for _ in range(n):
        w[draw.randrange(len(w))] = f"new{draw.randrange(10 ** 6)}"
    return " ".join(w)


def test_against_all_pairs(spark, docs):
    texts = []
    for g in range(12):
        base = prose(g, 20 + 15 * g)
        texts += [base, base.upper(), changed(base, 1, g), changed(base, 2, g + 50), changed(base, 6, g + 90)]
        texts += [" ".join(base.split()[:-2]), base + " " + prose(g + 500, 3)]
    texts += ["one", "one", "one two three four", "ONE  two\nthree\tfour", "", None, " \n "]
    random.Random(3).shuffle(texts)
    rows = [(i * 2, t) for i, t in enumerate(texts)]
    want, sets = brute(rows)
    got = by_id(neardup.near_duplicates(docs(rows)))
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_chain_through_a_hub_that_is_unlike(spark, docs):
    """A third member links two that share buckets with a smaller, unlike document."""
    base = prose("chain", 200).split()
    step = [" ".join(base[i:i + 120]) for i in range(0, 80, 5)]
    rows = list(enumerate(step))
    assert {k: r["component_id"] for k, r in by_id(neardup.near_duplicates(docs(rows))).items()} == brute(rows)[0]


def test_bounds_never_part_a_link_and_leave_few_pairs(spark, docs, monkeypatch):
    """Texts that share a long passage are in common buckets, but only those that may be linked are paired."""
    monkeypatch.setattr(neardup, "SHARE", 4)
    passage, rows = prose("passage", 40), []
    for g in range(60):
        rows.append((g, passage + " " + prose(f"own {g}", 50 + g)))
    base = prose("base", 130)
    rows += [(100 + g, changed(base, g % 12, g)) for g in range(60)]
    seen = []
    likely = neardup.likely
    monkeypatch.setattr(neardup, "likely", lambda pairs, *rest: seen.append(pairs.collect()) or likely(pairs, *rest))
    want, _ = brute(rows)
    got = by_id(neardup.near_duplicates(docs(rows)))
    assert {k: r["component_id"] for k, r in got.items()} == want
    # All pairs across components of a bucket were compared before, about 1,700 of the texts with the passage.
    unlike = [r for made in seen[2:] for r in made if r["u"] < 100]
    assert len(unlike) < 60


def test_parity_bits_bound_the_difference():
    rng = random.Random(5)
    import numpy as np
    for n in (1, 10, 300):
        a = {rng.randrange(2 ** 63) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.8} | {rng.randrange(2 ** 63) for _ in range(n // 5)}
        x, y = (neardup.signs(np.array(sorted(s), np.uint64)) for s in (a, b))
        assert sum(int(v).bit_count() for v in (x ^ y).view(np.uint64)) <= len(a ^ b)


def test_edges(spark, docs):
    base = prose(1, 50)
    assert neardup.near_duplicates(docs([(1, "x")]).limit(0)).count() == 0
    rows = neardup.near_duplicates(docs([(None, base), (4, base), (9, base), (9, base), (5, None)], ", id int, key string, n int", (1, "k", 2))).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["component_id"], r["kept"]) for r in rows if r["doc_id"] is not None) == [
        (False, 4, 4, True), (False, 5, 5, True), (False, 9, 4, False), (False, 9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] is None] == [(None, True)]


def test_sketches_agree_with_similarity():
    rng = random.Random(1)
    alike = 0
    for _ in range(300):
        a = [rng.randrange(2 ** 63) for _ in range(40)]
        b = a[:34] + [rng.randrange(2 ** 63) for _ in range(6)]
        import numpy as np
        x, y = (neardup.sketch(np.unique(np.array(s, np.uint64))) for s in (a, b))
        alike += (x == y).mean()
    assert abs(alike / 300 - 34 / 46) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (5, 5), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_components_of_small_tables_take_few_partitions(spark, monkeypatch):
    from obsframe.llm import components as module
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 200)], "u bigint, v bigint")
    monkeypatch.setattr(module, "shuffle_width", lambda spark: 40)
    seen, cut = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda df: seen.append(df.rdd.getNumPartitions()) or cut(df))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r["component"] for r in components(edges).collect()} == {1}
        assert max(seen[1:]) <= 4
        monkeypatch.setattr(module, "TASK_ROWS", 25)
        seen.clear()
        assert {r["component"] for r in components(edges).collect()} == {1}
        assert max(seen[1:]) == 8
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
