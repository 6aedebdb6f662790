import random

from obsframe.llm import linededup

from .conftest import prose


def brute(rows):
    def norm(line):
        return line.strip(" \t\r\x0b\f").lower()
    lines = [(k, j, line) for k, t in sorted(rows, key=lambda r: r[0]) if t is not None for j, line in enumerate(t.split("\n"))]
    first, sets = {}, {}
    for k, j, line in lines:
        n = norm(line)
        if n and n not in first:
            first[n], sets[n] = (k, j), {n[i:i + 12] for i in range(max(1, len(n) - 11))}
    parent = {n: n for n in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    names = list(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y, key=first.get)] = min(x, y, key=first.get)
    return {(k, j): first[find(norm(line))] if norm(line) else (k, j) for k, j, line in lines}


def corpus():
    draw = random.Random(9)
    base = [prose(f"l{i}", n) for i, n in enumerate((3, 8, 12, 20, 40))]
    texts = []
    for i in range(40):
        lines = []
        for _ in range(4):
            line = draw.choice(base)
            kind = draw.randrange(4)
            if kind == 1:
                line = line.upper() + "  "
            elif kind == 2:
                at = draw.randrange(len(line))
                line = line[:at] + draw.choice("xyz") + line[at + 1:]
            elif kind == 3:
                line = prose(draw.random(), draw.randrange(1, 12))
            lines.append(line)
        texts.append("\n".join(lines))
    texts += ["", None, "\n\n", "a\nb\na", "é漢😀" * 30 + "\n" + "é漢😀" * 30 + "!", "x" * 5000 + "\n" + "x" * 5001]
    return [(i * 3, t) for i, t in enumerate(texts)]


def lines(df):
    return {(r["doc_id"], r["line_no"]): r for r in df.collect()}


def test_against_all_pairs(spark, docs):
    rows = corpus()
    got, want = lines(linededup.fuzzy_lines(docs(rows))), brute(rows)
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in got.items()} == want
    assert all(r["kept"] == (want[k] == k) for k, r in got.items())


def test_large_sides_are_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(linededup, "SEND_ROWS", 0)
    rows = corpus()[:15]
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in lines(linededup.fuzzy_lines(docs(rows))).items()} == brute(rows)


def test_text_without_repeats_and_edges(spark, docs):
    assert linededup.fuzzy_lines(docs([(1, "x")]).limit(0)).count() == 0
    rows = [(2, "same line of text\nother"), (3, "new\nSAME LINE OF TEXT \n\n"), (4, None), (5, "")]
    out = linededup.without_repeats(docs(rows, ", line string, node int, key int", ("l", 1, 2)))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {2: "same line of text\nother", 3: "new\n\n", 4: None, 5: ""}
    null = linededup.fuzzy_lines(docs([(None, "same line of text"), (0, "same line of text")])).collect()
    assert {r["doc_id"]: (r["kept"], r["first_doc_id"]) for r in null} == {None: (True, None), 0: (False, None)}


def test_bits_never_part_linked_lines(spark, docs):
    draw = random.Random(4)
    texts = []
    for i in range(30):
        line = prose(f"b{i}", draw.randrange(1, 40)) + " same words again" * draw.randrange(9)
        for _ in range(3):
            at = draw.randrange(len(line))
            texts.append(line[:at] + draw.choice(["", "x", "yz"]) + line[at + draw.randrange(3):])
    texts = list(dict.fromkeys(texts))
    made = {r["node"]: r for r in linededup.sketches(spark.createDataFrame(list(enumerate(texts)), "node bigint, norm string"), 8).collect()}
    sets = [{t[i:i + 8] for i in range(max(1, len(t) - 7))} for t in texts]
    linked = 0
    for u, a in enumerate(sets):
        for v, b in enumerate(sets[:u]):
            apart = sum(((made[u][s] ^ made[v][s]) & (2**64 - 1)).bit_count() for s in linededup.SIGNS)
            assert apart <= len(a ^ b)
            linked += 100 * len(a & b) >= 75 * len(a | b)
    assert linked > 20


def test_bucket_of_unlinked_lines_takes_two_confirmations(spark, docs, monkeypatch):
    calls, alike = [], linededup.alike
    monkeypatch.setattr(linededup, "alike", lambda *a: calls.append(1) or alike(*a))
    monkeypatch.setattr(linededup, "SHARE", 8)
    common = prose("shared", 12)
    rows = [(i, common + " " + prose(f"own{i // 2}", 12) + "!" * (i % 2)) for i in range(50)]
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in lines(linededup.fuzzy_lines(docs(rows))).items()} == brute(rows)
    assert len(calls) <= 2


def test_bits_are_kept_only_for_lines_that_share_a_bucket(spark, docs, monkeypatch):
    asked, real = [], linededup.sketches
    monkeypatch.setattr(linededup, "sketches", lambda texts, k: asked.append(texts) or real(texts, k))
    rows = [(i, f"{i} " + prose(f"alone{i}", 30)) for i in range(20)] + [(100 + i, prose("two", 30) + "!" * i) for i in range(2)]
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in lines(linededup.fuzzy_lines(docs(rows))).items()} == brute(rows)
    assert asked and all(2 <= texts.count() < 10 for texts in asked)


def test_shuffle_files_go_with_each_step(spark, docs, monkeypatch):
    key, seen, alike = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], linededup.alike
    monkeypatch.setattr(linededup, "alike", lambda *a: seen.append(spark.conf.get(key)) or alike(*a))
    before, rows = spark.conf.get(key), corpus()[:12]
    out = linededup.fuzzy_lines(docs(rows))
    assert seen and set(seen) == {"true"} and spark.conf.get(key) == before
    for _ in range(2):                                               # the result can be asked for again
        assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in lines(out).items()} == brute(rows)
