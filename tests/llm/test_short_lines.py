from obsframe.llm import linededup

from .test_linededup import corpus, lines


def brute(rows, k):
    """First line of each component, by all pairs of sets of `k`-character pieces."""
    at = [(d, j, line.strip(" \t\r\x0b\f").lower()) for d, t in rows if t is not None for j, line in enumerate(t.split("\n"))]
    first, sets = {}, {}
    for d, j, n in at:
        if n and n not in first:
            first[n], sets[n] = (d, j), {n[i:i + k] for i in range(max(1, len(n) - k + 1))}
    root = {n: n for n in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if root[a] != root[b] and 4 * both >= 3 * (len(sets[a]) + len(sets[b]) - both):
                    low = min(root[a], root[b], key=first.get)
                    changed |= root[a] != low or root[b] != low
                    root[a] = root[b] = low
    return {(d, j): first[root[n]] if n else (d, j) for d, j, n in at}


def test_query_against_all_pairs_of_eight_characters(spark, docs, tmp_path):
    rows = corpus()
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = lines(linededup.op10_fuzzy_lines(spark, str(tmp_path)))
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in got.items()} == brute(rows, 8) != brute(rows, 12)


def test_one_edit_inside_a_middle_line(spark, docs):
    line = "Printed on 12 March for the members of the society, page 104 of 230 in total."
    assert len(line) < 80
    at = len(line) // 2
    out = linededup.without_repeats(docs([(1, line), (2, line[:at] + "#" + line[at + 1:] + "\nother")]))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: line, 2: "other"}
