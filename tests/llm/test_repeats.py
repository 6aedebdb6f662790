import hashlib
import itertools
import random

import pytest

from obsframe.llm import repeats

from .conftest import by_id, prose


def brute(texts):
    seen, out = set(), {}
    for key, text in sorted(texts, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - 99):
            if data[p:p + 100] in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(data[p:p + 100])
        kept = bytes(c for c, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), sum(1 for g, _ in itertools.groupby(gone) if g), hashlib.sha256(kept).hexdigest())
    return out


def corpus():
    draw = random.Random(11)
    shared = [prose(f"s{i}", n) for i, n in enumerate((14, 16, 30, 90))]
    texts = []
    for i in range(60):
        parts = [prose(i * 7 + j, draw.randrange(1, 40)) for j in range(3)]
        parts.insert(draw.randrange(3), draw.choice(shared))
        if i % 5 == 0:
            parts.append(draw.choice(shared)[draw.randrange(30):])
        texts.append(" ".join(parts))
    texts += [texts[3], texts[3], "x" * 400, "ab" * 300, "é漢😀" * 60, "é漢😀" * 60, "", None, "x" * 99, "x" * 100]
    # A passage with the same left side and different right sides, and the other way round.
    texts += [shared[2] + prose(900 + i, 20) for i in range(8)] + [prose(950 + i, 20) + shared[2] for i in range(8)]
    return [(i * 2, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group", [repeats.GROUP, 3])
def test_against_all_windows(spark, docs, group):
    """With groups of three, most anchors go through the join of windows."""
    rows = corpus()
    got = by_id(repeats.repeated_spans(docs(rows), group=group))
    assert {k: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for k, r in got.items()} == brute(rows)


def test_pieces_of_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rows = corpus()
    got = by_id(repeats.repeated_spans(docs(rows)))
    assert {k: r["kept_sha256"] for k, r in got.items()} == {k: v[3] for k, v in brute(rows).items()}


def test_edges(spark, docs):
    text = prose(1, 60)
    assert repeats.repeated_spans(docs([(1, "x")]).limit(0)).count() == 0
    rows = repeats.repeated_spans(docs([(None, text), (3, text), (4, "short")], ", key string, spans int", ("k", 1))).collect()
    assert {r["doc_id"]: r["n_removed"] for r in rows} == {None: 0, 3: len(text), 4: 0}


def test_maximal_repeats_have_all_occurrences():
    draw = random.Random(2)
    middle = bytes(draw.choice(b"ab") for _ in range(20))
    lefts = [bytes(draw.choice(b"ab") for _ in range(8)) for _ in range(30)]
    rights = [middle + bytes(draw.choice(b"ab") for _ in range(8)) for _ in range(30)]
    want = set()
    for n in range(9):
        for m in range(20, 29):
            if n + m < 24:
                continue
            groups = {}
            for i in range(30):
                groups.setdefault((lefts[i][:n], rights[i][:m]), []).append(i)
            for g in groups.values():
                if len(g) > 1 and len({lefts[i][:n + 1] for i in g if len(lefts[i]) > n} | {i for i in g if len(lefts[i]) <= n}) > 1 \
                        and len({rights[i][:m + 1] for i in g if len(rights[i]) > m} | {i for i in g if len(rights[i]) <= m}) > 1:
                    want.add((n, m, tuple(g)))
    got = {(n, m, tuple(sorted(g))) for n, m, g in repeats.maximal_repeats(lefts, rights, 24)}
    assert got == want
