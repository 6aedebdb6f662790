"""Cross-tokenizer alignment against a brute-force version over whole texts."""

import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsframe.llm import alignment

from .conftest import prose

TEXTS = ["plain words of a text", "", None, " ", "  two spaces  and\ttabs \n lines\n\n", "naïve café Straße Ünïcødé", "数据处理系统 和 日本語のテキスト",
         "emoji 😀😀 done", "<|endoftext|> and </s> <s> <unk> <0x41>", "\x00 nul \x1c and \x85 next line　wide", "tail space ", "\n", "a\n b",
         "combining é İ ﬁ x­x ​ zero", "==========" * 40, "   " * 50, "x" * 300, "▁ low line ▁▁", "1234567890 3.14 0x1F",
         "don't we'll THEY'RE", "plain words of a text", "﻿mark", "a  b   c    d", "مرحبا بالعالم", "क्षत्रिय हिन्दी"]


def brute(rows):
    """{row: (n_a, n_b, n_groups, n_links, n_best, count_sum, digest)} of whole texts, each encoded at once."""
    own = alignment.Tokens(*alignment.vocabularies())
    links_of, out = {}, {}
    for i, text in rows:
        a = own.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = own.b.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        sides = [[x[j] for j in ids] for x, ids in ((own.bytes_a, a), (own.bytes_b, b))]
        if not text or any(b"".join(s) != whole for s in sides):
            out[i] = [0, 0, 0, 0, ""]
            links_of[i] = Counter()
            continue
        ends = [list(np.cumsum([len(t) for t in s]).tolist()) for s in sides]
        groups, links, last = [], Counter(), (0, 0)
        for e in sorted(set(ends[0]) & set(ends[1])):
            now = tuple(bisect.bisect_right(x, e) for x in ends)
            groups.append((a[last[0]:now[0]], b[last[1]:now[1]]))
            links.update((x, y) for x in groups[-1][0] for y in groups[-1][1])
            last = now
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out[i] = [len(a), len(b), len(groups), sum(len(x) * len(y) for x, y in groups), hashlib.sha256(shown.encode()).hexdigest()]
        links_of[i] = links
    counts = Counter(p for links in links_of.values() for p in links)
    top = Counter()
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return {i: (*v[:4], sum(n for p, n in links_of[i].items() if counts[p] == top[p[0]]),
                sum(n * counts[p] for p, n in links_of[i].items()), v[4]) for i, v in out.items()}


def found(df):
    return {r["doc_id"]: tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()}


@pytest.mark.parametrize("heavy", [alignment.HEAVY, 40, 1])
def test_against_brute_force(spark, docs, heavy, monkeypatch):
    monkeypatch.setattr(alignment, "HELD", 50)
    texts = TEXTS + [prose(i, 40 + i) for i in range(12)] + [prose(3, 43)] * 6
    got = alignment.alignments(docs(texts).withColumn("n_a", F.lit("clash")), *alignment.vocabularies(), heavy=heavy)
    assert found(got) == brute(list(enumerate(texts)))


def test_random_characters(spark, docs):
    draw = random.Random(8)
    kinds = "ab Z9_. \n\té中ß' 😀́"
    texts = ["".join(draw.choice(kinds) for _ in range(draw.randrange(60))) for _ in range(150)]
    assert found(alignment.alignments(docs(texts), *alignment.vocabularies())) == brute(list(enumerate(texts)))


def test_gallop():
    draw = np.random.default_rng(4)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 5000), (2000, 2500)):
        x, y = (np.sort(draw.choice(20_000, k, replace=False)).astype(np.int64) for k in (n, m))
        place = {v: i for i, v in enumerate(y.tolist())}
        assert alignment.gallop(x, y).tolist() == [place.get(v, -1) for v in x.tolist()]
        a, b = alignment.common_ends(x, y)
        assert x[a].tolist() == y[b].tolist() == sorted(set(x.tolist()) & set(y.tolist()))


def test_wide_group():
    a, b = np.array([1, 2, 1, 3]), np.array([7, 7, 8])
    one = np.array([0])
    want = Counter((x * 10 + y) for x in a.tolist() for y in b.tolist())
    for wide in (100, 2):
        alignment.WIDE, before = wide, alignment.WIDE
        _, pairs, links = alignment.links_of(a, b, one, one, np.array([4]), np.array([3]), 10)
        alignment.WIDE = before
        got = Counter()
        for p, n in zip(pairs.tolist(), links.tolist()):
            got[p] += n
        assert got == want


def test_overlaps_cover_the_text(spark, docs):
    rows = alignment.overlaps(docs(TEXTS), *alignment.vocabularies()).orderBy("doc_id", "group_no").collect()
    own = alignment.Tokens(*alignment.vocabularies())
    for i, text in enumerate(TEXTS):
        mine = [r for r in rows if r["doc_id"] == i]
        if mine:
            whole = (" " + text).encode()
            assert [r["group_no"] for r in mine] == list(range(len(mine))) and mine[-1]["to_byte"] == len(whole)
            for r in mine:
                part = whole[r["from_byte"]:r["to_byte"]]
                assert b"".join(own.bytes_a[x] for x in r["a_ids"]) == part == b"".join(own.bytes_b[x] for x in r["b_ids"])


def test_empty_table(spark, docs):
    assert found(alignment.alignments(docs(["x"]).limit(0), *alignment.vocabularies())) == {}
    assert found(alignment.alignments(docs([None, ""]), *alignment.vocabularies())) == {i: (0, 0, 0, 0, 0, 0, "") for i in (0, 1)}
