import random

from obsframe.llm import linededup

from .conftest import prose
from .test_linededup import brute, corpus, lines


def pieces(line, k=8):
    return {line[i:i + k] for i in range(max(1, len(line) - k + 1))}


def similarity(a, b):
    return len(pieces(a) & pieces(b)) / len(pieces(a) | pieces(b))


def sharing(spark, pairs):
    """Of pairs of lines, how many share a bucket."""
    rows = [(2 * i + j, line) for i, pair in enumerate(pairs) for j, line in enumerate(pair)]
    keys = {}
    for r in linededup.band_keys(spark.createDataFrame(rows, "node bigint, norm string"), 8).collect():
        keys.setdefault(r["node"], set()).add(r["key"])
    return sum(bool(keys[2 * i] & keys[2 * i + 1]) for i in range(len(pairs)))


def test_few_unlike_lines_share_a_bucket(spark):
    pairs = [(prose(f"u{i}", 30) + (same := " " + prose(f"s{i}", 13)), prose(f"v{i}", 30) + same) for i in range(200)]
    assert all(0.1 < similarity(a, b) < 0.25 for a, b in pairs)
    assert sharing(spark, pairs) < 40


def test_linked_lines_share_a_bucket(spark):
    draw, pairs = random.Random(3), []
    for i in range(600):
        line = prose(f"e{i}", draw.randrange(2, 60))
        other = line
        for _ in range(len(line) // 50 + 1):
            at = draw.randrange(len(line))
            other = other[:at] + draw.choice(["", "x", "yz"]) + other[at + draw.randrange(2):]
        if 0.75 <= similarity(line, other) < 1:
            pairs.append((line, other))
    assert len(pairs) > 200 and sharing(spark, pairs) == len(pairs)


def test_wide_bits_never_part_linked_lines(spark):
    draw = random.Random(5)
    texts = []
    for i in range(12):
        line = prose(f"w{i}", draw.randrange(1, 300)) + " same words again" * draw.randrange(9)
        for _ in range(3):
            at = draw.randrange(len(line))
            texts.append(line[:at] + draw.choice(["", "x", "yz"]) + line[at + draw.randrange(3):])
    texts = list(dict.fromkeys(texts))
    made = {r["node"]: r["words"] for r in linededup.wider(spark.createDataFrame(list(enumerate(texts)), "node bigint, norm string"), 8).collect()}
    assert all(len(words) == 64 for words in made.values())
    for u, a in enumerate(texts):
        for v, b in enumerate(texts[:u]):
            apart = sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(made[u], made[v], strict=True))
            assert apart <= len(pieces(a) ^ pieces(b))


def test_long_unlike_lines_of_a_bucket_are_not_compared_as_texts(spark, docs, monkeypatch):
    asked, alike = [], linededup.alike
    monkeypatch.setattr(linededup, "alike", lambda pairs, *a: asked.append(pairs.count()) or alike(pairs, *a))
    same = prose("long", 200)
    rows = [(i, same + " " + prose(f"long{i}", 110)) for i in range(30)]
    assert {k: (r["first_doc_id"], r["first_line_no"]) for k, r in lines(linededup.fuzzy_lines(docs(rows))).items()} == brute(rows)
    assert not sum(asked[1:])


def test_settings_are_put_back(spark, docs):
    before = spark.conf.get(linededup.GROUPS)
    linededup.fuzzy_lines(docs(corpus()[:5]))
    assert spark.conf.get(linededup.GROUPS) == before
