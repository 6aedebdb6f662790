"""The conversation trie against a brute-force version."""

import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from obsframe.llm import prefixtrie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(convs):
    """Rows of the trie over {conv_id: [(role, text), ...]}."""
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = defaultdict(set)
    for p in members:
        if p:
            kids[p[:-1]].add(p)
    rows = []
    for p, own in members.items():
        below = [q for q in members if q[:len(p)] == p]
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids[p]),
                     sum(not kids[q] for q in below), sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q),
                     hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(rows, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_query_against_brute_force(spark, tmp_path):
    draw, rows = random.Random(3), []
    for c in range(120):
        for t in range(draw.randrange(1, 11)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "", "long " * 9])))
    rows += [(500, None, None, None), (500, None, None, None), (501, 3, "user", None), (501, None, "user", "first"), (None, 1, "user", "nobody's")]
    found = rows_of(prefixtrie.op13_prefix_trie(spark, write(spark, tmp_path, rows)))
    assert found == brute(rebuilt(rows))


def test_hot_first_turn_and_copies(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK", 40)
    turns = [(c, t, "user", "same" if t == 0 or c % 3 else f"{c}") for c in range(90) for t in range(3)]
    paths = prefixtrie.sequences(spark.createDataFrame(turns, SCHEMA))
    convs = defaultdict(list)
    for c, _, role, text in turns:
        convs[c].append((role, text))
    assert rows_of(prefixtrie.trie(paths)) == brute(convs)


def test_turnless_and_empty(spark, tmp_path):
    # Conversation 7 asks for the turns of 5, which does not exist, and has no more than it gives away.
    assert zlib.crc32(b"7") % 9 >= 1
    found = rows_of(prefixtrie.op13_prefix_trie(spark, write(spark, tmp_path / "one", [(7, 0, "user", "x")])))
    assert found == [(7, 0, None, 1, 0, 1, 0, hashlib.sha256(b"7").hexdigest())]
    assert rows_of(prefixtrie.op13_prefix_trie(spark, write(spark, tmp_path / "none", []))) == []


def test_long_conversation(spark):
    turns = [(c, t, "user", f"turn {t}") for c in (1, 2) for t in range(12 + c)]
    found = rows_of(prefixtrie.trie(prefixtrie.sequences(spark.createDataFrame(turns, SCHEMA))))
    assert found == brute({c: [("user", f"turn {t}") for t in range(12 + c)] for c in (1, 2)})


def test_long_tails_and_copies(spark):
    texts = {1: [*"ab", *(f"x{i}" for i in range(40))], 2: [*"ab"], 3: [*"ac", *(f"y{i}" for i in range(25))], 6: ["ü" * 9] * 30, 7: ["z"]}
    texts |= {4: texts[3], 5: texts[3], 8: texts[1][:20]}
    turns = [(c, i, "user", t) for c, own in texts.items() for i, t in enumerate(own)]
    found = rows_of(prefixtrie.trie(prefixtrie.sequences(spark.createDataFrame(turns, SCHEMA))))
    assert found == brute({c: [("user", t) for t in own] for c, own in texts.items()})
