import numpy as np
import pytest

from obsframe.llm import repeatgroups, repeats

from .conftest import prose
from .test_repeats import corpus


def occurrences(texts, passage):
    """All (key, place) of a byte string, overlapping ones too."""
    for key, data in texts.items():
        at = data.find(passage)
        while at >= 0:
            yield key, at
            at = data.find(passage, at + 1)


def grouped(frame):
    out = {}
    for r in frame.collect():
        out.setdefault((r["group"], r["length"]), []).append((r["doc_id"], r["lo"]))
    return out


def check(rows, got):
    """Each group is whole, and each repeated window lies in one with just its occurrences. Returns the passages."""
    texts = {k: (t or "").encode() for k, t in rows}
    found = {}
    for (_, length), places in got.items():
        key, lo = places[0]
        passage = texts[key][lo:lo + length]
        assert len(passage) == length >= 100 and len(places) > 1
        assert sorted(places) == sorted(occurrences(texts, passage))
        assert passage not in found
        found[passage] = places
    windows = {}
    for key, data in texts.items():
        for p in range(len(data) - 99):
            windows.setdefault(data[p:p + 100], []).append((key, p))
    held = {}
    for passage, places in found.items():
        for o in range(len(passage) - 99):
            held.setdefault(passage[o:o + 100], set()).add(len(places))
    for window, places in windows.items():
        if len(places) > 1:
            assert len(places) in held[window]
        else:
            assert window not in held
    return found, texts


def test_groups_against_all_windows(spark, docs):
    rows = corpus()
    found, texts = check(rows, grouped(repeatgroups.repeat_groups(docs(rows))))
    for passage, places in found.items():
        at = set(repeats.anchors(np.frombuffer(passage, np.uint8))[0].tolist())
        before = {texts[k][lo - 1] if lo else (k, "start") for k, lo in places}
        after = {texts[k][lo + len(passage)] if lo + len(passage) < len(texts[k]) else (k, "end") for k, lo in places}
        assert len(before) > 1 or repeats.LEFT in at
        assert len(after) > 1 or len(passage) - repeats.LENGTH in at


@pytest.mark.parametrize("limit", [1, 3])
def test_large_groups_give_windows(spark, docs, limit):
    rows = corpus()
    check(rows, grouped(repeatgroups.repeat_groups(docs(rows), limit=limit)))


def test_pieces_of_long_texts(spark, docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 700)
    rows = corpus()
    check(rows, grouped(repeatgroups.repeat_groups(docs(rows))))


def test_edges(spark, docs):
    text = prose(1, 60)
    assert repeatgroups.repeat_groups(docs([(1, "x")]).limit(0)).count() == 0
    # A null id, rows that repeat id and text, short and empty texts, columns with the operator's own names.
    rows = [(None, text), (3, text), (3, text), (4, "short"), (5, None), (6, "")]
    got = grouped(repeatgroups.repeat_groups(docs(rows, ", key string, anchor int, place string", ("k", 1, "p"))))
    assert got and all(len(p) == 2 and {k for k, _ in p} == {None, 3} and len({lo for _, lo in p}) == 1 for p in got.values())
