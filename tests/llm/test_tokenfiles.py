import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from obsframe.llm import tokenfiles as tf

from .conftest import by_id, prose

TEXTS = [prose(1, 40), "", None, "  two  spaces\n\n new line ", " lead", "trail ", "a\n b\t c \n", "don't we'll I'M", "é漢字😀 mixed ßtext",
         "x" * 5000, "1234 56,7.8", " odd space \u0085next", prose(1, 40), "<|endoftext|> is text", prose(2, 3000), "\x1c \x1d a"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer
    own = Tokenizer.from_file(tf.vocabulary())
    return lambda text: own.encode(text or "", add_special_tokens=False).ids


def test_files_hold_what_the_library_gives(spark, docs, reference):
    rows = [(i * 5 + 2, t) for i, t in enumerate(TEXTS)]
    folder = tf.write(docs(rows).repartition(5), tf.new_folder(spark), tf.vocabulary())
    got, whole = by_id(tf.index(spark, folder)), by_id(tf.read(spark, folder))
    start = 0
    for key, text in rows:
        ids = reference(text) + [0]
        assert whole[key]["ids"] == ids
        assert (got[key]["start"], got[key]["n_tokens"]) == (start, len(ids))
        assert got[key]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = by_id(tf.read(spark, folder, [7, 2, 999]))
    assert set(some) == {2, 7} and some[7]["ids"] == [0] and some[2]["start"] == 0
    shards = spark.read.parquet(folder + "/shards").collect()
    name = spark.read.parquet(folder + "/dictionary").first()["sha256"]
    assert all(r["dictionary_sha256"] == name for r in shards)


def test_shards_close_and_stay_in_order(spark, docs, reference, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_BYTES", 200)
    rows = [(i, prose(i, 30)) for i in range(60)]
    folder = tf.write(docs(rows), tf.new_folder(spark), tf.vocabulary())
    assert spark.read.parquet(folder + "/shards").count() > 8
    start = 0
    for row in sorted(tf.index(spark, folder).collect(), key=lambda r: r["doc_id"]):
        assert row["start"] == start
        start += row["n_tokens"]
    assert start == sum(len(reference(t)) + 1 for _, t in rows)


def test_edges(spark, docs):
    folder = tf.write(docs([(1, "x")]).limit(0), tf.new_folder(spark), tf.vocabulary())
    assert tf.index(spark, folder).count() == 0 and tf.read(spark, folder, [1]).count() == 0
    folder = tf.write(docs([(None, "a"), (None, "b"), (3, "c"), (3, "c")], ", id int, slice int", (1, 2)), tf.new_folder(spark), tf.vocabulary())
    rows = tf.index(spark, folder).collect()
    assert sorted(r["start"] for r in rows if r["doc_id"] is None) == [0, 2]
    assert sorted(r["start"] for r in rows if r["doc_id"] == 3) == [4, 6]


def test_wrong_dictionary_is_refused():
    with pytest.raises(ValueError):
        tf.unpacked({"0" * 64: b"other"})("0" * 64, 2, b"")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\ta.b,'1é漢 "), st.characters(codec="utf-8"))), max_size=4))
def test_encoder_on_any_text(texts):
    own = tf.encoder(tf.vocabulary())
    want = [own.packed(own.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert own.encode(texts) == want


def test_letters_and_digits_alone_need_no_pattern():
    from tokenizers import Tokenizer
    path = tf.vocabulary()
    own, asked = tf.Encoder(path), []

    class Counting:
        def findall(self, text, real=own.pre_token):
            asked.append(text)
            return real.findall(text)
    own.pre_token = Counting()
    texts = ["x plain WORDS 123 007 a1 b2c 9lives don't Straße 12½ ² x\x0by end.", "s 1  2 \n3 the\tx ABC 4,5"]
    library = Tokenizer.from_file(path)
    got = [list(np.frombuffer(raw, own.width)) for raw in own.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {" plain", " WORDS", " 123", " ABC"} & set(asked)


def test_known_pre_tokens_stay_bounded(reference, monkeypatch):
    monkeypatch.setattr(tf, "KNOWN", 200)
    own = tf.Encoder(tf.vocabulary())
    for i in range(12):
        texts = [f"{prose(j, 4)} w{i * 9 + j}x of\nLine{j * i}'s end... {i}{j}\n\n Ünd so\x85on ²{j} !" for j in range(9)] + ["", "  ", "\nat", "漢 mixed"]
        assert [list(np.frombuffer(raw, own.width)) for raw in own.encode(texts)] == [reference(t) for t in texts]
        assert 0 < len(own.numbers) <= 200 and len(own.numbers) == len(own.sizes) and own.sizes.sum() == len(own.pool)
    assert len(own.pieces) < 50  # plain texts leave no pieces behind


def test_texts_of_many_pieces_are_grouped(reference, monkeypatch):
    monkeypatch.setattr(tf, "GROUP_CHARS", 300)
    own, asked = tf.Encoder(tf.vocabulary()), []
    real = own.encode_numbered
    monkeypatch.setattr(own, "encode_numbered", lambda texts: asked.append(sum(map(len, texts))) or real(texts))
    texts = [prose(i, 20) for i in range(30)]
    assert [list(np.frombuffer(raw, own.width)) for raw in own.encode(texts)] == [reference(t) for t in texts]
    assert len(asked) > 3 and max(asked) < 300 + 2 * max(map(len, texts))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("  \n\t\x85\xa0''sdmtlvrexLéɏ1²½.,!\x7f")), min_size=1, max_size=5))
def test_plain_texts_are_cut_as_by_the_pattern(texts):
    import regex
    joined = "".join(texts)
    first, want = np.zeros(len(joined), bool), np.zeros(len(joined), bool)
    for i, text in enumerate(texts):
        at = len("".join(texts[:i]))
        first[at:at + 1] = True
        want[[at + m.start() for m in regex.finditer(tf.PRE_TOKEN, text)]] = True
    got = tf.pre_token_starts(np.frombuffer(joined.encode("utf-16-le"), "<u2"), first, tf.plain_classes())
    assert got.tolist() == want.tolist()


def test_a_pre_token_is_looked_up_once_for_a_group_of_texts(reference):
    own, asked = tf.Encoder(tf.vocabulary()), []

    class Counting(dict):
        def __getitem__(self, key):
            asked.append(key)
            return super().__getitem__(key)
    own.numbers = Counting()
    texts = [prose(i % 3, 40) + " don't we'll 12½ Ünd  so\n\n" for i in range(60)]
    assert [list(np.frombuffer(raw, own.width)) for raw in own.encode(texts)] == [reference(t) for t in texts]
    assert asked and len(asked) == len(set(asked))
