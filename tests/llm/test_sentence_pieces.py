import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sentencepiece = pytest.importorskip("sentencepiece")

from hearthline.llm import queries  # noqa: E402
from hearthline.llm.sentence_pieces import Memo, Pieces, decoded, encoded, pieces, round_trip  # noqa: E402

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "   a", "a ", "▁", "▁▁a ▁", "\x00", "\n\n a\n\t", "日本語のテキスト。", "😀😀 á", "é" * 50, "<s></s><unk><0x41>", "﻿x", "01234 12", "x y　z"]
LONG = ["ab" * 20_000, " ".join(["threadbare"] * 30_000), " " * 5_000, "aaaa" * 5_000 + "b"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def expected(text):
    own = library()
    ids = own.encode(text or "")
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()


def test_odd_and_long_texts_as_the_library():
    assert [ids for _, ids in pieces(PATH).encode_batch(ODD + LONG, whole=True)] == library().encode(ODD + LONG)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁aeinrst'.,0\n"), st.characters(exclude_categories=["Cs"]))), max_size=5))
def test_any_text_as_the_library(texts):
    assert [ids for _, ids in pieces(PATH).encode_batch(texts)] == library().encode(texts)


def test_without_cuts_and_with_a_small_memory():
    own = Pieces(PATH, max_memo=3)
    own.cut_at_spaces = False
    texts = ["one two  three", "two three one", *ODD]
    for _ in range(3):
        assert [ids for _, ids in own.encode_batch(texts)] == library().encode(texts)


def test_agenda_takes_the_leftmost_of_equal_scores_first():
    own = pieces(PATH)
    rank = own.ranks["aa"] if "aa" in own.ranks else own.ranks[next(p for p in own.ranks if len(p) == 2 and p[0] == p[1])]
    piece = next(p for p, r in own.ranks.items() if r == rank)
    assert "".join(own.merged(piece[0] * 7)) == piece[0] * 7
    assert own.merged("zzq\u0001") and "".join(own.merged("zzq\u0001")) == "zzq\u0001"


def test_a_difference_from_the_library_is_an_error():
    own = Pieces(PATH)
    own.ranks = {}
    with pytest.raises(ValueError, match="otherwise"):
        own.encode_batch(["hello there"])


def test_memory_is_bounded():
    memo, made = Memo(10), []

    def make(keys):
        made.extend(keys)
        return {k: k for k in keys}

    for i in range(100):
        assert memo.of({"a", str(i)}, make)["a"] == "a"
        assert len(memo.new) <= 10 and len(memo.old) <= 10
    assert made.count("a") == 1
    memo.of({"x" * 1000}, make)
    memo.of({"a"}, make)
    assert "x" * 1000 not in memo.new


def test_tables(spark, docs_of):
    texts = [None, *ODD, *LONG, "again", "again"]
    ids = [None, *range(len(texts) - 3), 7, 7]
    docs = docs_of(texts, ids).withColumnRenamed("score", "ids_sha256")
    got = round_trip(docs, PATH, whole=True).collect()
    assert sorted(((r.doc_id or -1), *r[1:]) for r in got) == sorted(((i or -1), *expected(t)) for i, t in zip(ids, texts, strict=True))
    back = decoded(encoded(docs, PATH), PATH)
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, library().decode(library().encode(t or ""))) for i, t in zip(ids, texts, strict=True))
    assert round_trip(docs.limit(0), PATH).collect() == [] and encoded(docs.limit(0), PATH).columns == ["doc_id", "ids"]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r[1:] for r in queries.op12_sentence_pieces(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: expected(r.text) for r in docs.collect()}
