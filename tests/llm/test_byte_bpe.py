import base64
import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from hearthline.llm.byte_bpe import Codec, Transducer, Utf8Stream, decode_table, merge_by_rank, round_trip  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
ALPHABET = "abc ABC 019 \n\t\r\x0b\x0c\x1c\x1f\x85\xa0 　'stlé߀日本🙂́''ll!!??--==/\\ſK"


@pytest.fixture(scope="module")
def theirs():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_same_ids_as_the_library_on_random_texts(theirs):
    use, rng = Codec(PATH, PATTERN), random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["", " ", "\n\n", "aaaaaaaaab" * 2000, "".join(rng.choice("abcdefghijé日") for _ in range(9000))]
    assert all(ids(use.encode(t)) == theirs(t) for t in texts)


def test_small_vocabulary_against_merging_by_definition():
    rng = random.Random(2)
    ranks = {bytes((b,)): b for b in range(97, 101)}
    while len(ranks) < 40:
        a, b = rng.choice(list(ranks)), rng.choice(list(ranks))
        ranks.setdefault(a + b, 200 + len(ranks))
    use = Transducer(ranks, max_states=20, max_memo=5)
    use.SPAN = 8
    for _ in range(3000):
        piece = bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30)))
        want = [ranks[piece]] if piece in ranks else [ranks[t] for t in merge_by_rank(piece, ranks)]
        assert ids(use.encode_bytes(piece)) == want


def test_incremental_utf8():
    text = "aé日🙂" * 5
    for data in (text.encode(), b"\xff" + text.encode() + b"\xe6\x97", b"\xc3"):
        for step in (1, 2, 3, 7):
            stream = Utf8Stream()
            got = "".join(stream.push(data[i : i + step]) for i in range(0, len(data), step)) + stream.close()
            assert got == data.decode("utf-8", "replace")


def test_round_trip(spark, docs_of, theirs):
    texts = ["Hello  world", None, "", "x" * 50_000, "né 日本\x00", "Hello  world"]
    out = round_trip(docs_of(texts, [5, None, 1, 2, 3, 5]), PATH, PATTERN, keep_ids=True)
    rows = out.collect()
    assert len(rows) == len(texts)
    for row, text in zip(rows, texts, strict=True):
        want = theirs(text or "")
        assert row.ids == want and row.n_tokens == len(want)
        assert row.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert [r.text for r in decode_table(out, PATH, PATTERN).collect()] == [t or "" for t in texts]
    assert round_trip(docs_of([]), PATH, PATTERN).count() == 0
