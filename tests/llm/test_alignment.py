import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")

from hearthline.llm import alignment, queries  # noqa: E402
from hearthline.llm.alignment import added, aligned, aligner, scored, translation  # noqa: E402
from hearthline.llm.word_tokens import _byte_letters  # noqa: E402

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a ", " a", "one two  three", "tabs\tand\nlines\n \n end", "x　y z  w", "▁ marks", "日本語 テキスト。", "😀😀 á", "<|endoftext|> <s>",
    "antidisestablishmentarianism 0123456789", "zero​ width ﻿ mark", "file\x1c separator\x85 next", "a" * 3000, "ab c" * 2000, "£€¥ " * 50, "same text", "same text",
]


def brute_force(texts):
    """Rows as aligned() gives them, from whole texts, and the count of each pair."""
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(_byte_letters())}
    docs, counts = [], Counter()
    for text in texts:
        x = y = ()
        if text:
            x, y = a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text)
            left = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
            right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
            if not b"".join(left) == b"".join(right) == f" {text}".encode():
                x = y = ()
        if not x:
            docs.append(([], [], [], Counter()))
            continue
        ends_a, ends_b = np.cumsum([len(t) for t in left]), np.cumsum([len(t) for t in right])
        both = np.intersect1d(ends_a, ends_b)
        groups = defaultdict(lambda: ([], []))
        for side, (ids, ends) in enumerate(((x, ends_a), (y, ends_b))):
            for i, end in zip(ids, ends, strict=True):
                groups[np.searchsorted(both, end)][side].append(i)
        groups = [groups[k] for k in sorted(groups)]
        links = Counter((p, q) for xs, ys in groups for p in xs for q in ys)
        counts.update(links.keys())
        docs.append((x, y, groups, links))
    top = defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    rows = []
    for x, y, groups, links in docs:
        shown = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        best = sum(n for pair, n in links.items() if counts[pair] == top[pair[0]])
        rows.append((len(x), len(y), len(groups), sum(links.values()), best, sum(n * counts[pair] for pair, n in links.items()), hashlib.sha256(shown.encode()).hexdigest() if x else ""))
    return rows, counts, top


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_odd_texts(spark, docs_of):
    ids = [None, *range(len(ODD) - 3), 5, 5]
    docs = docs_of(ODD, ids).withColumnRenamed("score", "n_best").repartition(3)
    got = aligned(docs, A, B)
    assert got.columns == ["doc_id", *COLUMNS]
    rows, counts, top = brute_force(ODD)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted((str(i), *r) for i, r in zip(ids, rows, strict=True))
    best = translation(docs, A, B).collect()
    assert {tuple(r) for r in best} == {(p, q, n) for (p, q), n in counts.items() if n == top[p]} and len(best) == len(set(best))


def test_whole_texts_in_one_piece(monkeypatch):
    own = aligner(A, B)
    texts = [t or "" for t in ODD]
    total = lambda found: None if found is None else ([sum(c[k] for c in found) for k in range(4)], ";".join(c[4] for c in found))
    cut = [total(f) for f in own.align_batch(texts)]
    whole = alignment.Aligner(A, B, max_memo=4)
    whole.cut = False
    assert [total(f) for f in whole.align_batch(texts)] == cut


def test_many_parts_and_small_memory(spark, docs_of, monkeypatch):
    monkeypatch.setattr(alignment, "PART_DOCS", 7)
    words = ["the cat", "a dog's dinner", "über alles", "naïve façade", "the the the", "12 34", "wordlike lyings"]
    texts = [" ".join(words[(i * k) % 7] for k in range(i % 9)) for i in range(120)]
    got = {r.doc_id: tuple(r[1:]) for r in aligned(docs_of(texts).repartition(40), A, B).collect()}
    rows, _, _ = brute_force(texts)
    assert got == dict(enumerate(rows))


def test_empty_tables(spark, docs_of):
    assert aligned(docs_of(["x"]).limit(0), A, B).collect() == []
    got = aligned(docs_of([None, ""]), A, B).collect()
    assert {tuple(r[1:]) for r in got} == {(0, 0, 0, 0, 0, 0, "")}


def test_blocks_against_dictionaries():
    width, rng = 10, np.random.default_rng(3)
    places, numbers = rng.integers(0, 400 * width, 5000), rng.integers(1, 5, 5000)
    want = Counter()
    for p, n in zip(places.tolist(), numbers.tolist(), strict=True):
        want[p] += n
    held, counts = added(places, numbers, width)
    assert dict(zip(held.tolist(), counts.tolist(), strict=True)) == want and held.tolist() == sorted(want)
    times = rng.integers(1, 4, 300)
    best, sums = scored(places[:300], times, held, counts, width)
    top = {p // width: max(n for q, n in want.items() if q // width == p // width) for p in places[:300].tolist()}
    assert sums.tolist() == [want[p] * t for p, t in zip(places[:300].tolist(), times.tolist(), strict=True)]
    assert best.tolist() == [t if want[p] == top[p // width] else 0 for p, t in zip(places[:300].tolist(), times.tolist(), strict=True)]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: tuple(r[1:]) for r in queries.op11_alignment(spark, "/root/testdata/sf0.001").collect()}
    rows, _, _ = brute_force([r.text for r in docs])
    assert got == {d.doc_id: r for d, r in zip(docs, rows, strict=True)}
