import random
import re
from collections import Counter

import numpy as np
import pytest

from hearthline.llm import bm25 as S


def brute_force(documents, queries, k):
    def count(text):
        return Counter(re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text or "")))

    bags = [(i, count(t)) for i, t in documents]
    df = Counter(w for _, bag in bags for w in bag)
    mean = sum(sum(bag.values()) for _, bag in bags) / max(1, len(bags)) or 1.0
    out = []
    for q, text in queries:
        scores = []
        for i, bag in bags:
            length = sum(bag.values())
            s = sum(np.log(1 + (len(bags) - df[w] + 0.5) / (df[w] + 0.5)) * bag[w] * (S.K1 + 1) / (bag[w] + S.K1 * (1 - S.B + S.B * length / mean)) for w in count(text) if w in bag)
            if s:
                scores.append((-round(float(s), 6), i))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("shard, block", [(8192, 64), (40, 4)])
def test_against_scoring_everything(spark, docs_of, monkeypatch, shard, block):
    monkeypatch.setattr(S, "SHARD_DOCS", shard)
    rng = random.Random(1)
    words = [f"w{i}" for i in range(200)]
    texts = [None, "", "--", "Same text", "same TEXT", "é日 w1"] + [" ".join(words[min(199, int(rng.expovariate(0.05)))] for _ in range(rng.randint(1, 60))) for _ in range(250)]
    ids = rng.sample(range(1000), len(texts))
    docs = docs_of(texts, ids)
    asked = [(i, t) for i, t in zip(ids, texts, strict=True) if i % 10 == 0] + [(5001, "nothing here"), (5002, "w0 w0 w1"), (5003, None)]
    got = S.search(docs, spark.createDataFrame(asked, "doc_id long, text string"), k=7).collect()
    want = brute_force(list(zip(ids, texts, strict=True)), asked, 7)
    assert sorted((r.query_id, r.rank, r.doc_id) for r in got) == sorted(w[:3] for w in want)
    assert sorted(r.score for r in got) == pytest.approx(sorted(w[3] for w in want), abs=2e-6)
    assert S.search(docs_of([]), docs).count() == 0 and S.search(docs, docs_of([])).count() == 0


def test_pruning_skips_blocks_and_changes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(S, "BLOCK", 8)
    words = [np.unique(rng.integers(0, 300, rng.integers(5, 40))) for _ in range(800)]
    counts = [rng.integers(1, 5, len(w)) for w in words]
    index = S.Index(np.arange(800), words, counts, float(np.mean([c.sum() for c in counts])))
    for _ in range(40):
        query = np.unique(rng.integers(0, 330, 6))
        idf = rng.uniform(0.1, 5, len(query))
        every = index.top(query, idf, 800)
        assert index.top(query, idf, 10) == every[:10]


def test_frequent_words_cost_no_reading(monkeypatch):
    """Their lists meet a group of queries as dense rows; less than half of what the lists hold is read, and the top stays that of all."""
    rng = np.random.default_rng(5)
    zipf = 1 / np.arange(1, 3001)
    words = [np.unique(rng.choice(3000, rng.integers(20, 120), p=zipf / zipf.sum())) for _ in range(3000)]
    counts = [rng.integers(1, 4, len(w)) for w in words]
    df = np.bincount(np.concatenate(words), minlength=3000)
    index = S.Index(np.arange(3000), words, counts, float(np.mean([c.sum() for c in counts])))
    queries = [words[i] for i in range(0, 3000, 60)]
    idfs = [np.log(1 + (3000 - df[q] + 0.5) / (df[q] + 0.5)) for q in queries]
    every = index.tops(queries, idfs, 3000, [0.0] * len(queries))
    index.entries_read = index.entries_asked = 0
    assert index.tops(queries, idfs, 10, [0.0] * len(queries)) == [e[:10] for e in every]
    least = [e[9][0] for e in every]
    assert index.tops(queries, idfs, 10, least) == [e[:10] for e in every]
    assert index.tops(queries, idfs, 10, [x + 1 for x in least]) == [[f for f in e[:10] if f[0] >= x + 1 - 1e-6] for x, e in zip(least, every, strict=True)]
    assert 2 * index.entries_read < index.entries_asked


def test_texts_are_counted_once(spark, docs_of):
    rows = {r.word: (r.df, r.length) for r in S._counted(docs_of(["a b b", "a", ""]).select("doc_id", "text")).collect()}
    assert rows.pop(None) == (3, 4) and sorted(rows.values()) == [(1, None), (2, None)]
