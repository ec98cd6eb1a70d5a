import random
import zlib

import numpy as np
import pytest

from hearthline.llm.quality import BUCKETS, features, fit, score, scored, train


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["an", "the", "or", "in", "re", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        body = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        kind = rng.randrange(3)
        if not good:
            body = [w + "***" for w in body] if kind == 0 else [w.upper() + "!!" for w in body] if kind == 1 else [body[0]] * len(body)
        texts.append(" ".join(body))
        labels.append(int(good))
    return texts, labels


def test_features_are_hashes_of_words_and_of_ngrams_within_them():
    assert len(features("")) == len(features(" \n ")) == 0
    found = features("ab cd")
    assert found.min() >= 0 and found.max() < BUCKETS
    assert sorted(features("cd ab")) == sorted(found)
    assert not set(features("x" * 40)) == set(features("x x x x"))
    assert len(features("é" * 100_000)) > 100_000


def test_training_on_one_label_or_none():
    one = train([(np.array([1]), np.array([1.0], np.float32), 1)])
    assert one.score("anything") > 0.99 and train([]).score("") == 0.5


def test_held_out_accuracy(spark, docs_of):
    texts, labels = corpus(900)
    docs = docs_of(texts)
    known = spark.createDataFrame([(i, y, "clash") for i, y in enumerate(labels)] + [(0, None, "clash"), (None, 1, "clash")], "doc_id long, quality int, text string")
    rows = {r.doc_id: r for r in scored(docs, known).collect()}
    assert len(rows) == len(texts)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows.values())
    out = [rows[i].predicted == labels[i] for i in rows if rows[i].held_out]
    assert np.mean(out) > 0.95
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in enumerate(labels)], "doc_id long, quality int")
    assert {r.doc_id: r.score for r in scored(docs, flipped).collect()} == pytest.approx({i: r.score for i, r in rows.items()})


def test_odd_rows(spark, docs_of):
    docs = docs_of([None, "", "same text", "same text", "x" * 200_000], [None, 1, 2, 2, 3])
    labels = spark.createDataFrame([(2, 1), (3, 0), (2, 0)], "doc_id long, quality int")
    model = fit(docs, labels)
    rows = score(docs, model, keep=("lang",)).collect()
    assert len(rows) == 5 and rows[2].score == rows[3].score and rows[0].score == rows[1].score
    assert scored(docs_of([]), labels.limit(0)).count() == 0
    assert {r.score for r in scored(docs, labels.limit(0)).collect()} == {0.5}
