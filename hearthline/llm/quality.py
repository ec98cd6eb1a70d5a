"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per document, softmax on top.

Features are the words of a text (runs of non-space bytes, case kept) and the byte n-grams of NGRAMS within a word or at its
edges, each hashed into one of BUCKETS learned vectors. A document is the mean of its vectors; the softmax weighs the mean and its
squares, as the mean of a text that says one thing again and again stays long, whatever it says, and that of prose gets short.
Training is stochastic gradient descent in numpy, one document at a time, on a bounded sample: of each label the max_per_label
documents whose ids hash lowest (of rows that share an id, the one with the least text), both labels weighing the same; the bias
then takes in how frequent each label is among all known ones. Executors count the sample's features, one task learns from these counts of at
most 2 * max_per_label documents, and the model, BUCKETS * DIM floats, goes to the shared folder, from where tasks load it.

Whole texts are read, in parts of PART features at a time. A text without features scores as its bias says; null
texts count as empty. Labels that are null are not learned from, of repeated labels the highest counts; where only one label
or none is known, all scores are 1, 0 or 0.5. Repeated rows score alike, null ids too, and an empty table gives no rows. Other columns are ignored, and lang, source and the id are never inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import loaded, small_batches, text_or_empty, word_hashes, written

BUCKETS = 1 << 18
NGRAMS = (2, 3, 4)
#: Numbers of a vector; how many times the squares weigh before anything is learned, so that they are about 1 for a single word;
#: how fast their weights are learned next to the others, and the most that one step moves a number of a vector.
DIM = 8
SQUARES, SQUARES_RATE, MOST_MOVED = 3 * DIM * DIM, 0.3, 0.05
#: Features whose vectors are added up at once.
PART = 1 << 16
#: Features with a vector of zero that every document is padded with, so that a few odd features don't decide on a short one.
PADDING = 16
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str) -> np.ndarray:
    """Bucket numbers of all features of a text, repeated as often as they occur."""
    data = np.frombuffer(b" " + text.encode("utf-8", "replace") + b" ", np.uint8)
    space = _SPACE[data]
    words = word_hashes(data, space)[0]
    if not len(words):
        return np.zeros(0, np.int64)
    found = [words & np.uint64(BUCKETS - 1)]
    wide = data.astype(np.uint32)
    gram = wide
    inner = np.zeros(len(data), bool)  # whether a byte strictly inside the n-gram is a space
    for n in range(2, max(NGRAMS) + 1):
        if n > len(data):
            break
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(data) - 1]
        else:
            inner = inner[:-1]
        gram = gram[:-1] * np.uint32(0x01000193) ^ wide[n - 1 :]
        if n in NGRAMS:
            hashed = gram * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            keep = ~inner & ~(space[: len(gram)] & space[n - 1 :])
            found.append(((hashed ^ hashed >> np.uint32(15)) & np.uint32(BUCKETS - 1))[keep])
    return np.concatenate([f.astype(np.int64) for f in found])


@dataclass(frozen=True)
class Model:
    """Vectors by bucket, weights of their mean and of its squares (label 1 less label 0), bias."""

    vectors: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found = features(text)
        mean = np.zeros(DIM)
        for k in range(0, len(found), PART):
            mean += self.vectors.take(found[k : k + PART], axis=0).sum(axis=0, dtype=np.float64)
        mean /= len(found) + PADDING
        x = float(self.weights[:DIM] @ mean + self.weights[DIM:] @ (SQUARES * mean * mean)) + self.bias
        return 1 / (1 + math.exp(-min(max(x, -30.0), 30.0)))

    def shifted(self, by: float) -> Model:
        return replace(self, bias=self.bias + by)

    def to_bytes(self) -> bytes:
        return np.concatenate([self.weights.astype("<f4"), self.vectors.astype("<f4").ravel()]).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, bias: float) -> Model:
        numbers = np.frombuffer(data, "<f4")
        return cls(numbers[2 * DIM :].reshape(BUCKETS, DIM), numbers[: 2 * DIM].astype(np.float64), bias)


@dataclass(frozen=True)
class Stored:
    """A learned model in the shared folder, which tasks load by themselves, and what its bias lacks; nothing known: path None."""

    path: str | None
    shift: float = 0.0

    def load(self) -> Model:
        return _loaded(self.path).shifted(self.shift)


@lru_cache(maxsize=2)
def _loaded(path: str | None) -> Model:
    rows = loaded(path).to_pylist() if path else []
    return Model.from_bytes(rows[0]["model"], rows[0]["bias"]) if rows else train([])


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.6, seed: int = 7) -> Model:
    """samples: distinct bucket numbers, their counts, label 0 or 1."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    of_mean, of_squares, bias = np.zeros((2, DIM), np.float32), np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    labels = np.array([y for _, _, y in samples])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros((BUCKETS, DIM), np.float32), np.zeros(2 * DIM), float({0: -30.0, 1: 30.0}.get(labels[0], 0.0) if len(labels) else 0.0))
    weight = np.array([len(labels) / (2 * np.sum(labels == y)) for y in (0, 1)], np.float32)
    shares = [(c / (c.sum() + PADDING)).astype(np.float32)[:, None] if len(c) else np.zeros((0, 1), np.float32) for _, c, _ in samples]
    steps, done, squares = epochs * len(samples), 0, np.float32(SQUARES)
    for _ in range(epochs):
        for k in rng.permutation(len(samples)):
            buckets, _, y = samples[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = (vectors[buckets] * shares[k]).sum(axis=0)
            squared = squares * mean * mean
            logits = of_mean @ mean + of_squares @ squared + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            error = p.copy()
            error[y] -= 1
            error *= lr * weight[y]
            to_vectors = np.clip(error @ of_mean + (error @ of_squares) * (2 * squares * mean), -MOST_MOVED, MOST_MOVED)
            of_mean -= np.outer(error, mean)
            of_squares -= SQUARES_RATE * np.outer(error, squared)
            bias -= 0.1 * error
            # a document's mean moves by the full gradient: shares are scaled to sum to one over their own square sum
            scale = 1 / max(float((shares[k] ** 2).sum()), 1e-6) if len(buckets) else 0.0
            vectors[buckets] -= shares[k] * (min(scale, 50.0) * to_vectors)
    return Model(vectors, np.concatenate([of_mean[1] - of_mean[0], of_squares[1] - of_squares[0]]).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, max_per_label: int = 1500, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> Stored:
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_column).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("label"))
    order = [F.xxhash64(id_column), F.col(id_column)]
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("label") == y).orderBy(*order).limit(max_per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    # at most 2 * max_per_label rows of an id and a label
    sample = docs.select(docs[id_column], text_or_empty(text_column).alias("text"))
    joined = sample.join(F.broadcast(chosen), id_column).groupBy(id_column, "label").agg(F.min("text").alias("text")).select(id_column, "text", "label")

    def run(batches):
        for batch in batches:
            rows = [np.unique(features(t), return_counts=True) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([b.astype(np.int32) for b, _ in rows], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32())), batch.column(2).cast(pa.int32())],
                [id_column, "buckets", "counts", "label"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    counted = joined.mapInArrow(run, f"`{id_column}` {kind}, buckets array<int>, counts array<int>, label int")

    def learn(batches):
        """The sample is at most 2 * max_per_label rows, so one task holds it; the order of rows does not matter."""
        rows = []
        for batch in batches:
            arrays = [[x.values.to_numpy() for x in batch.column(c)] for c in (1, 2)]  # views, no Python numbers
            rows += zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), *arrays, strict=True)
        rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))
        model = train([(b, c, y) for _, y, b, c in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["model", "bias"])

    path = written(counted.repartition(1).mapInArrow(learn, "model binary, bias double"), "model").stored_at  # one row of a fixed size
    shares = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows at most
    return Stored(path, math.log(shares[1] / shares[0]) if len(shares) == 2 else 0.0)


def score(docs: DataFrame, model: Model | Stored, id_column: str = "doc_id", text_column: str = "text", out: str = "score", keep: tuple[str, ...] = ()) -> DataFrame:
    """The id, the columns of keep, and the score."""
    small_batches(docs.sparkSession)

    def run(batches):
        use = model.load() if isinstance(model, Stored) else model  # BUCKETS * DIM floats, whatever the corpus
        for batch in batches:
            scores = [use.score(t or "") for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (id_column, *keep)], pa.array(scores, pa.float64())], [id_column, *keep, out])

    slim = docs.select(*[docs[c] for c in (id_column, *keep)], text_or_empty(text_column).alias("__text"))
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (id_column, *keep))
    return slim.mapInArrow(run, f"{kinds}, `{out}` double")


def is_held_out(id_column: str = "doc_id"):
    """Documents whose labels are never learned from."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(3)) == 1


def scored(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: the id, held_out (null ids: false), score, predicted."""
    model = fit(docs, labels.where(~is_held_out(id_column)), id_column=id_column)
    found = score(docs, model, id_column)
    return found.select(id_column, F.coalesce(is_held_out(id_column), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def kept(docs: DataFrame, model: Model | Stored, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score reaches the threshold."""
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_column)

    def run(batches):
        use = model.load() if isinstance(model, Stored) else model
        for batch in batches:
            yield batch.filter(pa.array([use.score(t or "") >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
