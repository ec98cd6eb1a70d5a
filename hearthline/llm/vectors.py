"""Embedding near-duplicates: pairs of a label with cosine at the threshold, by randomly rotated binary codes.

A vector is normalised and turned by fixed random rotations, once. What is stored of it are the signs of the first rotation, its
code, with the code's own inner product with the vector as correction factor, and the turned vector in PLANES bits a component:
code . other / factor estimates the cosine to another vector without bias, with an error of about
EPSILON * sqrt((1 - factor**2) / (factor**2 * (dim - 1))) at most, and of residual / factor for the other's rounding, whose length
is stored too. It is counted from the bits (code AND planes). Only these few bytes are shuffled by bands. Pairs whose upper bound
stays below the threshold are dropped; the full vectors of the others' rows are then fetched for their tile, in the first band in
which they meet, and the cosine in double precision from the vectors as given alone decides.

Pairs are looked for among vectors that agree on all bits of a band. The number of bits follows the largest label's size, and so
many bands are used that a pair exactly at the threshold meets with a chance of RECALL at least (closer pairs more often). A pair
that meets in several bands counts in its first. Equal vectors of a label become one with a multiplicity beforehand. Blocks of more
than TILE vectors are cut into tiles, compared tile by tile, so no task gets an unbounded block, and what leaves a tile is a count
of links and one edge per vector, not the pairs.

Vectors that are null, zero, or hold null or non-finite components, and those without a label or id, link with nothing and are kept.
Vectors of different lengths do not link. Rows that share an id are vectors of their own; their links count for each. Other columns
are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import small_batches, written
from hearthline.llm.components import components

RECALL, EPSILON, TILE, BLOCK = 0.9999, 4.5, 1024, 512
#: Bits of a component of the vector that a code is compared with.
PLANES = 6
#: Cut blocks are broadcast up to so many rows, and joined beyond.
BROADCAST_ROWS = 50_000


@lru_cache(maxsize=8)
def rotations(dim: int, n: int) -> np.ndarray:
    rng = np.random.default_rng(20_000 + dim)
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])


def plan(largest: int, threshold: float) -> tuple[int, int]:
    """(bits of a band, bands): about BLOCK vectors of the largest label agree in a band by chance."""
    bits = min(24, max(3, math.ceil(math.log2(max(1, largest) / BLOCK))))
    meets = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - meets))


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def bands_of(units: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """Band values of each vector, from the signs of as many rotations as they need."""
    dim = units.shape[1]
    n = -(-bits * bands // dim)
    signs = np.concatenate([units @ r.T for r in rotations(dim, n)], axis=1)[:, : bits * bands] >= 0
    return (signs.reshape(len(units), bands, bits) << np.arange(bits)).sum(axis=2).astype(np.int32)


@dataclass(slots=True)
class Codes:
    """Of some unit vectors: sign bits (row, word), planes of the turned vector (row, plane, word), and stats (row, 4): the factor, the
    least component, the step between two values, and the length of what rounding leaves."""

    dim: int
    signs: np.ndarray
    planes: np.ndarray
    stats: np.ndarray


def encoded(units: np.ndarray) -> Codes:
    n, dim = units.shape
    words = -(-dim // 64)

    def packed(bits: np.ndarray) -> np.ndarray:
        out = np.zeros((n, 8 * words), np.uint8)
        out[:, : -(-dim // 8)] = np.packbits(bits, axis=1, bitorder="little")
        return out.view(np.uint64)

    turned = units @ rotations(dim, 1)[0].T
    least = turned.min(axis=1)
    step = (turned.max(axis=1) - least) / ((1 << PLANES) - 1)
    level = np.rint((turned - least[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
    left = turned - least[:, None] - step[:, None] * level
    stats = np.stack([np.abs(turned).sum(axis=1) / math.sqrt(dim), least, step, np.sqrt((left * left).sum(axis=1))], axis=1)
    planes = np.stack([packed(level >> p & 1) for p in range(PLANES)], axis=1)
    return Codes(dim, packed(turned >= 0), planes, stats)


def open_pairs(x: Codes, y: Codes, threshold: float) -> np.ndarray:
    """Which pairs the codes of x leave open: estimate plus bound reaches the threshold."""
    factor, (_, least, step, left) = x.stats[:, :1], y.stats.T
    both = np.zeros((len(x.signs), len(y.signs)), np.int32)  # levels summed where the code is positive
    for p in range(PLANES):
        for w in range(x.signs.shape[1]):
            both += np.bitwise_count(x.signs[:, None, w] & y.planes[None, :, p, w]).astype(np.int32) << p
    ones = np.bitwise_count(x.signs).sum(axis=1, dtype=np.int64)[:, None]
    levels = (np.bitwise_count(y.planes).sum(axis=2, dtype=np.int64) << np.arange(PLANES)).sum(axis=1)
    estimate = (2 * (least * ones + step * both) - (least * x.dim + step * levels)) / (math.sqrt(x.dim) * factor)
    bound = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2) / (factor**2 * max(1, x.dim - 1))) + left / factor
    return estimate + bound >= threshold - 1e-6


def possible(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of unit vectors their codes leave open."""
    return open_pairs(encoded(x), encoded(y), threshold)


def _first_met(x: Codes, y: Codes, bands_x: np.ndarray, bands_y: np.ndarray, band: int, same: bool, threshold: float):
    """Row numbers of the open pairs of a tile that meet in this band first, in parts."""
    pairs = open_pairs(x, y, threshold)
    left, right = np.nonzero(np.triu(pairs, 1) if same else pairs)
    for k in range(0, len(left), 1 << 16):
        a, b = left[k : k + (1 << 16)], right[k : k + (1 << 16)]
        first = (bands_x[a] == bands_y[b]).argmax(axis=1) == band
        yield a[first], b[first]


def _loaded(frame: pd.DataFrame) -> tuple[Codes, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, bands, keys and copies of the rows of a tile."""
    n, dim = len(frame), int(frame["dim"].iloc[0]) if len(frame) else 1
    words = -(-dim // 64)
    of = lambda name, kind, *shape: np.frombuffer(b"".join(frame[name]), kind).reshape(n, *shape)
    codes = Codes(dim, of("signs", np.uint64, words), of("planes", np.uint64, PLANES, words), of("stats", np.float64, 4))
    bands = of("bands", np.int32, len(frame["bands"].iloc[0]) // 4) if n else np.zeros((0, 1), np.int32)
    return codes, bands, frame["key"].to_numpy(), frame["copies"].to_numpy()


def _sides(frame: pd.DataFrame):
    """The frames of a tile pair's two sides (one twice for a tile with itself), or None if one is empty."""
    i, j = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    x, y = frame[frame["tile"] == i], frame[frame["tile"] == j]
    return (x, x if i == j else y, i == j, int(frame["band"].iloc[0])) if len(x) and len(y) else None


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """Per vector: the id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[label_column].cast("string").alias("label"), vectors[vector_column].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    # equal vectors of a label, told by two hashes: the least id stands for all
    rows = rows.withColumn("usable", usable).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    same = ["label", "h1", "h2"]
    nodes = written(rows.where("usable").groupBy(*same).agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")).withColumn("key", F.monotonically_increasing_id()), "vectors")
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits, bands = plan(largest, threshold)

    def coded(batches):
        for batch in batches:
            matrix = batch.column(2).to_pylist()
            dims = np.array([len(v) for v in matrix])
            out = [[b""] * len(matrix) for _ in range(4)]
            values = np.zeros((len(matrix), bands), np.int32)
            for dim in set(dims.tolist()):
                at = np.flatnonzero(dims == dim)
                units = unit(np.array([matrix[i] for i in at], np.float64))
                values[at] = bands_of(units, bits, bands)
                codes = encoded(units)
                for k, i in enumerate(at.tolist()):
                    out[0][i], out[1][i], out[2][i], out[3][i] = codes.signs[k].tobytes(), codes.planes[k].tobytes(), codes.stats[k].tobytes(), values[i].tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), pa.array(dims, pa.int32()), *(pa.array(o, pa.binary()) for o in out), pa.array(list(values), pa.list_(pa.int32()))],
                ["label", "key", "copies", "dim", "signs", "planes", "stats", "bands", "buckets"],
            )

    code, block = ["key", "copies", "signs", "planes", "stats", "bands"], ["label", "dim", "band", "bucket"]
    schema = "label string, key long, copies long, dim int, signs binary, planes binary, stats binary, bands binary, buckets array<int>"
    codes = written(nodes.select("label", "key", "v", "copies").mapInArrow(coded, schema), "codes")
    dealt = codes.select("label", "dim", *code, F.posexplode("buckets").alias("band", "bucket"))
    cut = written(dealt.groupBy(*block).count().where(F.col("count") > TILE).select(*block, F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "cut")
    cut = F.broadcast(cut) if len(cut.take(BROADCAST_ROWS + 1)) <= BROADCAST_ROWS else cut
    tiled = dealt.join(cut, block, "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    tiled = tiled.withColumn("tile", F.pmod(F.xxhash64("key", "band"), F.col("tiles").cast("long")).cast("int"))
    tile = [*block, "i", "j", "tile"]
    paired = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select(*block, F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", *code)

    def surviving(frame: pd.DataFrame) -> pd.DataFrame:
        none = frame.iloc[:0]
        if (sides := _sides(frame)) is None:
            return none
        x, y, same, band = sides
        (codes_x, bands_x, _, _), (codes_y, bands_y, _, _) = _loaded(x), _loaded(y)
        stay_x, stay_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
        for a, b in _first_met(codes_x, codes_y, bands_x, bands_y, band, same, threshold):
            stay_x[a] = stay_y[b] = True
        return x[stay_x | stay_y] if same else pd.concat([x[stay_x], y[stay_y]])

    open_rows = paired.groupBy(*block, "i", "j").applyInPandas(surviving, paired.select(*tile, *code).schema)
    fetched = written(open_rows, "open").join(nodes.select("key", "v"), "key")

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        if (sides := _sides(frame)) is None:
            return pd.DataFrame({"key": [], "links": [], "root": []}).astype("int64")
        x, y, same, band = sides
        (codes_x, bands_x, keys_x, copies_x), (codes_y, bands_y, keys_y, copies_y) = _loaded(x), _loaded(y)
        full_x, full_y = (unit(np.stack(f["v"].to_list()).astype(np.float64)) for f in (x, y))
        found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in _first_met(codes_x, codes_y, bands_x, bands_y, band, same, threshold):
            linked = np.einsum("ij,ij->i", full_x[a], full_y[b]) >= threshold
            found_a.append(a[linked]), found_b.append(b[linked])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        keys = keys_x if same else np.concatenate([keys_x, keys_y])
        shift = 0 if same else len(keys_x)
        links = np.bincount(a, copies_y[b], len(keys)) + np.bincount(b + shift, copies_x[a], len(keys))
        root = np.arange(len(keys))
        while True:  # least row of each linked group
            low = root.copy()
            np.minimum.at(low, a, root[b + shift])
            np.minimum.at(low, b + shift, root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        some = links > 0
        return pd.DataFrame({"key": keys[some], "links": links[some].astype(np.int64), "root": keys[root[some]]})

    found = written(fetched.groupBy(*block, "i", "j").applyInPandas(compared, "key long, links long, root long"), "links")
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    grouped = nodes.select("key", "node").join(joined.withColumnRenamed("node", "key"), "key", "left")
    names = grouped.groupBy(F.coalesce("component", "key").alias("component")).agg(F.min("node").alias("component_id"))
    per_node = grouped.select("key", F.coalesce("component", "key").alias("component")).join(names, "component").join(counts, "key", "left")
    answer = written(nodes.join(per_node, "key").select(*same, "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "answer")
    linked = rows.where("usable").select("vec_id", *same).join(answer, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    return out if id_column == "vec_id" else out.withColumnRenamed("vec_id", id_column)
