"""Best-fit packing of tokenised documents into sequences of bounded length, improved by swap-based local search.

Documents longer than a sequence are cut; a full piece is a sequence of its own. The rest is dealt at random into shards of
about SHARD_ROWS pieces, however many there are, and each shard is packed on its own: best fit in decreasing order, then
local search. The search takes the emptiest underfull sequence and moves a document out of it, or exchanges one for one, two for one
or one for two with another sequence, always so that the other one grows; the sum of squared fills then rises with every
step, so the search ends, and sequences that become empty go. It stops at once where a shard has as few sequences as its
tokens need.

Null texts count as empty (their one token is the end mark), null ids are packed like others. Very long texts are cut into as
many pieces as they need. Repeated rows are packed each on its own. Ties are broken by row order. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import small_batches, text_or_empty, written
from hearthline.llm.word_tokens import word_tokens

SHARD_ROWS = 4096
#: A bin with a larger share of its capacity free is one that the local search tries to empty.
UNDERFULL = 0.02


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of row numbers: longest first, each into the fullest bin with room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    has = 0  # bit r: some bin has room r
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        enough = has >> n
        if enough:
            room = n + (enough & -enough).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                has &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        by_room[room - n].append(at)
        has |= 1 << (room - n)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Fewer bins where moves and exchanges empty underfull ones (those with more than UNDERFULL of the capacity free), the
    emptiest first, in rounds over all of them; it ends once a round finds no step out of any, or where all bins together need as many
    as there are."""
    bins = [b for b in bins if b]
    size = np.array(lengths, np.int64)
    at = np.zeros(len(size), np.int64)
    for k, members in enumerate(bins):
        at[members] = k
    room = np.array([capacity - sum(lengths[i] for i in b) for b in bins], np.int64)
    alive = np.ones(len(bins), bool)
    least, given_up, moved = -(-int(size.sum()) // capacity), np.zeros(len(bins), bool), False
    failed: set[bytes] = set()  # contents of bins out of which this round found no step: what is alike fares alike
    while alive.sum() > least:
        sources = np.where(alive & ~given_up, room, 0)
        source = int(sources.argmax())
        if sources[source] <= UNDERFULL * capacity:
            if not moved:
                break
            given_up[:] = False  # what was moved since may have opened a step
            failed.clear()
            moved = False
            continue
        contents = np.sort(size[at == source]).tobytes()
        step = None if contents in failed else _step(size, at, np.where(alive & (room <= room[source]), room, 0), source)
        if step is None:
            given_up[source] = True
            failed.add(contents)
            continue
        target, out, back = step
        gain = int(size[out].sum() - size[back].sum())
        at[out], at[back] = target, source
        room[target] -= gain
        room[source] += gain
        alive[source] = room[source] < capacity
        moved = True
    order = np.argsort(at, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(at[order])) + 1) if len(order) else []
    return [p.tolist() for p in parts]


def _step(size: np.ndarray, at: np.ndarray, room: np.ndarray, source: int) -> tuple[int, list[int], list[int]] | None:
    """(target bin, documents out of the source, documents back): the first of move, one for one, two for one, one for two that
    makes another bin fuller, the largest document first and by as much as it can."""
    mine = np.flatnonzero(at == source)
    mine = mine[np.argsort(-size[mine], kind="stable")].tolist()
    room = room.copy()
    room[source] = 0
    for i in mine:  # into the fullest bin with room
        fits = np.flatnonzero(room >= size[i])
        if len(fits):
            return int(fits[np.argmin(room[fits])]), [i], []
    others = np.flatnonzero(room[at] > 0)
    theirs, most = size[others], size[others] + room[at[others]]

    def swapped(give: list[int]):
        total = int(size[give].sum())
        fits = np.flatnonzero((theirs < total) & (total <= most))
        if not len(fits):
            return None
        j = int(others[fits[np.argmin(theirs[fits])]])
        return int(at[j]), give, [j]

    tried = set()
    for give in ([i] for i in mine):
        if (total := int(size[give].sum())) not in tried and (step := swapped(give)):
            return step
        tried.add(total)
    for give in ([i, j] for k, i in enumerate(mine) for j in mine[k + 1 :]):
        if (total := int(size[give].sum())) not in tried and (step := swapped(give)):
            return step
        tried.add(total)
    left, right = _pairs(at, others)
    pairs, limit = size[left] + size[right], room[at[left]]
    for i in mine:
        fits = np.flatnonzero((pairs < size[i]) & (size[i] <= pairs + limit))
        if len(fits):
            j = fits[np.argmin(pairs[fits])]
            return int(at[left[j]]), [i], [int(left[j]), int(right[j])]
    return None


def _pairs(at: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of members of one bin, bin after bin."""
    by_bin = members[np.argsort(at[members], kind="stable")]
    bins = at[by_bin]
    end = np.searchsorted(bins, bins, side="right")
    after = end - np.arange(len(by_bin)) - 1  # how many of its bin come after each
    left = np.repeat(np.arange(len(by_bin)), after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    return by_bin[left], by_bin[right]


def pieces(docs: DataFrame, vocabulary: str, max_tokens: int, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece of a document: the id, piece, start, length, ids_crc32, with keep_ids the ids."""
    small_batches(docs.sparkSession)
    slim = docs.select(docs[id_column], text_or_empty(text_column).alias("text"))
    kind = slim.schema[id_column].dataType.simpleString()

    def run(batches):
        use = word_tokens(vocabulary)
        for batch in batches:
            at, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                all_ids = np.append(use.encode_ids(text), end_id).astype("<u4")
                for k, begin in enumerate(range(0, len(all_ids), max_tokens)):
                    part = all_ids[begin : begin + max_tokens]
                    at.append(row), piece.append(k), start.append(begin), length.append(len(part)), crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [id_column, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return slim.mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def pack(docs: DataFrame, vocabulary: str, max_tokens: int = 2048, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: within a sequence, offsets run without gaps from 0."""
    cut = written(pieces(docs, vocabulary, max_tokens, end_id, id_column, text_column, keep_ids).withColumn("row_no", F.monotonically_increasing_id()), "pieces")
    full = cut.where(F.col("length") == max_tokens)
    short = cut.where(F.col("length") < max_tokens)
    shards = max(1, -(-short.count() // SHARD_ROWS))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row_no")
        shard, rows, lengths = int(frame["shard"].iloc[0]), frame["row_no"].tolist(), frame["length"].tolist()
        out = []
        for k, members in enumerate(local_search(best_fit(lengths, max_tokens), lengths, max_tokens)):
            offset = 0
            for i in members:
                out.append((rows[i], -1 - ((shard << 24) + k), offset))
                offset += lengths[i]
        return pd.DataFrame(out, columns=["row_no", "sequence_id", "offset"])

    dealt = short.select("row_no", "length", F.pmod(F.xxhash64("row_no"), F.lit(shards)).alias("shard"))
    places = dealt.groupBy("shard").applyInPandas(packed, "row_no long, sequence_id long, offset long")
    placed = short.join(places, "row_no").unionByName(full.withColumns({"sequence_id": F.col("row_no"), "offset": F.lit(0).cast("long")}))
    return placed.drop("row_no")
