"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, counted over a corpus.

Side A encodes a space and the text with a byte-level vocabulary, side B the text with a SentencePiece vocabulary that adds the
space. Byte offsets at which tokens of both sides end cut both into groups; within a group every A token is linked with every B
token. An id pair's count is the number of documents (rows) in which it is linked.

A text is cut into chunks before a space that follows a character that is no white space: both vocabularies split there, so a
document's tokens, groups and links are those of its chunks, which repeat and are remembered (a bounded number). Encoding tasks
write, for each document, its figures and its distinct links, striped by A id modulo STRIPES, and for each stripe the counts of
the pairs that the task saw (so a pair is added up before it is shuffled). The counts of a stripe are added with np.add.at into
dense blocks of ROWS A ids by all B ids, in levels of sixteen tasks; row maxima give the best partners of each A id. Documents'
links, dealt by stripe and part of the documents, are then scored in cogroups with the counts of their stripe. A document has
one row in a stripe at most, so no id, however frequent, makes a group large, and parts bound the documents of a group.

Texts that are null, empty or whose tokens of one side do not join to the bytes of a space and the text (as those with a U+2581)
have no tokens: zeros, and an empty groups_sha256. Null ids, repeated rows (each counts as a document) and other columns are
allowed; one row goes out for each that comes in. Special tokens' strings are plain text. Without white space a chunk is as long
as the text; a group's links are kept as pairs of distinct ids with multiplicities.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import small_batches, text_or_empty, written
from hearthline.llm.sentence_pieces import Memo
from hearthline.llm.word_tokens import _byte_letters

STRIPES, ROWS = 32, 128
#: Documents of a part: as many links, of a stripe, are scored at once.
PART_DOCS = 100_000
#: A task keeps so many pairs before it adds up those that are equal.
HELD = 4_000_000
_SPACE = "▁"
#: A chunk starts at a space after a character that no vocabulary's pattern could take for white space.
_WHITE = r"\s\x1c-\x1f\x85᠎​⁠﻿"
_CHUNKS = re.compile(f"(?<=[^{_WHITE}])(?= )")
_WHITE_THEN_SPACE = re.compile(f"[{_WHITE}] ")
#: Groups of more pairs than this are reduced to pairs of distinct ids.
LARGE = 4096


class Aligner:
    """Both vocabularies. max_memo bounds the number of remembered chunks."""

    def __init__(self, path_a: str, path_b: str, max_memo: int = 200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        of_letter = {c: b for b, c in enumerate(_byte_letters())}
        n_a, n_b = self.a.get_vocab_size(), self.b.get_piece_size()
        self.width = n_b
        if -(-n_a // STRIPES) * n_b >= 1 << 32:
            raise ValueError("the vocabularies are too large for 32-bit places within a stripe")
        shown = [self.a.id_to_token(i) for i in range(n_a)]
        self.bytes_a = [bytes(map(of_letter.__getitem__, t)) if t and all(c in of_letter for c in t) else (t or "").encode() for t in shown]
        texts = [self.b.id_to_piece(i) for i in range(n_b)]
        self.bytes_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(_SPACE, " ").encode() for i, t in enumerate(texts)]
        self.space = self.b.piece_to_id(_SPACE)
        pairs = {p[i : i + 2] for p in texts for i in range(len(p) - 1)}
        #: Whether chunks are encoded as they are within their texts.
        self.cut = not any(pair[1] == _SPACE != pair[0] for pair in pairs) and self.b.normalize("a  b ") == "▁a▁▁b▁"
        self.lengths_a, self.lengths_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        #: Decimal ids with what may follow them: another of the group, the other side, the next group, nothing.
        self.shown = [f"{i}{after}" for after in (",", "|", ";", "") for i in range(max(n_a, n_b))]
        self.memo = Memo(max_memo)

    def chunks(self, text: str) -> list[str]:
        text = f" {text}"
        if not self.cut:
            return [text]
        if _WHITE_THEN_SPACE.search(text):
            return _CHUNKS.split(text)
        return [f" {part}" for part in text[1:].split(" ")]

    def _joins(self, chunks: list[bytes], a: list[list[int]], b: list[list[int]]) -> np.ndarray:
        """Whether the tokens of both sides of each chunk join to its bytes."""
        whole, sizes = b"".join(chunks), np.array([len(c) for c in chunks])
        same = True
        for side, lengths, all_ids in ((self.bytes_a, self.lengths_a, a), (self.bytes_b, self.lengths_b, b)):
            flat = list(chain.from_iterable(all_ids))
            starts = np.cumsum([0, *map(len, all_ids)])[:-1]
            same = same and bool((np.add.reduceat(lengths[flat], starts) == sizes).all()) and b"".join(map(side.__getitem__, flat)) == whole
        if same:
            return np.ones(len(chunks), bool)
        joined = lambda side, ids: b"".join([side[i] for i in ids])
        return np.array([joined(self.bytes_a, x) == joined(self.bytes_b, y) == c for c, x, y in zip(chunks, a, b, strict=True)], bool)

    def _aligned(self, chunks: list[str]) -> dict[str, tuple | None]:
        """Of each chunk (n_a, n_b, n_groups, n_links, groups as text, pairs a * width + b and their multiplicities as bytes); None if
        its tokens do not join to it."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        b = [ids or [self.space] for ids in self.b.encode([c[1:] for c in chunks], num_threads=1)]
        good = self._joins([c.encode("utf-8", "replace") for c in chunks], a, b)
        out: dict[str, tuple | None] = dict.fromkeys(chunks)
        held = [(c, x, y) for c, x, y, ok in zip(chunks, a, b, good.tolist(), strict=True) if ok]
        for start in range(0, len(held), 20_000):
            some = held[start : start + 20_000]
            out.update(zip([c for c, _, _ in some], self._groups([x for _, x, _ in some], [y for _, _, y in some]), strict=True))
        return out

    def _groups(self, a: list[list[int]], b: list[list[int]]) -> list[tuple]:
        """What _aligned() tells of chunks with these ids, all of them at once: their bytes are thought of one after the other."""
        ids = [np.array(list(chain.from_iterable(side)), np.int64) for side in (a, b)]
        ends = [np.cumsum(lengths[x]) for lengths, x in zip((self.lengths_a, self.lengths_b), ids, strict=True)]
        cuts = np.intersect1d(*ends, assume_unique=True)
        group = [np.searchsorted(cuts, e) for e in ends]
        size = [np.bincount(g, minlength=len(cuts)) for g in group]
        first = [np.cumsum(n) - n for n in size]
        chunk_ends = [np.cumsum([len(x) for x in side]) for side in (a, b)]
        group_ends = group[0][chunk_ends[0] - 1] + 1  # of chunks: they end with a group
        # the text: ids in the order of group and side, each with what follows it
        last = [np.append(g[1:] != g[:-1], True) for g in group]
        after = [last[0] * 1, last[1] * 2]
        after[1][chunk_ends[1] - 1] = 3
        order = np.argsort(np.concatenate([2 * group[0], 2 * group[1] + 1]), kind="stable")
        shown = np.concatenate([ids[k] + after[k] * (len(self.shown) // 4) for k in (0, 1)])[order]
        texts = list(map(self.shown.__getitem__, shown.tolist()))
        # the pairs: each A token with all B tokens of its group; of large groups distinct ids with multiplicities
        n_pairs = size[0] * size[1]
        large = np.flatnonzero(n_pairs > LARGE)
        each = np.where(n_pairs > LARGE, 0, size[1])[group[0]]
        of_a = np.repeat(np.arange(len(ids[0])), each)
        place = np.arange(len(of_a)) - np.repeat(np.cumsum(each) - each, each)
        keys = ids[0][of_a] * self.width + ids[1][first[1][group[0][of_a]] + place]
        times, owner = np.ones(len(keys), np.int64), group[0][of_a]
        for g in large.tolist():
            (x, n_x), (y, n_y) = (np.unique(ids[k][first[k][g] : first[k][g] + size[k][g]], return_counts=True) for k in (0, 1))
            keys, times = np.append(keys, (x[:, None] * self.width + y).ravel()), np.append(times, (n_x[:, None] * n_y).ravel())
            owner = np.append(owner, np.full(len(x) * len(y), g))
        if len(large):
            order = np.argsort(owner, kind="stable")
            keys, times, owner = keys[order], times[order], owner[order]
        key_ends = np.searchsorted(owner, group_ends)
        n_links = np.diff(np.concatenate(([0], np.cumsum(n_pairs)))[np.concatenate(([0], group_ends))])
        keys, times = keys.astype("<u8").tobytes(), times.astype("<i8").tobytes()
        text_ends = chunk_ends[0] + chunk_ends[1]
        out, i, t, g = [], 0, 0, 0
        for x, y, links, to_key, to_text, to_group in zip(a, b, n_links.tolist(), (8 * key_ends).tolist(), text_ends.tolist(), group_ends.tolist(), strict=True):
            out.append((len(x), len(y), to_group - g, links, "".join(texts[t:to_text]), keys[i:to_key], times[i:to_key]))
            i, t, g = to_key, to_text, to_group
        return out

    def align_batch(self, texts: list[str]) -> list[list[tuple] | None]:
        """Of each text what its chunks hold; None without tokens."""
        cut = [self.chunks(t) if t and _SPACE not in t else [] for t in texts]
        memo = self.memo.of(set(chain.from_iterable(cut)), self._aligned)
        out = []
        for chunks in cut:
            found = [memo[c] for c in chunks]
            out.append(found if found and None not in found else None)
        return out


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[starts], np.add.reduceat(counts, starts)


class _Seen:
    """How many documents of a task hold each pair; a key is stripe << 32 | place within the stripe."""

    def __init__(self) -> None:
        self.keys, self.counts, self.held = [], [], 0

    def add(self, keys: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(np.ones(len(keys), np.int64))
        self.held += len(keys)
        if self.held > HELD:
            self.done()

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = _summed(np.concatenate(self.keys), np.concatenate(self.counts)) if self.keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        # what is distinct stays, and the next pairs are gathered beside it
        self.keys, self.counts, self.held = [keys], [counts], 0
        return keys, counts


def _binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary array of the slices of values that begin at starts."""
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


_PLACE = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(32)
_STRIPED = [("stripe", pa.int32()), ("places", pa.binary()), ("numbers", pa.binary())]


def _striped(keys: np.ndarray, numbers: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """For each of n rows its list of (stripe, places, numbers); keys are in order within their rows."""
    stripe = (keys >> _HIGH).astype(np.int32)
    change = np.concatenate(([True], (rows[1:] != rows[:-1]) | (stripe[1:] != stripe[:-1]))) if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(change)
    values = pa.StructArray.from_arrays([pa.array(stripe[starts]), _binaries((keys & _PLACE).astype("<u4"), starts), _binaries(numbers, starts)], [name for name, _ in _STRIPED])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[starts], np.arange(n + 1)), pa.int32()), values)


_LINKS = "array<struct<stripe:int,places:binary,numbers:binary>>"
_ENCODED = f"key long, id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links {_LINKS}, task int, counts {_LINKS}"


def _encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Per document a row with a key, its figures and links; per task a row (null key) with the counts of pairs."""
    names = [part.split()[0] for part in _ENCODED.split(", ")]

    def run(batches):
        own = aligner(path_a, path_b)
        width, task = np.uint64(own.width), TaskContext.get().partitionId()
        seen, n_rows = _Seen(), 0
        for batch in batches:
            n = batch.num_rows
            figures, shas, pairs, times, rows = np.zeros((4, n), np.int64), [], [], [], []
            for i, chunks in enumerate(own.align_batch(batch.column(1).to_pylist())):
                if chunks is None:
                    shas.append("")
                    continue
                *sizes, shown, keys, many = zip(*chunks, strict=True)
                figures[:, i] = [sum(s) for s in sizes]
                shas.append(hashlib.sha256(";".join(shown).encode()).hexdigest())
                pairs.append(np.frombuffer(b"".join(keys), "<u8"))
                times.append(np.frombuffer(b"".join(many), "<i8"))
                rows.append(np.full(len(pairs[-1]), i, np.int64))
            pairs, times, rows = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((pairs, "<u8"), (times, "<i8"), (rows, np.int64)))
            a, b = np.divmod(pairs, width)
            keys = (a % np.uint64(STRIPES)) << _HIGH | (a // np.uint64(STRIPES)) * width + b
            order = np.lexsort((keys, rows))
            keys, times, rows = keys[order], times[order], rows[order]
            starts = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])))) if len(keys) else np.zeros(0, np.int64)
            keys, rows = keys[starts], rows[starts]
            times = np.add.reduceat(times, starts) if len(starts) else times
            seen.add(keys)
            key = np.arange(n_rows, n_rows + n) + (task << 33)
            n_rows += n
            none = pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.struct(_STRIPED)))
            yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), *map(pa.array, figures), pa.array(shas, pa.string()), _striped(keys, times.astype("<u4"), rows, n), *none], names)
        if n_rows:
            keys, counts = seen.done()
            counts = _striped(keys, counts.astype("<i8"), np.zeros(len(keys), np.int64), 1)
            empty = [pa.nulls(1, pa.int64())] * 6 + [pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.struct(_STRIPED)))]
            yield pa.RecordBatch.from_arrays([*empty, pa.array([task], pa.int32()), counts], names)

    return docs.mapInArrow(run, _ENCODED)


def _blocks(places: np.ndarray, width: int):
    """The dense blocks that places, in order, fall into: the first place of each, and from where to where its places stand."""
    size = ROWS * width
    for block in np.unique(places // size):
        yield block * size, *np.searchsorted(places, [block * size, (block + 1) * size])


def added(places: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places in order, and their sums, by one dense block after the other."""
    order = np.argsort(places, kind="stable")
    places, counts = places[order].astype(np.int64), counts[order]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for first, start, end in _blocks(places, width):
        block = np.zeros(ROWS * width, np.int64)
        np.add.at(block, places[start:end] - first, counts[start:end])
        held = np.flatnonzero(block)
        out.append((held + first, block[held]))
    return np.concatenate([p for p, _ in out]), np.concatenate([n for _, n in out])


def _counts(encoded: DataFrame, width: int) -> DataFrame:
    """Per stripe one row with the counts of its pairs: stripe, places, numbers. Added up in levels of sixteen tasks' rows."""
    rows = encoded.where("counts is not null").select("task", F.explode("counts").alias("of")).select("task", "of.*")

    def add(table):
        places = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("places").to_pylist()])
        places, counts = added(places, np.concatenate([np.frombuffer(x, "<i8") for x in table.column("numbers").to_pylist()]), width)
        first = lambda name: table.column(name).slice(0, 1).to_pylist()
        return pa.table({"task": pa.array(first("group"), pa.int32()), "stripe": pa.array(first("stripe"), pa.int32()), "places": pa.array([places.astype("<u4").tobytes()]), "numbers": pa.array([counts.astype("<i8").tobytes()])})

    n = encoded.where("counts is not null").count()
    while True:
        n = -(-n // 16)
        level = rows.withColumn("group", F.pmod("task", F.lit(max(1, n))).cast("int")).groupBy("stripe", "group")
        rows = written(level.applyInArrow(add, "task int, stripe int, places binary, numbers binary"), "counts")
        if n <= 1:
            return rows.drop("task")


def scored(places: np.ndarray, times: np.ndarray, held: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of links at places (any order): how many of them are their A id's best, and the sum of their counts. held, counts: the stripe's."""
    best, sums = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
    order = np.argsort(places, kind="stable")
    sorted_places = places[order].astype(np.int64)
    for first, start, end in _blocks(sorted_places, width):
        block = np.zeros(ROWS * width, np.int64)
        low, high = np.searchsorted(held, [first, first + ROWS * width])
        block[held[low:high] - first] = counts[low:high]
        top = block.reshape(ROWS, width).max(axis=1)
        at, own = sorted_places[start:end] - first, order[start:end]
        best[own] = np.where(block[at] == top[at // width], times[own], 0)
        sums[own] = block[at] * times[own]
    return best, sums


def _scores(encoded: DataFrame, counts: DataFrame, width: int) -> DataFrame:
    """Per document and stripe: key, n_best, count_sum."""
    parts = 1 + encoded.where("key is not null").count() // PART_DOCS
    links = encoded.where("key is not null").select("key", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part"), F.explode("links").alias("of")).select("key", "part", "of.*")
    dealt = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "places", "numbers")

    def score(left, right):
        own = left.column("places").to_pylist()
        places = np.concatenate([np.frombuffer(x, "<u4") for x in own]) if own else np.zeros(0, "<u4")
        times = np.concatenate([np.frombuffer(x, "<u4") for x in left.column("numbers").to_pylist()]).astype(np.int64) if own else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(own)), [len(x) // 4 for x in own])
        held, counts = (np.frombuffer(right.column(name)[0].as_py(), kind).astype(np.int64) if right.num_rows else np.zeros(0, np.int64) for name, kind in (("places", "<u4"), ("numbers", "<i8")))
        best, sums = scored(places, times, held, counts, width)
        totals = []
        for values in (best, sums):
            total = np.zeros(len(own), np.int64)
            np.add.at(total, of, values)
            totals.append(pa.array(total))
        return pa.table([left.column("key").combine_chunks() if own else pa.nulls(0, pa.int64()), *totals], ["key", "n_best", "count_sum"])

    return links.groupBy("stripe", "part").cogroup(dealt.groupBy("stripe", "part")).applyInArrow(score, "key long, n_best long, count_sum long")


def _tables(docs: DataFrame, path_a: str, path_b: str, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, int]:
    small_batches(docs.sparkSession)
    width = aligner(path_a, path_b).width
    encoded = written(_encoded(docs.select(docs[id_column].cast("long").alias("id"), text_or_empty(text_column).alias("text")), path_a, path_b), "aligned")
    return encoded, _counts(encoded, width), width


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    encoded, counts, width = _tables(docs, path_a, path_b, id_column, text_column)
    sums = _scores(encoded, counts, width).groupBy("key").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    own = encoded.where("key is not null").select("key", F.col("id").alias(id_column), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    return own.join(sums, "key", "left").select(id_column, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def translation(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each A id that is linked its best partners (ties included): id_a, id_b, n_docs."""
    _, counts, width = _tables(docs, path_a, path_b, id_column, text_column)

    def best(batches):
        for batch in batches:
            for stripe, places, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                places, numbers = np.frombuffer(places, "<u4").astype(np.int64), np.frombuffer(numbers, "<i8")
                rows = places // width
                starts = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                top = np.repeat(np.maximum.reduceat(numbers, starts), np.diff([*starts, len(rows)])) == numbers
                yield pa.RecordBatch.from_arrays([pa.array(rows[top] * STRIPES + stripe), pa.array(places[top] % width), pa.array(numbers[top])], ["id_a", "id_b", "n_docs"])

    return counts.select("stripe", "places", "numbers").mapInArrow(best, "id_a long, id_b long, n_docs long")
