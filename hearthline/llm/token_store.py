"""Token ids of documents in files of our own format, with Elias-Fano coded document boundaries.

A file holds, in this order: the ids of its documents, concatenated, as little-endian unsigned 16- or 32-bit numbers; the
Elias-Fano code of the documents' ends within them; that of the documents' ids, less the least; a footer. Elias-Fano keeps
n non-decreasing numbers up to u in about n * (2 + log2(u / n)) bits: the low bits packed, the high parts as one bit for
each number after as many zeros as the part grew. A sample of the place of every 512th such bit lets select() find any
number without a table of offsets.

Documents lie in ascending id order, nulls first, ties by a hash of the text: the table is range-partitioned and sorted, and
every partition writes one file to the shared folder, under a name of its own for each attempt. Only files of attempts that
ended well are in the list that the reader gets, so a lost executor leaves at most an unused file. Null texts count as empty.
Repeated rows are stored each on its own, very long texts as one document, an empty table as no file. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthline.llm.common import shared_folder, small_batches, text_or_empty
from hearthline.llm.word_tokens import word_tokens

MAGIC = b"HLTOKEN1"
FOOTER = struct.Struct("<8sIQQQqQQ")  # magic, bytes an id, documents, nulls among them, ids, least document id, lengths of the codes
SAMPLE = 512


class EliasFano:
    """Non-decreasing numbers of 0 or more."""

    HEAD = struct.Struct("<QQBQ")  # numbers, the largest, low bits, bytes of the high part
    PART = 1 << 14  # numbers coded at once

    def __init__(self, n: int, most: int, low_bits: int, low: np.ndarray, high: np.ndarray, sample: np.ndarray) -> None:
        self.n, self.most, self.low_bits, self.low, self.high, self.sample = n, most, low_bits, low, high, sample

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, most = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, ((most + 1) // n).bit_length() - 1) if n else 0
        low = [np.zeros(0, np.uint8)]
        for k in range(0, n, cls.PART):  # a multiple of eight numbers fills whole bytes
            shown = (values[k : k + cls.PART, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
            low.append(np.packbits(shown.ravel(), bitorder="little"))
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        marks = np.zeros((n + (most >> bits) + 1 + 63) // 64 * 64, np.uint8)
        marks[places] = 1
        return cls(n, most, bits, np.concatenate(low), np.packbits(marks, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return self.HEAD.pack(self.n, self.most, self.low_bits, len(self.high)) + self.sample.tobytes() + self.high.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, most, bits, high = cls.HEAD.unpack_from(data)
        at, samples = cls.HEAD.size, -(-n // SAMPLE)
        sample = np.frombuffer(data, "<u4", samples, at)
        marks = np.frombuffer(data, np.uint8, high, at + 4 * samples)
        return cls(n, most, bits, np.frombuffer(data, np.uint8, -1, at + 4 * samples + high), marks, sample)

    def _low(self, i: int) -> int:
        begin, end = i * self.low_bits, (i + 1) * self.low_bits
        window = int.from_bytes(self.low[begin // 8 : -(-end // 8)].tobytes(), "little")
        return window >> (begin % 8) & ((1 << self.low_bits) - 1)

    def _select(self, i: int) -> int:
        """The place of one-bit number i: from its sample on, by counting the ones of 64 bits at a time."""
        place = int(self.sample[i // SAMPLE])
        left, word = i % SAMPLE, place // 64
        words = self.high.view("<u8")
        bits = int(words[word]) >> (place % 64) << (place % 64)
        while (ones := bits.bit_count()) <= left:
            left, word = left - ones, word + 1
            bits = int(words[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def select(self, i: int) -> int:
        """Number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self._select(i) - i) << self.low_bits | self._low(i)


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Writer:
    """One file, written from front to back."""

    def __init__(self, uri: str, id_bytes: int) -> None:
        self.store, self.path = _open(uri)
        self.out = self.store.open_output_stream(self.path)
        self.id_bytes, self.ends, self.doc_ids, self.nulls, self.n = id_bytes, [], [], 0, 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(f"<u{self.id_bytes}").tobytes())
        self.n += len(ids)
        self.ends.append(self.n)
        if doc_id is None:
            self.nulls += 1
        else:
            self.doc_ids.append(doc_id)

    def close(self) -> None:
        least = self.doc_ids[0] if self.doc_ids else 0
        ends = EliasFano.of(np.array(self.ends, np.uint64)).to_bytes()
        keys = EliasFano.of(np.array([i - least for i in self.doc_ids], np.uint64)).to_bytes()
        self.out.write(ends + keys + FOOTER.pack(MAGIC, self.id_bytes, len(self.ends), self.nulls, self.n, least, len(ends), len(keys)))
        self.out.close()


class Reader:
    """A written file; document i's ids are read from where select() says they lie."""

    def __init__(self, uri: str) -> None:
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        magic, self.id_bytes, self.n_docs, self.nulls, self.n_tokens, self.least, ends, keys = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a token file")
        codes = self.file.read_at(ends + keys, size - FOOTER.size - ends - keys)
        self.ends, self.keys = EliasFano.from_bytes(codes[:ends]), EliasFano.from_bytes(codes[ends:])

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.keys.select(i - self.nulls) + self.least

    def ids(self, begin: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - begin) * self.id_bytes, begin * self.id_bytes), f"<u{self.id_bytes}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))


@dataclass(frozen=True)
class Shard:
    """A file, and how many ids all files before it hold."""

    uri: str
    before: int
    n_docs: int
    n_tokens: int


def write(docs: DataFrame, vocabulary: str, folder: str, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text") -> list[Shard]:
    """Writes all documents, each followed by end_id, and returns the files in order: one for each partition that has rows."""
    small_batches(docs.sparkSession)
    slim = docs.select(docs[id_column].cast("long").alias("doc_id"), text_or_empty(text_column).alias("text"))
    # the row's place in the input, the same whenever it is read, deals repeated rows over several partitions
    keys = ["doc_id", F.xxhash64("text"), "row"]
    ordered = slim.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("row")

    def run(batches):
        use, out = word_tokens(vocabulary), None
        tail = [] if end_id is None else [end_id]
        part = TaskContext.get().partitionId()
        uri = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.tokens"
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None:
                    out = Writer(uri, use.dtype.itemsize)
                out.add(doc_id, np.append(use.encode_ids(text), tail))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([len(out.ends)], pa.int64()), pa.array([out.n], pa.int64())], ["part", "uri", "n_docs", "n_tokens"])

    _folder(docs.sparkSession, folder)
    shards, before = [], 0
    for row in sorted(ordered.mapInArrow(run, "part int, uri string, n_docs long, n_tokens long").collect()):
        shards.append(Shard(row.uri, before, row.n_docs, row.n_tokens))
        before += row.n_tokens
    return shards


def _folder(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)


def read(spark: SparkSession, shards: list[Shard], keep_ids: bool = False, span: int = 1 << 20) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, with keep_ids the ids. Where each document lies and its id are selected
    from the file's codes; of its ids about span, or one document's, are in memory at once."""
    small_batches(spark)

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, file = shards[k], Reader(shards[k].uri)
                i = begin = 0
                while i < file.n_docs:
                    ends, doc_ids = [], []
                    while i < file.n_docs and (not ends or ends[-1] - begin < span):
                        ends.append(file.ends.select(i))
                        doc_ids.append(file.doc_id(i))
                        i += 1
                    data = file.ids(begin, ends[-1]).astype("<u4")
                    starts = np.array([begin, *ends[:-1]])
                    parts = np.split(data, starts[1:] - begin)
                    columns = [pa.array(doc_ids, pa.int64()), pa.array(starts + shard.before, pa.int64()), pa.array([len(p) for p in parts], pa.int64()), pa.array([zlib.crc32(p.tobytes()) for p in parts], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns, names = [*columns, pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32()))], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names)
                    begin = ends[-1]

    files = spark.range(0, len(shards), 1, max(1, len(shards)))
    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
