"""Archives of fetched pages as a Spark data source, `spark.read.format("page_archive").load(folder)`, and as a sink.

A folder holds data files of gzip members, one a page: header lines (address, id, host, length of what follows), an empty line and
the page. Each write adds a manifest, atomically and last, that lists its files and their splits: byte ranges with the least and
greatest host in them and the number of pages. Files of failed tasks or writes are in no manifest, so nothing reads them. A split
is a partition when read, so a host with many pages is read by many tasks. Filters on host (=, in) and the option `host` leave
splits out and, within them, pages; a schema with fewer columns leaves their values undecoded.

Columns: page_id long, host string, url string, html string; any may be null. An archive without manifests is empty; a folder that
does not exist is an error when read. Folders are local paths or addresses that pyarrow.fs opens (file, s3, gs, hdfs).
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from hearthline.functions import urls

NAME, SCHEMA = "page_archive", "page_id long, host string, url string, html string"
COLUMNS = ("page_id", "host", "url", "html")
_TYPES = {"page_id": pa.int64(), "host": pa.string(), "url": pa.string(), "html": pa.string()}
#: A split ends after so many bytes; so many bytes are read at once; a batch ends after so many rows or characters.
SPLIT_BYTES, READ_BYTES, BATCH_ROWS, BATCH_CHARS = 64 << 20, 1 << 20, 256, 8 << 20


def _opened(path: str):
    """The file system and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def member(page_id: int | None, host: str | None, url: str | None, html: str | None) -> bytes:
    """A page as a gzip member of its own."""
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    head = {"type": "response", "id": page_id, "host": host, "url": url, "length": None if html is None else len(body)}
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(json.dumps(head, ensure_ascii=True).encode() + b"\r\n\r\n" + body) + packed.flush()


def members(file, offset: int, length: int) -> Iterator[bytes]:
    """What the gzip members in a byte range hold, read in steps."""
    file.seek(offset)
    left, unpack, parts, rest = length, zlib.decompressobj(31), [], b""
    while left or rest:
        if not rest:
            rest = file.read(min(READ_BYTES, left))
            if not rest:
                raise EOFError("the archive ends within a split")
            left -= len(rest)
        parts.append(unpack.decompress(rest))
        rest = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if any(parts):
        raise EOFError("the last page of a split is cut off")


@dataclass
class Split(InputPartition):
    file: str
    offset: int
    length: int
    pages: int
    first: str
    last: str


@dataclass
class Written(WriterCommitMessage):
    file: str
    splits: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.path, self.split_bytes = options["path"], int(options.get("splitbytes", SPLIT_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _opened(self.path)
        store.create_dir(folder, recursive=True)
        name, splits, at = f"data-{uuid.uuid4().hex}.gz", [], 0
        now: dict | None = None
        with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                column = {c: batch.column(batch.schema.names.index(c)).to_pylist() for c in COLUMNS}
                for page_id, host, url, html in zip(*column.values(), strict=True):
                    packed = member(page_id, host, url, html)
                    out.write(packed)
                    if now is None or now["length"] >= self.split_bytes:
                        now = {"offset": at, "length": 0, "pages": 0, "first": host or "", "last": host or ""}
                        splits.append(now)
                    now["length"] += len(packed)
                    now["pages"] += 1
                    now["first"], now["last"] = min(now["first"], host or ""), max(now["last"], host or "")
                    at += len(packed)
        return Written(name, splits)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        name = f"{folder}/manifest-{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        with store.open_output_stream(f"{name}.part", compression=None) as out:
            out.write(json.dumps([{"file": m.file, "splits": m.splits} for m in messages if m and m.splits]).encode())
        store.move(f"{name}.part", name)

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _opened(self.path)
        for m in filter(None, messages):
            store.delete_file(f"{folder}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.columns = options["path"], [f.name for f in schema.fields]
        if unknown := [c for c in self.columns if c not in COLUMNS]:
            raise ValueError(f"an archive has no {', '.join(unknown)}")
        self.hosts: set[str] | None = {options["host"]} if "host" in options else None

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In) and tuple(f.attribute) == ("host",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.hosts = asked if self.hosts is None else self.hosts & asked
            else:
                yield f

    def partitions(self) -> list[Split]:
        from pyarrow import fs

        store, folder = _opened(self.path)
        found = []
        for info in sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda i: i.path):
            if info.base_name.startswith("manifest-") and info.base_name.endswith(".json"):
                with store.open_input_stream(info.path, compression=None) as file:
                    found += [Split(entry["file"], **split) for entry in json.loads(file.read()) for split in entry["splits"]]
        return [s for s in found if self.hosts is None or any(s.first <= h <= s.last for h in self.hosts)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an archive without splits
            return
        store, folder = _opened(self.path)
        rows, chars = [], 0
        schema = pa.schema([(c, _TYPES[c]) for c in self.columns])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(schema.types)], schema=schema)
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            for whole in members(file, partition.offset, partition.length):
                end = whole.index(b"\r\n\r\n")
                head = json.loads(whole[:end])
                if self.hosts is not None and head["host"] not in self.hosts:
                    continue
                page = {"page_id": head["id"], "host": head["host"], "url": head["url"]}
                if "html" in self.columns:
                    page["html"] = None if head["length"] is None else whole[end + 4 :].decode("utf-8", "surrogatepass")
                    chars += len(page["html"] or "")
                rows.append([page[c] for c in self.columns])
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch()
                    rows, chars = [], 0
        yield batch()


class PageArchive(DataSource):
    """Options: path; host (reads pages of that host only); splitbytes (when written)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("archives are appended to")
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageArchive)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(pages: DataFrame, path: str, split_bytes: int = SPLIT_BYTES) -> None:
    """pages: page_id, url, html. Files hold pages in the order of host and id; ranges of these are cut by rows, within hosts too."""
    register(pages.sparkSession)
    with_host = pages.select(F.col("page_id").cast("long").alias("page_id"), urls.host(F.col("url")).alias("host"), "url", "html")
    in_order = with_host.repartitionByRange("host", "page_id").sortWithinPartitions("host", "page_id")
    in_order.write.format(NAME).mode("append").option("splitbytes", split_bytes).save(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    register(spark)
    kinds = dict(part.split() for part in SCHEMA.split(", "))
    return spark.read.format(NAME).schema(", ".join(f"{c} {kinds[c]}" for c in columns)).load(path)
