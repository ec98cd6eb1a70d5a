"""A keyed table that lasts between runs: hashed into buckets, with a manifest that says which files are each bucket's.

A merge reduces what comes to one row a key before it shuffles, rewrites only the buckets that these keys fall into, and then puts
up the next manifest under a number that only one writer can take. A run that ends before that changes nothing; a merge whose batch
is named in the manifest already changes nothing either, so it may be run again. Two writers that start from the same manifest:
the second gets Conflict and may merge again.

Rules: FIRST keeps the stored row of a key, else the one that comes least in the order given; LAST keeps the row that is greatest
in the order, stored or new (of equal ones the new); REPLACE always takes the new row. Rows whose keys are null are keyed by null.
The number of buckets is set when a store is created; choose it so that a bucket is a few hundred MB.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FIRST, LAST, REPLACE = "first", "last", "replace"
#: So many batches are remembered.
BATCHES = 10_000


class Conflict(RuntimeError):
    """Another writer has put up the manifest that this one was about to."""


class Files:
    """The few file operations that a manifest needs, by Hadoop's file systems, as Spark itself has them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm, self.gateway = spark._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = folder
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(""))] if self.fs.exists(self.path("")) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """All of the file or nothing of it; Conflict if it is there."""
        hidden = self.path(f".{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(hidden, False)
        try:
            stream.write(text.encode())
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.gateway.new_array(rename, 1)
        none[0] = rename.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        try:
            context.rename(hidden, self.path(name), none)
        except Exception as failed:
            self.fs.delete(hidden, False)
            if "FileAlreadyExists" in str(failed):
                raise Conflict(name) from failed
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class KeyedStore:
    """A store at a folder that all executors reach. keys: its key columns; schema: all its columns."""

    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, keys: tuple[str, ...], buckets: int = 16) -> None:
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
        self.files = Files(spark, self.folder)
        self.new_buckets = buckets

    # ---- what there is

    def manifest(self, version: int | None = None) -> dict:
        """version, n (of buckets), buckets (number: folder), batches. Without a version the newest."""
        found = sorted(n for n in self.files.names() if n.startswith("manifest-"))
        name = found[-1] if found and version is None else f"manifest-{version:012d}.json" if version else None
        return json.loads(self.files.read(name)) if name else {"version": 0, "n": self.new_buckets, "buckets": {}, "batches": []}

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(version)["buckets"].values())

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.folder}/{f}" for f in folders]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (the key columns); only their buckets are read."""
        now = self.manifest()
        asked = keys.select(*self.keys).distinct()
        touched = {str(r[0]) for r in asked.select(self._bucket(now["n"])).distinct().collect()}  # at most n numbers
        return self._read([f for b, f in now["buckets"].items() if b in touched]).join(asked, list(self.keys), "left_semi")

    def _bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int").alias("bucket")

    # ---- changes

    def merge(self, rows: DataFrame, rule: str, order: tuple[str, ...] = (), batch: str | None = None) -> int:
        """Puts rows in; returns the version that holds them. rows may have further columns, which are left out."""
        whole = F.struct(*self.schema.names)
        by = F.struct(*order, *[c for c in self.schema.names if c not in self.keys and c not in order])

        def reduced(df: DataFrame) -> DataFrame:
            one = df.groupBy("bucket", *self.keys).agg((F.min_by if rule == FIRST else F.max_by)(whole, by).alias("one"))
            return one.select("bucket", "one.*")

        def merged(old: DataFrame, staged: DataFrame) -> DataFrame:
            both = staged.withColumn("fresh", F.lit(1)).unionByName(old.withColumn("fresh", F.lit(0)))
            pick = {FIRST: F.min_by(whole, "fresh"), LAST: F.max_by(whole, F.struct(*order, "fresh")), REPLACE: F.max_by(whole, "fresh")}[rule]
            return both.groupBy("bucket", *self.keys).agg(pick.alias("one")).select("bucket", "one.*")

        return self._changed(rows.select(*self.schema.names), reduced, merged, batch)

    def remove(self, keys: DataFrame, batch: str | None = None) -> int:
        """Takes out the rows of keys."""
        return self._changed(keys.select(*self.keys), lambda df: df.distinct(), lambda old, staged: old.join(staged.select("bucket", *self.keys), ["bucket", *self.keys], "left_anti"), batch)

    def clear(self, batch: str | None = None) -> int:
        """Takes out all rows: a manifest without buckets."""
        now = self.manifest()
        return now["version"] if batch in now["batches"] else self._swap(now, {}, batch)

    def _changed(self, rows: DataFrame, reduce: Callable, change: Callable, batch: str | None) -> int:
        now = self.manifest()
        if batch is not None and batch in now["batches"]:
            return now["version"]
        n, mark = now["n"], uuid.uuid4().hex
        staging = f"staging-{mark}"
        reduce(rows.select("*", self._bucket(n))).write.parquet(f"{self.folder}/{staging}")
        staged = self.spark.read.parquet(f"{self.folder}/{staging}")
        touched = sorted(r[0] for r in staged.select("bucket").distinct().collect())  # at most n numbers
        folders = dict(now["buckets"])
        if touched:
            old = self._read([folders[str(b)] for b in touched if str(b) in folders]).select("*", self._bucket(n))
            # one shuffle, by bucket: it serves the reduction by key, and each bucket is written by one task
            dealt = lambda df: df.repartition(len(touched), "bucket")
            change(dealt(old), dealt(staged)).write.partitionBy("bucket").parquet(f"{self.folder}/data-{mark}")
            there = {s.getPath().getName() for s in self.files.fs.listStatus(self.files.path(f"data-{mark}"))}
            for b in touched:
                folders.pop(str(b), None)
                if f"bucket={b}" in there:
                    folders[str(b)] = f"data-{mark}/bucket={b}"
        version = self._swap(now, folders, batch)
        self.files.delete(staging)
        return version

    def _swap(self, now: dict, folders: dict, batch: str | None) -> int:
        after = {"version": now["version"] + 1, "n": now["n"], "buckets": folders, "batches": (now["batches"] + [batch] * (batch is not None))[-BATCHES:]}
        self.files.create(f"manifest-{after['version']:012d}.json", json.dumps(after))
        return after["version"]

    def vacuum(self, keep: int = 2) -> None:
        """Deletes what none of the last manifests names. Not while another merge runs: its files are in no manifest yet."""
        names = self.files.names()
        manifests = sorted(n for n in names if n.startswith("manifest-"))
        for name in manifests[:-keep]:
            self.files.delete(name)
        used = {f for name in manifests[-keep:] for f in json.loads(self.files.read(name))["buckets"].values()}
        for name in names:
            if name.startswith("staging-"):
                self.files.delete(name)
            elif name.startswith("data-"):
                for status in self.files.fs.listStatus(self.files.path(name)):
                    part = f"{name}/{status.getPath().getName()}"
                    if part not in used:
                        self.files.delete(part)
                if not any(f.startswith(f"{name}/") for f in used):
                    self.files.delete(name)
