"""What the operators share: tables, written intermediate results, batch sizes and word hashes."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to a Python worker at once; a text may be long, so a batch is kept short.
BATCH_ROWS = 256

#: A-Z and a-z, for lower-casing that touches ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """The same size for all operators of this package, as plans read it only when they run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir. Where it is unset, one of our own in local mode,
    in which everything is one process; on a cluster an error, as executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="hearthline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/hearthline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table written to the shared folder and read again: its lineage ends there and a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def loaded(path: str) -> pa.Table:
    """A small written table, read whole by a task."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path)
    parts = []
    for info in store.get_file_info(fs.FileSelector(folder)):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as file:
                parts.append(pq.ParquetFile(file).read())
    return pa.concat_tables(parts)


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """A written table, to be broadcast if it is small enough by count, to be joined otherwise."""
    return F.broadcast(df) if df.count() <= rows else df


def forget(*tables: DataFrame) -> None:
    """Deletes written tables of which nothing will be read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


# ---- hashes over bytes, vectorised -------------------------------------------------------------

_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_PRIME), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


class _Powers:
    """Powers of the prime and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.zeros(0, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_PRIME, 2 * n), _powers(_INVERSE, 2 * n)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values, so that any of their bits may be used."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, is_space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of non-space bytes, with their starts and ends.

    A run's hash is the sum of (byte + 1) * prime**position within the run, taken from one prefix sum, then mixed."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], is_space, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    up, down = _POWERS.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * down[starts]
    return mixed(raw + (ends - starts).astype(np.uint64)), starts, ends
