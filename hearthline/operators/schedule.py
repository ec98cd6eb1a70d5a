"""When pages are fetched: politely, so many at once for a host and so long between them, the urls of most promise first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.observation import Observation
from pyspark.sql.window import Window

from hearthline.functions import urls
from hearthline.operators import links
from hearthline.sources.shared import kept


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with rank, from 0, of each row within its key by order (columns that tell all rows of a key apart; equal rows may take
    either place). Rows are dealt by ranges of key and order and ranked within these; what a key has in ranges before is added. A key
    with many rows so goes through many tasks, and only its counts, one for each range, come together."""
    dealt = kept(rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id()), "ranges")
    own = F.row_number().over(Window.partitionBy("range", key).orderBy(*order)) - 1
    counts = dealt.groupBy(key, "range").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(key).alias("__key"), F.col("range").alias("__range"), before.alias("before"))
    same = dealt[key].eqNullSafe(F.col("__key")) & (dealt["range"] == F.col("__range"))
    return dealt.withColumn("own", own).join(offsets, same).select(*rows.columns, (F.col("own") + F.col("before")).cast("long").alias("rank"))


def polite(found: DataFrame, slots: int = 2, delay: int = 1, horizon: int | None = None, max_depth: int | None = None) -> DataFrame:
    """found: id, url, depth. Adds host and start, in seconds: a host's urls go in slots at once and delay seconds apart, those of
    priority first and those of low promise last, then by depth and id. Left out: what is no page, is too deep, or would start at the
    horizon or later. Urls without a host are one host; a url that comes twice is fetched twice."""
    url = F.col("url")
    good = found.where(~links.skipped(url))
    good = good if max_depth is None else good.where(F.col("depth") <= max_depth)
    place = F.when(links.priority(url), 0).when(links.low(url), 2).otherwise(1)
    rows = ranked(good.select("id", "url", "depth", urls.host(url).alias("host"), place.alias("place")), "host", ["place", "depth", "id"])
    timed = rows.select("id", "url", "host", (F.floor(F.col("rank") / slots) * delay).cast("long").alias("start"))
    return timed if horizon is None else timed.where(F.col("start") < horizon)


def watched(rows: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """rows, and what passes through them when they are first read or written: how many, and how many fulfil each condition. No second
    pass; the observation's get waits for the first."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in counts.items()]), seen
