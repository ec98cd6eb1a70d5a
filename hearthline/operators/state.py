"""Incremental state: last write per url, retention, decisions, change detection, statistics. Times are given, never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame) -> DataFrame:
    """The last entry of each url, as an aggregate that combines before the shuffle."""
    fields = [c for c in log.columns if c != "url"]
    return log.groupBy("url").agg(F.max_by(F.struct(*fields), F.struct("processed_at", "seq")).alias("last")).select("url", "last.*")


def retained(log: DataFrame, cutoff: Column) -> DataFrame:
    return log.where(F.col("processed_at") >= cutoff)


def changes(log: DataFrame) -> DataFrame:
    """change_detected: the first sight of a url, or another hash than the time before."""
    before = F.lag("hash").over(Window.partitionBy("url").orderBy("processed_at", "seq"))
    return log.withColumn("change_detected", before.isNull() | (before != F.col("hash")))


def decision(as_of: Column, recent: str, max_age: str) -> Column:
    """Why a url is skipped, or that it is processed. Columns: status, processed_at, change_detected."""
    at, age = F.col("processed_at"), as_of - F.col("processed_at")
    return (
        F.when((F.col("status") == "success") & (at >= as_of - F.expr(recent)), "recently_processed")
        .when(age < F.expr(max_age), "fingerprint_fresh")
        .when(~F.col("change_detected") & (age < F.expr(f"2 * {max_age}")), "no_changes_detected")
        .otherwise("process")
    )


def statistics(last: DataFrame, day: Column) -> DataFrame:
    today = F.col("processed_at") >= day
    count = lambda s: F.count_if(today & (F.col("status") == s))
    return last.agg(F.count("*").alias("total"), F.count_if(today).alias("today"), *[count(s).alias(s) for s in ("success", "failed", "skipped")])


def since(log: DataFrame, moment: Column) -> DataFrame:
    return log.where(F.col("processed_at") >= moment)


def recent_success(log: DataFrame, moment: Column) -> DataFrame:
    """The urls that went well since a moment."""
    return since(log, moment).where(F.col("status") == "success").select("url").distinct()


def unvisited(links: DataFrame, log: DataFrame) -> DataFrame:
    """Links to urls that are not in the log."""
    return links.join(log.select("url").distinct(), "url", "left_anti")


def fingerprints(log: DataFrame) -> DataFrame:
    """url, hash, last_modified (when the hash became what it is), last_crawled, change_detected at the last visit."""
    changed = F.max(F.when(F.col("change_detected"), F.col("processed_at"))).alias("last_modified")
    last = F.max_by(F.struct("hash", "change_detected"), F.struct("processed_at", "seq")).alias("last")
    return changes(log).groupBy("url").agg(changed, F.max("processed_at").alias("last_crawled"), last).select("url", "last.hash", "last_modified", "last_crawled", "last.change_detected")


def stale(found: DataFrame, cutoff: Column) -> DataFrame:
    return found.where(F.col("last_crawled") < cutoff)


def updated(found: DataFrame, changes_of: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fingerprints with new hashes put in, changes whose url is not known)."""
    new = changes_of.select("url", F.col("hash").alias("__hash"))
    put = found.join(new, "url", "left").withColumn("hash", F.coalesce("__hash", "hash")).drop("__hash")
    return put, changes_of.join(found.select("url"), "url", "left_anti")


def model_use(as_of: Column, threshold: str, enabled: bool = True) -> Column:
    """Why a model is asked again, or is not. Columns: last_crawled (null without fingerprint), by_model, change_detected, listings."""
    if not enabled:
        return F.lit("fingerprinting_disabled")
    return (
        F.when(F.col("last_crawled").isNull(), "no_fingerprint")
        .when(~F.col("by_model"), "never_ai_processed")
        .when(F.col("change_detected"), "content_changed")
        .when(as_of - F.col("last_crawled") < F.expr(threshold), "ai_recently_processed")
        .when(F.col("listings") > 10, "high_property_count")
        .otherwise("no_changes_no_ai_needed")
    )


#: The reasons for which a model is asked.
ASKED = ("fingerprinting_disabled", "no_fingerprint", "never_ai_processed", "content_changed", "high_property_count")


def rates(counts: DataFrame) -> DataFrame:
    """Percentages of today, 0 where nothing was done today."""
    percent = lambda c: F.when(F.col("today") > 0, F.col(c) * 100.0 / F.col("today")).otherwise(0.0)
    return counts.select("total", "today", percent("success").alias("success_rate"), percent("skipped").alias("saving_rate"), (F.col("skipped") * 2).alias("saved_seconds"))


def newest(log: DataFrame, most: int) -> DataFrame:
    """The so many urls that were visited last."""
    return latest(log).orderBy(F.desc("processed_at"), F.desc("seq")).limit(most)
