"""The incremental crawl as a stream: each micro-batch of fetched pages is decided by what stores know of their urls, read, and saved.

A batch has a name of its own, made of the stream's name and the batch's number, and both stores count it once. A batch that is run
again after a crash, wherever it was cut, finds the same state of urls (they are written last) and so decides alike, and what it had
saved already stays as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearthline.operators import crawls
from hearthline.sources.store import FIRST, LAST, KeyedStore

URLS = "url string, page_id long, processed_at timestamp, status string, hash string, change_detected boolean"
LISTINGS = (
    "hash string, page_id long, url string, endereco string, descricao string, cidade string, bairro string, cep string, valor double, quartos int, "
    "banheiros int, area_total double, tipo_imovel string"
)


class Crawl:
    """Stores of urls and listings under a folder, and how long what is known of a url counts."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "crawl", recent: str = "INTERVAL 24 HOURS", max_age: str = "INTERVAL 7 DAYS", buckets: int = 16) -> None:
        self.name, self.recent, self.max_age, self.offsets = name, recent, max_age, f"{folder}/offsets"
        self.urls = KeyedStore(spark, f"{folder}/urls", URLS, ("url",), buckets)
        self.listings = KeyedStore(spark, f"{folder}/listings", LISTINGS, ("hash",), buckets)

    def batch(self, visits: DataFrame, number: int) -> None:
        """visits: page_id, url, html, visited_at. Of several visits to a url within a batch the last counts."""
        if visits.isEmpty():
            return
        mark = f"{self.name}-{number}"
        fields = F.struct("page_id", "html", "visited_at")
        pages = visits.groupBy("url").agg(F.max_by(fields, F.struct("visited_at", "page_id")).alias("last")).select("url", "last.*")
        known = self.urls.lookup(visits.select("url"))
        decided, listings = crawls.incremental(pages, known, F.col("visited_at"), self.recent, self.max_age)
        self.listings.merge(listings, FIRST, ("page_id",), mark)
        # sorted joins: these tables have a row for each page, and packed files make them look small enough to be sent to every task
        read = decided.where("reason = 'process'").join(pages.select("page_id", F.col("visited_at").alias("processed_at")).hint("merge"), "page_id")
        before = known.select("url", F.col("hash").alias("hash_before"))
        changed = F.col("hash_before").isNull() | ~F.col("hash_before").eqNullSafe(F.col("hash"))
        self.urls.merge(read.join(before.hint("merge"), "url", "left").withColumn("change_detected", changed), LAST, ("processed_at",), mark)

    def start(self, visits: DataFrame) -> StreamingQuery:
        """Takes a stream of visits up to what its source holds now; started again, it goes on from there."""
        return visits.writeStream.foreachBatch(self.batch).option("checkpointLocation", self.offsets).trigger(availableNow=True).start()
