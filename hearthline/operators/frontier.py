"""Links of pages and the breadth-first frontier over them."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.sources.shared import shared_folder


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), F.lit(1))


def links(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", F.explode(hrefs(F.col("html"))).alias("href"))


def breadth_first(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """node, depth: all nodes reachable over edges (src, dst) from seeds (node), at their least depth. Each level is written, so
    plans stay short, and joined to what was visited."""
    spark = edges.sparkSession
    folder = f"{shared_folder(spark)}/frontier-{uuid.uuid4().hex}"

    def keep(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    visited = keep(seeds.select("node").distinct().withColumn("depth", F.lit(0)))
    level = visited
    for depth in range(1, max_depth + 1):
        found = level.join(edges, level["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        level = keep(found.join(visited, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        visited = keep(visited.unionByName(level))
    return visited
