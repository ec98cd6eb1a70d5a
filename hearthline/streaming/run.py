"""Running a stream over what its source holds now."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hearthline.sources.shared import shared_folder

EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All rows that a stream makes of what is there, as a table. Files and offsets go to the folder in spark.checkpoint.dir.
    Batches without data are off meanwhile: operators with timeouts would ask for them for ever."""
    spark: SparkSession = stream.sparkSession
    place = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    spark.conf.set(EMPTY_BATCHES, "false")
    running = stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/offsets").trigger(availableNow=True).start()
    spark.conf.unset(EMPTY_BATCHES)
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")
