"""Event counts in tumbling windows, as a stream with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import shared_folder


def windows(events: DataFrame, every: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Works on a stream and on a table alike."""
    counted = events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), "event_type", "n")


def windows_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events that are there, read as a stream once and then ended."""
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A stream reads folders; of one file, the folder with a filter on its name.
    folder, _, name = source.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    place = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{place}/out"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = windows(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.read.parquet(out)
    newest = last.agg(F.max("batch")).first()[0]
    return last.filter(F.col("batch") == newest).drop("batch").withColumn("start", F.col("start").cast("timestamp_ntz"))
