"""Streaming forms of the weekly counts and of ingestion without repeats (extensions; the batch forms are the rule)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.weekly import rolling_week


def stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """New parquet files of ``folder`` as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(folder)


def weekly_counts(rows: DataFrame, at: str, by: list[str], late: str = "30 days") -> DataFrame:
    """Rows by Monday week and ``by``; rows later than ``late`` behind the newest are dropped with their closed weeks."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(rolling_week(F.col("_at")).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("date").alias("week"), *by, "n")


def first_seen(rows: DataFrame, keys: list[str], at: str, late: str = "30 days") -> DataFrame:
    """Each key once within the watermark, with state that is dropped after it."""
    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_at")


def append_batches(rows: DataFrame, folder: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Writes what is new by key, batch by batch; a batch that runs again adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(keys)
        try:
            held = batch.sparkSession.read.parquet(folder).filter(F.col("batch") != number).select(*keys)
            once = once.join(held, keys, "left_anti")
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
        once.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
