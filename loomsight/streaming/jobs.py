"""Streaming forms of the time-driven operators. Late rows beyond the watermark are dropped, which a full rebuild is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, name: str, time: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table of a folder, one file or many, as a stream; event time without a zone is taken as UTC, as
    watermarks need a zone."""
    at = f"{folder}/{name}"
    table = spark.read.parquet(at)
    reader = spark.readStream.schema(table.schema)
    reader = reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader
    single = table.inputFiles() and table.inputFiles()[0].endswith(f"/{name}")
    stream = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(at)
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def bucket_series(events: DataFrame, time: str, keys: list[str], value: str, width: str = "12 hours", late: str = "1 day") -> DataFrame:
    """ST-03."""
    return events.withWatermark(time, late).groupBy(*keys, F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg(value), 8).alias("avg_value")).select(*keys, F.col("w.start").alias("bucket_start"), "n", "avg_value")


def deduplicated(events: DataFrame, time: str, keys: list[str], within: str = "168 hours") -> DataFrame:
    """ST-05: the first of equal keys within the window."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)


def merge_into(path: str, key: list[str], fold):
    """ST-06..08, ST-16: a ``foreachBatch`` function that folds each batch into a snapshot table.

    Every batch writes a version of its own, named by its number, from the version before: a batch that is run again
    after a failure writes the same version anew.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = fold(batch)
        if number:
            old = spark.read.parquet(f"{path}/version={number - 1}")
            from loomsight.operators.scheduling import upsert

            new = upsert(old, new.select(*old.columns), key)
        new.write.mode("overwrite").parquet(f"{path}/version={number}")

    return apply


def follow(df: DataFrame, path: str, checkpoint: str, every: str = "1 day", mode: str = "append"):
    """ST-02: the same as a query that goes on, a batch every ``every``; returns the running query."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(processingTime=every).start(path)


def live(entries: DataFrame, now, key: str = "key", pattern: str | None = None) -> DataFrame:
    """ST-14: of a cache's writes ``key, value, expires_at, pos`` the latest of each key that has not expired; ``pattern``
    is a part of the key."""
    entries = entries.where(F.col(key).contains(pattern)) if pattern else entries
    last = entries.groupBy(key).agg(F.max_by(F.struct("value", "expires_at"), "pos").alias("e"))
    return last.where(F.col("e.expires_at").isNull() | (F.col("e.expires_at") > now)).select(key, "e.value", "e.expires_at")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """ST-01: everything that is there now, to a Parquet folder; returns it as a batch."""
    schema = df.schema
    df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return df.sparkSession.read.schema(schema).parquet(path)
