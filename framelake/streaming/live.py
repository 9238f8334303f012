"""Structured Streaming forms of the sessions and the incremental catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of the Parquet files that arrive in a folder; times become instants, as watermarks need them."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(stream: DataFrame, key: str = "user_id", gap: str = "3 days", late: str = "1 day") -> DataFrame:
    """Sessions of each key, closed when the watermark passes them."""
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", late).groupBy(w, key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upserts(stream: DataFrame, target: str, key: str, checkpoint: str, time: str = "ts") -> DataStreamWriter:
    """Append each batch's last row of every key, by time, as a version; latest() reads the catalog of all versions.

    A batch that runs again after a failure writes its own version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        row = F.struct(*(c for c in batch.columns if c != key))
        last = batch.groupBy(key).agg(F.max_by(row, F.struct(F.col(time).isNotNull(), F.col(time))).alias("_x")).select(key, "_x.*")
        last.select(*batch.columns).write.mode("overwrite").parquet(f"{target}/version={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def latest(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg(F.max_by(F.struct(*[c for c in versions.columns if c not in (key, "version")]), "version").alias("x")).select(key, "x.*")
