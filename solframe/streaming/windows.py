"""Windows over event streams; the same functions take batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, the time as TIMESTAMP, with a watermark if `delay` is given."""
    stream = spark.readStream.schema(schema).parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, delay) if delay else stream


def tumbling(events: DataFrame, ts: str, value: str, width: str, slide: str | None = None) -> DataFrame:
    w = F.window(F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts), width, slide) if slide else F.window(F.col(ts).cast("timestamp") if not events.isStreaming else F.col(ts), width)
    return events.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, ts: str, user: str, gap: str) -> DataFrame:
    w = F.session_window(F.col(ts) if events.isStreaming else F.col(ts).cast("timestamp"), gap)
    return events.groupBy(w.alias("w"), user).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def settle_stream(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an aggregated stream over all that its source has now, and read its complete result.

    Each batch writes the whole result, so one that is repeated after a failure writes the same.
    """

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
