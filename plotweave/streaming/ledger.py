"""The ledger and the sliding mean on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.operators.ranking import upsert
from plotweave.sources.workspace import new_path


def follow(stream: DataFrame, folder: str, keys: list[str], time: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Merge every micro-batch of results into the newest version of the ledger in ``folder``.

    A batch writes the whole ledger as version ``v=<batch>``, so a batch that is run again
    overwrites its own version, and a reader always finds a complete one.
    """
    spark, schema = stream.sparkSession, stream.schema

    def merge(rows: DataFrame, batch: int) -> None:
        s = rows.sparkSession
        old = s.read.schema(schema).parquet(f"{folder}/v={batch - 1}") if batch else s.createDataFrame([], schema)
        upsert(old, rows, keys, time).write.mode("overwrite").parquet(f"{folder}/v={batch}")

    return (stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def newest(keys: list[str], *order: str):
    """State of a running ledger: the greatest ``order`` of every key with its row."""
    def run(stream: DataFrame) -> DataFrame:
        rest = [c for c in stream.columns if c not in (*keys, *order)]
        return stream.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("row")).select(*keys, "row.*")

    return run


def windowed_mean(stream: DataFrame, time: str, value: str, window: str, late: str, keys: list[str] = ()) -> DataFrame:
    """Counts and means by tumbling event-time window; rows later than ``late`` are left out."""
    return (stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, window), *keys)
            .agg(F.count(F.lit(1)).alias("samples"), F.avg(value).alias("window_mean"))
            .select(F.col("window.start").alias("window_start"), *keys, "samples", "window_mean"))


def _files(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet file or folder; the pattern lets the source take a single file."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")


def _complete(spark: SparkSession, out: DataFrame, name: str) -> DataFrame:
    """Drive a stream over the files that are there and return its whole result."""
    path = new_path(spark, name)

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path)

    q = (out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", new_path(spark, f"{name}-checkpoint"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def latest_of_events(spark: SparkSession, path: str) -> DataFrame:
    rows = _files(spark, path).select((F.col("user_id") % 50).alias("state_code"), "event_id", "ts",
                                      F.col("event_type").alias("status"), F.col("value").alias("elapsed_seconds"))
    return _complete(spark, newest(["state_code"], "ts", "event_id")(rows), "newest")


def window_means(spark: SparkSession, path: str) -> DataFrame:
    out = windowed_mean(_files(spark, path), "ts", "value", "6 hours", "1 hour", ["event_type"])
    return _complete(spark, out, "means").select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "samples", F.round("window_mean", 8).alias("window_mean"))
