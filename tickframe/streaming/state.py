"""Operators on streams of ticks: event-time windows and sessions, and the replay of stored files. State of games is in
`games`. Late rows beyond the watermark are dropped: a state can't take a row older than what it has seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def count_windows(stream: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", keys: Sequence[str] = (), ts: str = "ts") -> DataFrame:
    """Rows per window and key, tumbling or sliding; a window comes out when the watermark passes its end."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    counts = stream.withWatermark(ts, late).groupBy(w, *keys).count()
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, F.col("count").alias("n"))


def engagement_sessions(stream: DataFrame, gap: str = "1.2 seconds", late: str = "10 minutes", keys: Sequence[str] = ("attacker", "victim"), ts: str = "ts") -> DataFrame:
    """Sessions of hits per attacker and victim: start, end (gap included), hits."""
    sessions = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).count()
    return sessions.select(*keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("count").alias("hits"))


def test_events(stream: DataFrame, late: str = "10 minutes", gap: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events of a test id to one row: start, end, n and whether a success was among them."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), "test").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("name") == "success", 1).otherwise(0)).alias("ok"))
    return s.select("test", "start", "end", "n", "ok")


def replay(spark: SparkSession, source: str, op: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] = lambda s: s, **options: object) -> DataFrame:
    """Run a stream operator over stored Parquet files until they are done; the table it wrote. State is kept in RocksDB,
    which `transformWithState` asks for."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.read.parquet(source).schema
    stream = prepare(spark.readStream.schema(schema).options(**options).parquet(source))
    result = op(stream)
    result.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(out)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, with the side they are on."""
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return only(a, b.select(*a.columns), "a").unionByName(only(b.select(*a.columns), a, "b"))
