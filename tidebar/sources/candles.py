"""Bars from ticks. A bar has symbol, ts (the start of its bucket), o, h, l, c, v, n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(ts: str | Column) -> Column:
    """A time without zone as one of the session's zone, which is UTC."""
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")


def wall(ts: str | Column) -> Column:
    return (F.col(ts) if isinstance(ts, str) else ts).cast("timestamp_ntz")


def bucket_start(ts: Column, seconds: int) -> Column:
    """Floor to a timeframe counted from the epoch: weeks start on Thursday, a month has 30 days."""
    s = F.unix_seconds(ts)
    return F.timestamp_seconds(s - F.pmod(s, F.lit(seconds)))


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as trades: symbol, ts, id, price, size."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), instant("ts").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def bars(trades: DataFrame, seconds: int = 3600, volume: str = "price") -> DataFrame:
    """One aggregation for all symbols and buckets: partial bars are merged before the shuffle; ties of ts go by id."""
    at = F.struct("ts", "id")
    return trades.groupBy("symbol", bucket_start(F.col("ts"), seconds).alias("bucket")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum(volume).alias("v"), F.count("*").alias("n")
    ).withColumnRenamed("bucket", "ts")


def resample(candles: DataFrame, seconds: int) -> DataFrame:
    """Bars of a coarser timeframe; empty buckets give no bar."""
    return candles.groupBy("symbol", bucket_start(F.col("ts"), seconds).alias("bucket")).agg(
        F.min_by("o", "ts").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"), F.sum("v").alias("v"), F.sum("n").alias("n")
    ).withColumnRenamed("bucket", "ts")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(ticks(spark, sf_dir))
