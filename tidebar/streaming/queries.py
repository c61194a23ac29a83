"""Registered queries that run a stream to its end: all that is there, then stop."""

from __future__ import annotations

import uuid

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.operators.queries import ORACLE_SQL as BATCH_SQL
from tidebar.operators.queries import rounded
from tidebar.operators.waiting import WAITING
from tidebar.plans.chain import Chain
from tidebar.sources import tables
from tidebar.sources.candles import hourly, instant, table, ticks, wall
from tidebar.sources.exchange import running_candles
from tidebar.sources.tables import current, shared_folder
from tidebar.streaming import incremental
from tidebar.streaming.bars import session_bars, sliding_bars, stream_bars, stream_candles, upsert_sink


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream (the pattern also fits a folder of part files)."""
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")
    return e.select(F.col("event_type").alias("symbol"), instant("ts").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def drained(stream: DataFrame) -> DataFrame:
    """The rows (symbol, ts, ...) of a stream in update mode when it has read all there is, upserted batch by batch."""
    spark = stream.sparkSession
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}-state").trigger(availableNow=True).foreachBatch(upsert_sink(path)).start().awaitTermination()
    return current(spark, path).select(*stream.columns)


def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(stream_bars(_trades(spark, sf_dir)))
    return out.select("symbol", wall("ts").alias("ts"), "o", "h", "l", "c", "v", "n")


def _messages(trades: DataFrame) -> DataFrame:
    """Each trade as a message about its minute's candle; every seventh is cut short and every eleventh lacks its low."""
    c, minute = F.col, F.date_format(F.date_trunc("minute", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    price = lambda k, name: F.struct((c("price") + k - 0.5).alias("bid"), (c("price") + k + 0.5).alias("ask")).alias(name)
    fields = [c("symbol").alias("epic"), minute.alias("snapshotTime"), c("id").cast("double").alias("lastTradedVolume"), price(0, "openPrice"), price(2, "highPrice"), price(1, "closePrice")]
    whole, lacking = F.to_json(F.struct(*fields, price(-2, "lowPrice"))), F.to_json(F.struct(*fields))
    return trades.select("id", F.when(c("id") % 7 == 0, F.substring(whole, 1, 40)).when(c("id") % 11 == 0, lacking).otherwise(whole).alias("value"))


def streamed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    candles = running_candles(_messages(_trades(spark, sf_dir)))
    out = drained(stream_candles(candles))
    return out.select("symbol", wall("ts").alias("ts"), "o", "h", "l", "c", "v", F.lit(False).alias("is_final"))


# Indicators over streams

#: Parts that a stream arrives in; a fifth of the trades comes a part late.
PARTS = 3
#: Rows of a file, about; a part is as many files as that makes.
ROWS = 1 << 19


def _arriving(spark: SparkSession, sf_dir: str, rows: DataFrame, id: str) -> tuple[str, int]:
    """Rows (ts, ...) as a folder of files that arrive part by part: by time, but every fifth row one part late; and the files of a part."""
    path = f"{shared_folder(spark)}/arriving-{uuid.uuid4().hex}"
    low, high, n = rows.agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts")), F.count("*")).first()
    files = -(-n // (PARTS * ROWS)) or 1
    share = F.floor((F.unix_seconds("ts") - low) * PARTS / ((high or 0) - (low or 0) + 1))
    at = F.least(share + F.when(F.col(id) % 5 == 0, 1).otherwise(0), F.lit(PARTS - 1)).cast("int")
    rows = rows.withColumn("__part", at)
    for k in range(PARTS):
        rows.where(F.col("__part") == k).drop("__part").repartition(files, id).write.mode("append").parquet(path)
    return path, files


def _arrivals(spark: SparkSession, path: str, files: int) -> DataFrame:
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("latestFirst", "false").parquet(path)


def _run(stream: DataFrame, sink: Callable[[DataFrame, int], None], path: str, mode: str = "update") -> None:
    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


def _chain(name: str) -> Chain:
    chain = Chain()
    chain.out = rounded(WAITING[name](chain))
    return chain


def streamed(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """An indicator of the streaming family over trades that arrive out of order: running bars, corrected as late trades come."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/indicator-{uuid.uuid4().hex}"
        chain = _chain(name)
        # As the hourly bars of the batch do, volume adds up prices.
        trades = ticks(spark, sf_dir).withColumn("size", F.col("price"))
        arriving = _arrivals(spark, *_arriving(spark, sf_dir, trades, "id"))
        _run(stream_bars(arriving, late="3650 days"), incremental.indicator_sink(chain, f"{path}-bars", path), path)
        return incremental.values(spark, path, chain).select("symbol", wall("ts").alias("ts"), *chain.out)

    return query


def _holes(b: DataFrame) -> DataFrame:
    """Bars without those of 3 to 5 o'clock, but for each symbol's first and last."""
    by = W.partitionBy("symbol")
    edge = (F.col("ts") == F.min("ts").over(by)) | (F.col("ts") == F.max("ts").over(by))
    return b.withColumn("__edge", edge).where(F.col("__edge") | ~F.hour("ts").between(3, 5)).drop("__edge")


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of bars with holes, filled from a stored table as it goes, and an average over the whole."""
    path = f"{shared_folder(spark)}/reconciled-{uuid.uuid4().hex}"
    chain, history = _chain("ema"), hourly(spark, sf_dir)
    live = _holes(history).withColumn("__id", F.xxhash64("symbol", "ts"))
    stream = _arrivals(spark, *_arriving(spark, sf_dir, live, "__id")).drop("__id")
    _run(stream, incremental.indicator_sink(chain, f"{path}-bars", path, incremental.from_history(history)), path, "append")
    out = incremental.values(spark, path, chain).join(current(spark, f"{path}-bars"), ["symbol", "ts"])
    return out.select("symbol", wall("ts").alias("ts"), "c", "ema")


def kept_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that follow a stored table through appends, one of which corrects bars of long ago."""
    path = f"{shared_folder(spark)}/kept-{uuid.uuid4().hex}"
    chain, b = _chain("macd"), hourly(spark, sf_dir)
    day = F.day("ts")
    wrong = b.withColumn("c", F.when(day == 5, F.col("c") * 2).otherwise(F.col("c")))
    for version, some in enumerate((wrong.where(day <= 10), b.where((day > 10) & (day <= 20)), b.where(day == 5), b.where(day > 20)), 1):
        tables.append(some, f"{path}-bars", version)
        incremental.keep_up(spark, chain, f"{path}-bars", path)
    return incremental.values(spark, path, chain).select("symbol", wall("ts").alias("ts"), *chain.out)


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader's snapshot, brought up to date by feeds through appends and a compaction, with the last version of each bar."""
    path = f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"
    b = hourly(spark, sf_dir)
    for version in range(1, 6):
        tables.append(b.where(F.pmod(F.hour("ts") + version, F.lit(3)) == 0).withColumn("c", F.col("c") + version), path, version)
        if version == 3:
            tables.compact(spark, path)
    had = tables.current(spark, path, upto=2).withColumn("version", F.lit(None).cast("long"))
    out = tables.merged(had, tables.changes(spark, path, 2))
    return out.select("symbol", wall("ts").alias("ts"), F.round("c", 6).alias("c"), "version")


# Windows over trades


def _window_columns(b: DataFrame) -> DataFrame:
    return b.select("symbol", wall("ts").alias("ts"), wall("until").alias("until"), "o", "h", "l", "c", F.round("v", 6).alias("v"), "n")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_columns(session_bars(ticks(spark, sf_dir)))


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_columns(sliding_bars(ticks(spark, sf_dir)))


def streamed_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    arriving = _arrivals(spark, *_arriving(spark, sf_dir, ticks(spark, sf_dir), "id"))
    return _window_columns(drained(sliding_bars(arriving, late="3650 days")))


SESSION_SQL = """
    with t as (select event_type as symbol, ts, event_id as id, value as p, case when ts - lag(ts) over w < interval 20 minute then 0 else 1 end as f from events window w as (partition by event_type order by ts, event_id)),
    s as (select *, sum(f) over (partition by symbol order by ts, id) as g from t)
    select symbol, min(ts) as ts, max(ts) + interval 20 minute as until, arg_min(p, (ts, id)) as o, max(p) as h, min(p) as l, arg_max(p, (ts, id)) as c, count(*)::double as v, count(*) as n from s group by symbol, g"""
SLIDING_SQL = """
    with t as (select event_type as symbol, ts as tm, event_id as id, value as p, unnest([0, 1, 2, 3]) as k from events),
    s as (select *, time_bucket(interval 15 minute, tm, timestamp '1970-01-01') - k * interval 15 minute as ts from t)
    select symbol, ts, ts + interval 1 hour as until, arg_min(p, (tm, id)) as o, max(p) as h, min(p) as l, arg_max(p, (tm, id)) as c, count(*)::double as v, count(*) as n from s group by symbol, ts"""
FEED_SQL = """
    with b as (select event_type as symbol, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as ts, arg_max(value, (ts, event_id)) as c from events group by 1, 2),
    v as (select *, (select max(x) from range(1, 6) r(x) where (hour(ts) + x) % 3 = 0) as version from b)
    select symbol, ts, round(c + version, 6) as c, case when version > 2 then version end as version from v"""

STREAMED = ("rsi", "macd", "adx", "supertrend", "vwap")
QUERIES = {"src_ws": streamed_messages, "st_bars": streamed_bars, "st_reconciled": reconciled, "st_kept_up": kept_up, "st_change_feed": feed}
QUERIES |= {f"st_{name}": streamed(name) for name in STREAMED} | {"tb_sessions": sessions, "tb_sliding": sliding, "st_sliding": streamed_sliding}
ORACLE_SQL = {f"st_{name}": BATCH_SQL[f"s_{name}"] for name in STREAMED} | {
    "st_kept_up": BATCH_SQL["s_macd"],
    "st_reconciled": f"select e.symbol, e.ts, b.c, e.ema from ({BATCH_SQL['s_ema']}) e join (select event_type as symbol, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as ts, arg_max(value, (ts, event_id)) as c from events group by 1, 2) b using (symbol, ts)",
    "st_change_feed": FEED_SQL,
    "tb_sessions": SESSION_SQL,
    "tb_sliding": SLIDING_SQL,
    "st_sliding": SLIDING_SQL,
    "st_bars": "select event_type as symbol, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as ts, arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l, arg_max(value, (ts, event_id)) as c, count(*)::double as v, count(*) as n from events group by 1, 2",
    "src_ws": "select event_type as symbol, date_trunc('minute', ts) as ts, arg_max(value, event_id) as o, arg_max(value, event_id) + 2 as h, arg_max(value, event_id) - 2 as l, arg_max(value, event_id) + 1 as c, max(event_id)::double as v, false as is_final from events where event_id % 7 <> 0 and event_id % 11 <> 0 group by 1, 2",
}
