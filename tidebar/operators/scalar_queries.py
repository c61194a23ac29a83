"""Registered queries of the small building blocks: means of a whole series, directional moves, neighbours of buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.windows import frame, highest, lag, lowest, num
from tidebar.operators import queries as indicators
from tidebar.operators.market import bucket_start
from tidebar.operators.market_queries import TS, B, add, over_bars, over_ticks, r
from tidebar.operators.ta import Out
from tidebar.plans.chain import Chain
from tidebar.sources.candles import wall

#: Other names of batch indicators.
ALSO = {"ta_bull_bear": "ta_bull_bear_power", "ta_bollinger": "ta_bb", "ta_volume_osc": "ta_vol_osc", "ta_highest": "ta_extremes", "ta_highest_bars": "ta_extreme_bars", "ta_sum": "ta_rolling_sum", "ta_bars_since": "ta_bars_since_cross"}
for _new, _old in ALSO.items():
    add(_new, indicators.QUERIES[_old], indicators.ORACLE_SQL[_old])


def chained(key: str, make) -> None:
    """With nine decimals: plain means of prices often end in a 5 at the seventh."""
    add(key, *indicators.indicator(make, 9))


def range_stats(c: Chain, n: int = 14) -> Out:
    hi, lo = c.col(highest("h", n)), c.col(lowest("l", n))
    return {"range_pct": f"({hi} - {lo}) / nullif({lo}, 0e0) * 100e0", "position": f"case when {hi} is not null then coalesce((c - {lo}) / nullif({hi} - {lo}, 0e0) * 100e0, 50e0) end"}


def directional(c: Chain) -> Out:
    up, down = f"(h - {lag('h')})", f"({lag('l')} - l)"
    return {"plus_dm": f"case when {up} > {down} and {up} > 0 then {up} else 0e0 end", "minus_dm": f"case when {down} > {up} and {down} > 0 then {down} else 0e0 end"}


def step(k: float):
    """One step of an average from the close before to this one."""
    return lambda c: {"step": f"{num(k)} * c + {num(1 - k)} * {lag('c')}"}


def dema_step(c: Chain, n: int = 21) -> Out:
    k = 2 / (n + 1)
    one = c.ema("c", k, 1)
    two = c.ema(one, k, 1)
    return {"dema": f"2e0 * {one} - {two}", "tema": f"3e0 * {one} - 3e0 * {two} + {c.ema(two, k, 1)}"}


chained("ta_range_stats", range_stats)
chained("ta_dm", directional)
chained("im_ema_step", step(2 / 22))
chained("im_smma_step", step(1 / 14))
chained("im_dema_step", dema_step)
chained("x_var_mean", lambda c: {"variance": f"{frame('avg(c * c)', 20)} - {frame('avg(c)', 20)} * {frame('avg(c)', 20)}"})
add("im_sma", over_bars(lambda b: b.groupBy("symbol").agg(r(F.avg("c"), "mean"))), f"{B} select symbol, round(avg(c), 6) as mean from b group by symbol")
add("im_vwap", over_bars(lambda b: b.groupBy("symbol").agg(r(F.coalesce(F.sum((F.col("h") + F.col("l") + F.col("c")) / 3 * F.col("v")) / F.nullif(F.sum("v"), F.lit(0.0)), F.lit(0.0)), "vwap"))), f"{B} select symbol, round(coalesce(sum((h + l + c) / 3 * v) / nullif(sum(v), 0), 0), 6) as vwap from b group by symbol")


def _ranked(b: DataFrame) -> DataFrame:
    return b.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy("ts")).cast("double"))


add("im_wma", over_bars(lambda b: _ranked(b).groupBy("symbol").agg(r(F.sum(F.col("c") * F.col("k")) / F.sum("k"), "wma"))), f"{B}, k as (select *, row_number() over (partition by symbol order by ts) as k from b) select symbol, round(sum(c * k) / sum(k), 6) as wma from k group by symbol")
add("x_extremes", over_bars(lambda b: b.groupBy("symbol").agg(F.max("c").alias("high"), wall(F.max_by("ts", F.struct("c", -F.unix_seconds("ts")))).alias("high_at"), F.min("c").alias("low"), wall(F.min_by("ts", F.struct("c", F.unix_seconds("ts")))).alias("low_at"))), f"{B} select symbol, max(c) as high, arg_max(ts, (c, -epoch(ts))) as high_at, min(c) as low, arg_min(ts, (c, epoch(ts))) as low_at from b group by symbol")
add("x_tb_bucket", over_ticks(lambda t: t.select("id", *(wall(F.timestamp_seconds(F.unix_seconds(bucket_start(F.col("ts"), 3600)) + d)).alias(n) for n, d in (("before", -3600), ("start", 0), ("next", 3600))))), "select event_id as id, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') - interval 1 hour as before, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as start, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') + interval 1 hour as next from events")
