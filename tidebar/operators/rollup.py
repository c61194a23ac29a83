"""Bars of nested timeframes in one pass, with summaries that merge from minute to month.

Trades are summed up by minute once; a rollup over the nested buckets merges these. Besides the exact columns each bucket has two
sketches of bounded size, one for quantiles of the price (KLL) and one for the number of distinct traders (HLL), which
can be stored and merged on, so a coarser or longer bucket never goes back to trades.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.operators.market_queries import add
from tidebar.sources.candles import instant, table, wall

LEVELS = ("month", "day", "hour", "minute")
#: Size of the quantile sketch: ranks are right within some 1.3 %; and the distinct sketch's number of bits, some 1.6 %.
RANKS, BITS = 200, 12


def summaries(trades: DataFrame) -> DataFrame:
    """symbol, ts, id, price, size, who -> one row a symbol and minute."""
    at = F.struct("ts", "id")
    return trades.groupBy("symbol", F.date_trunc("minute", "ts").alias("minute")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v"), F.count("*").alias("n"),
        F.kll_sketch_agg_double("price", F.lit(RANKS)).alias("prices"), F.hll_sketch_agg("who", F.lit(BITS)).alias("traders"),
    )


def rolled_up(minutes: DataFrame) -> DataFrame:
    """Summaries by minute -> symbol, level, ts and the summary of each month, day, hour and minute.

    One shuffle: rows are merged by (symbol, month, ..., minute) and its prefixes before it.
    """
    nested = minutes.select("*", *(F.date_trunc(x, "minute").alias(f"__{x}") for x in LEVELS[:-1]), F.col("minute").alias("__minute"))
    keys = [f"__{x}" for x in LEVELS]
    out = nested.groupingSets([["symbol", *keys[:k]] for k in range(1, len(keys) + 1)], "symbol", *keys).agg(
        F.grouping_id().alias("__id"), F.min_by("o", "minute").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "minute").alias("c"), F.sum("v").alias("v"), F.sum("n").alias("n"),
        F.kll_merge_agg_double("prices").alias("prices"), F.hll_union_agg("traders").alias("traders"),
    )
    # The finest key that is kept says what a row is of.
    level = F.element_at(F.array(*map(F.lit, reversed(LEVELS))), (F.log2(F.col("__id") + 1) + 1).cast("int"))
    ts = F.coalesce(*(F.col(k) for k in reversed(keys)))
    return out.select("symbol", level.alias("level"), ts.alias("ts"), "o", "h", "l", "c", "v", "n", "prices", "traders")


def with_estimates(rolled: DataFrame, ranks: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Quantiles of the price (p5, p50, ...) and the number of traders, read off the sketches."""
    of = [F.kll_sketch_get_quantile_double("prices", F.lit(float(x))).alias(f"p{round(100 * x)}") for x in ranks]
    return rolled.select(*(c for c in rolled.columns if c not in ("prices", "traders")), *of, F.hll_sketch_estimate("traders").alias("n_traders"))


def trades_of(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), instant("ts").alias("ts"), F.col("event_id").alias("id"), F.col("value").alias("price"), F.lit(1.0).alias("size"), F.col("user_id").alias("who"))


_LEVELS = " union all ".join(
    f"select symbol, '{x}' as level, b as ts, arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l, arg_max(value, (ts, event_id)) as c, count(*)::double as v, count(*) as n from (select event_type as symbol, date_trunc('{x}', ts)::timestamp as b, ts, event_id, value from events) group by symbol, b"
    for x in LEVELS
)
add("tb_rollup", lambda spark, d: rolled_up(summaries(trades_of(spark, d))).select("symbol", "level", wall("ts").alias("ts"), "o", "h", "l", "c", "v", "n"), _LEVELS)
