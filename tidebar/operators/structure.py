"""Order blocks, liquidity, breaks of structure, level clusters, regimes, the kill switch, catalog lookups."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.windows import num
from tidebar.operators.research import by_time, correlations, fair_value_gaps, swings
from tidebar.plans.chain import Chain


def _last(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(*(F.max_by(x, "ts").alias(f"last_{x}") for x in "hlc"))


def order_blocks(bars: DataFrame) -> DataFrame:
    """The last opposite bar before two bars that close beyond it, with a score of 0 to 100; looks ahead by three bars.

    Mitigated if the symbol's last bar went through the far edge.
    """
    w, c = by_time(), F.col
    ahead = lambda x, n: F.lead(x, n).over(w)
    rows = bars.select("symbol", "ts", *"ohlc", *(ahead(x, n).alias(f"{x}{n}") for n in (1, 2) for x in "oc"), ahead("c", 3).alias("c3"))
    up, down = (c("c") < c("o")) & (c("c1") >= c("o1")) & (c("c2") >= c("o2")) & (c("c2") > c("h")), (c("c") >= c("o")) & (c("c1") < c("o1")) & (c("c2") < c("o2")) & (c("c2") < c("l"))
    ratio = F.when(c("h") > c("l"), F.abs(c("c") - c("o")) / F.nullif(c("h") - c("l"), F.lit(0.0))).otherwise(0.0)
    score = F.when(ratio > 0.7, 30.0).when(ratio > 0.5, 20.0).otherwise(0.0) + F.coalesce(F.least(F.abs(c("c3") - c("c")) / F.nullif("c", F.lit(0.0)) * 1000, F.lit(40.0)), F.lit(0.0)) + 30.0
    found = rows.where(up | down).select("symbol", "ts", c("h").alias("top"), c("l").alias("bottom"), up.alias("is_bullish"), F.least(score, F.lit(100.0)).alias("strength"))
    return found.join(_last(bars), "symbol").withColumn("mitigated", F.when(c("is_bullish"), c("last_l") < c("bottom")).otherwise(c("last_h") > c("top"))).drop("last_h", "last_l", "last_c")


def liquidity(bars: DataFrame, tolerance: float = 0.001, reach: int = 5) -> DataFrame:
    """Swing levels that later swings of their kind touch again within the tolerance: (level, touches, strength).

    A range join by logarithmic price buckets twice as wide as the tolerance: a level meets its own bucket and the two beside it,
    so that swings far apart in price are never compared.
    """
    bucket = F.floor(F.log("price") / (2 * math.log1p(tolerance)))
    levels = swings(bars, reach).where("price > 0").withColumn("b", bucket)
    later = levels.select("symbol", "kind", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("ts").alias("ts2"), F.col("price").alias("price2"))
    near = (F.col("ts2") > F.col("ts")) & (F.abs(F.col("price2") - F.col("price")) / F.col("price") < tolerance)
    touched = levels.join(later, ["symbol", "kind", "b"]).where(near).groupBy("symbol", "kind", "ts", "price").agg((F.count("*") + 1).alias("touches"))
    return touched.withColumn("strength", F.least(F.lit(100.0), F.col("touches") * 20.0))


def zones(bars: DataFrame, tolerance: float = 0.001, reach: int = 5) -> DataFrame:
    """liquidity's levels in order of price, those within twice the tolerance of a zone's first one in that zone.

    Which zone a level is in depends on where the one before began: one state a symbol and kind, carried over its levels.
    """
    ranked = liquidity(bars, tolerance, reach).withColumn("k", F.row_number().over(W.partitionBy("symbol", "kind").orderBy("price", "ts")))
    rows = ranked.select(F.concat("symbol", F.lit("|"), "kind").alias("symbol"), F.timestamp_seconds(F.col("k")).alias("ts"), "price", "touches", "strength", F.col("symbol").alias("of"), "kind")
    chain = merged(tolerance)
    out = chain.apply(rows)
    return out.groupBy("of", "kind", "level").agg(F.max("touches").alias("touches"), F.max("strength").alias("strength"), F.count("*").alias("n_levels")).withColumnRenamed("of", "symbol")


def merged(tolerance: float) -> Chain:
    c = Chain()
    step = lambda anchor, price: (anchor if (price - anchor) / anchor < 2 * tolerance else price,)
    level = c.fold(["price"], ["anchor"], lambda price: (price,), step, ["t.in0"], [f"case when (t.in0 - r.anchor) / r.anchor < {num(2 * tolerance)} then r.anchor else t.in0 end"])[0]
    c.out = {"level": level}
    return c


def block_geometry(bars: DataFrame) -> DataFrame:
    """Order blocks: their height, whether the symbol's last close lies in them, and how far it is from them (below 0: beyond)."""
    c = F.col
    rows = order_blocks(bars).join(_last(bars).select("symbol", c("last_c").alias("price")), "symbol")
    return rows.select("symbol", "ts", "is_bullish", (c("top") - c("bottom")).alias("height"), c("price").between(c("bottom"), c("top")).alias("contains"), F.when(c("is_bullish"), c("price") - c("top")).otherwise(c("bottom") - c("price")).alias("distance"))


def gap_geometry(bars: DataFrame) -> DataFrame:
    """Fair-value gaps: their size, middle, and whether the symbol's last close lies in them."""
    c = F.col
    rows = fair_value_gaps(bars).join(_last(bars).select("symbol", c("last_c").alias("price")), "symbol")
    return rows.select("symbol", "ts", "kind", (c("top") - c("bottom")).alias("size"), ((c("top") + c("bottom")) / 2).alias("middle"), c("price").between(c("bottom"), c("top")).alias("contains"))


def breaks(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Of each symbol's last five swings those that the last bar went beyond; a change of character breaks against the break before it."""
    order = W.partitionBy("symbol").orderBy("ts", "kind")
    recent = swings(bars, reach).withColumn("n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("kind")))).where("n <= 5").join(_last(bars), "symbol")
    broken = recent.where(((F.col("kind") == "high") & (F.col("last_h") > F.col("price"))) | ((F.col("kind") == "low") & (F.col("last_l") < F.col("price"))))
    return broken.select("symbol", "ts", "kind", "price", F.coalesce(F.lag("kind").over(order) != F.col("kind"), F.lit(False)).alias("is_choch"))


LEVELS = pa.schema([("symbol", pa.string()), ("price", pa.float64()), ("touches", pa.int64()), ("first_touch", pa.timestamp("us", "UTC")), ("last_touch", pa.timestamp("us", "UTC")), ("kind", pa.string()), ("strength", pa.float64())])
LEVEL = "symbol string, price double, touches long, first_touch timestamp, last_touch timestamp, kind string, strength double"


def levels(bars: DataFrame, tolerance: float = 0.002, least: int = 2, most: int = 10) -> DataFrame:
    """Support and resistance: swings of two bars join the first level within the tolerance (of the mean close) in order of time.

    Which level a swing joins depends on those before, so a symbol's swings, a small part of its bars, pass through one task in
    order; what it holds are the levels, which lie a tolerance apart. The strongest are returned; symbols of under 10 bars
    have none.
    """
    means = bars.groupBy("symbol").agg(F.avg("c").alias("mean"), F.count("*").alias("n")).where("n >= 10").drop("n")
    rows = swings(bars, 2).join(means, "symbol").select("symbol", "ts", F.when(F.col("kind") == "high", "resistance").otherwise("support").alias("kind"), "price", "mean")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[dict] = []
        order: list[tuple[float, int]] = []  # the levels' prices and numbers, by price
        symbol, last = None, None
        for b in batches:
            for symbol, ts, kind, price, mean in zip(*(b.column(x).to_pylist() for x in ("symbol", "ts", "kind", "price", "mean"))):
                if last is not None and ts < last:
                    raise ValueError("swings of a symbol came out of order")
                last, at = ts, bisect_left(order, (price, -1))
                near = [k for p, k in order[max(0, at - 1) : at + 1] if abs(price - p) / mean < tolerance]
                if near:
                    level = found[min(near)]
                    level["touches"] += 1
                    level["last_touch"] = ts
                    level["strength"] += 1 / (1 + abs(price - level["price"]) / mean * 100)
                else:
                    order.insert(at, (price, len(found)))
                    found.append({"symbol": symbol, "price": price, "touches": 1, "first_touch": ts, "last_touch": ts, "kind": kind, "strength": 1.0})
        kept = sorted((x for x in found if x["touches"] >= least), key=lambda x: -x["strength"])[:most]
        yield pa.RecordBatch.from_pylist(kept, LEVELS)

    return rows.repartition("symbol").sortWithinPartitions("symbol", "ts", "kind").groupBy("symbol").applyInArrow(each, LEVEL)


def regime(shannon: Column, lempel: Column, permutation: Column) -> tuple[Column, Column]:
    """The market's regime by three entropies (null: a half), and how far they agree."""
    s, z, p = (F.coalesce(x, F.lit(0.5)) for x in (shannon, lempel, permutation))
    mean = (s + z + p) / 3
    spread = ((s - mean) * (s - mean) + (z - mean) * (z - mean) + (p - mean) * (p - mean)) / 3
    none = shannon.isNull() & lempel.isNull() & permutation.isNull()
    name = F.when(none, "transitioning").when((s < 0.4) & (z < 0.4) & (p < 0.4), "structured").when((s > 0.7) & (z > 0.7) & (p > 0.7), "random").when((p < 0.5) & (s > 0.4) & (s < 0.8), "trending").when((s > 0.6) & (z < 0.5), "ranging").otherwise("transitioning")
    return name, F.when(none, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - 4 * spread))


def correlated_exposure(bars: DataFrame, threshold: float = 0.05) -> DataFrame:
    """The sum over pairs of symbols of the smaller notional (the last close) times the correlation's size, where it is great enough."""
    last = _last(bars).select("symbol", "last_c")
    pairs = correlations(bars).where(F.col("a") < F.col("b")).join(last.toDF("a", "x"), "a").join(last.toDF("b", "y"), "b")
    return pairs.where(F.abs("correlation") >= threshold).agg(F.coalesce(F.sum(F.least("x", "y") * F.abs("correlation")), F.lit(0.0)).alias("exposure"), F.count("*").alias("n_pairs"))


def latest_versions(definitions: DataFrame) -> DataFrame:
    """(name, version, ...) -> the latest version of each name."""
    return definitions.withColumn("__n", F.row_number().over(W.partitionBy("name").orderBy(F.desc("version")))).where("__n = 1").drop("__n")


def with_definitions(instances: DataFrame, definitions: DataFrame) -> DataFrame:
    return instances.join(definitions, "definition_id")
