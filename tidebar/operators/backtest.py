"""Fills of orders as expressions.

An order that is decided at a bar meets the market at the next one. Orders don't depend on fills (crosses, rules), so fills are a
window over the bars; see `research.sma_cross_trades`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODELS = ("instant", "next_open", "close", "typical", "realistic")
KINDS = ("market", "limit", "stop", "stop_limit", "take_profit")


@dataclass(frozen=True)
class Costs:
    slippage: float = 0.0001
    per_unit: float = 0.0
    commission: float = 0.001
    volume_share: float = 0.1


def reached(kind: Column, buy: Column, limit: Column, stop: Column, h: Column, l: Column, c: Column, realistic: bool = False) -> Column:  # noqa: E741
    """The price at which an order of a kind fills within a bar; null if the bar does not reach it."""
    better = F.when(buy & (l <= limit), F.least(limit, c)).when(~buy & (h >= limit), F.greatest(limit, c))
    hit = F.when(buy, h >= stop).otherwise(l <= stop)
    worse = F.when(buy, F.greatest(stop, c)).otherwise(F.least(stop, c))
    out = F.when(kind == "market", c).when(kind == "limit", better).when((kind == "stop") & hit, worse if realistic else c)
    if realistic:
        return out.when(kind.isin("stop_limit", "take_profit"), c)
    exact = F.when(buy & (l <= limit), limit).when(~buy & (h >= limit), limit)
    return out.when((kind == "stop_limit") & hit, better).when(kind == "take_profit", exact)


def fills(orders: DataFrame, bars: DataFrame, model: str = "next_open", costs: Costs = Costs()) -> DataFrame:
    """orders (symbol, ts of the deciding bar, buy, kind, limit, stop, quantity) -> filled_at, price, filled, commission.

    The order is tried once, at the bar after its own; `next_open` takes the open of the bar after that. Orders that aren't
    reached have no row.
    """
    w, c = W.partitionBy("symbol").orderBy("ts"), F.col
    after = bars.select("symbol", "ts", *(F.lead(x).over(w).alias(f"b_{x}") for x in (*"ohlcv", "ts")), F.lead("o", 2).over(w).alias("n_o"), F.lead("ts", 2).over(w).alias("n_ts"))
    rows = orders.join(after, ["symbol", "ts"])
    if model == "next_open":
        price, at = c("n_o"), c("n_ts")
    elif model == "close":
        price, at = c("b_c"), c("b_ts")
    elif model == "typical":
        price, at = (c("b_h") + c("b_l") + c("b_c")) / 3, c("b_ts")
    else:
        price, at = reached(c("kind"), c("buy"), c("limit"), c("stop"), c("b_h"), c("b_l"), c("b_c"), model == "realistic"), c("b_ts")
    filled, commission = c("quantity"), F.lit(0.0)
    if model == "realistic":
        price = price * F.when(c("buy"), 1 + costs.slippage).otherwise(1 - costs.slippage)
        filled = F.least(c("quantity"), c("b_v") * costs.volume_share)
        commission = filled * costs.per_unit + filled * price * costs.commission
    out = rows.select(*orders.columns, at.alias("filled_at"), price.alias("price"), filled.alias("filled"), commission.alias("commission"))
    return out.where("price is not null and filled > 0")
