"""Risk rules over tables: exposure limits with presets, the kill switch with its latch, sizes by a stop's distance, positions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.operators.market_queries import TS, B, add, over_bars, r
from tidebar.operators.research import sma_cross_trades
from tidebar.operators.research_queries import _T
from tidebar.sources.candles import table, wall

# Limits


@dataclass(frozen=True)
class Limits:
    """Most exposures as shares of equity, and the most positions; in the order in which they are checked."""

    total: float = 2.0
    symbol: float = 0.2
    sector: float = 0.4
    positions: int = 20
    long: float = 2.0
    short: float = 1.0


LIMITS = {"default": Limits(), "conservative": Limits(0.8, 0.1, 0.25, 15, 0.8, 0.2), "aggressive": Limits(5.0, 0.5, 0.75, 30, 5.0, 3.0)}


def exposure(positions: DataFrame) -> DataFrame:
    """(side, notional) -> one row: total, long, short, n."""
    side = lambda name: F.coalesce(F.sum(F.when(F.col("side") == name, F.col("notional"))), F.lit(0.0)).alias(name)
    return positions.agg(F.coalesce(F.sum("notional"), F.lit(0.0)).alias("total"), side("long"), side("short"), F.count("*").alias("n"))


def check_limits(candidates: DataFrame, positions: DataFrame, equity: float, limits: Limits = Limits()) -> DataFrame:
    """(sector, side, notional, ...) candidates, each against the positions held -> with `breach`, the first limit broken."""
    c, held = F.col, exposure(positions).first()
    sectors = positions.groupBy("sector").agg(F.sum("notional").alias("__sector"))
    rows, new = candidates.join(sectors, "sector", "left"), c("notional")
    breach = (
        F.when(held["total"] + new > limits.total * equity, "total").when(new > limits.symbol * equity, "symbol").when(c("sector").isNotNull() & (F.coalesce("__sector", F.lit(0.0)) + new > limits.sector * equity), "sector")
        .when(F.lit(held["n"] >= limits.positions), "positions").when((c("side") == "long") & (held["long"] + new > limits.long * equity), "long").when((c("side") == "short") & (held["short"] + new > limits.short * equity), "short").otherwise("none")
    )
    return rows.select(*candidates.columns, breach.alias("breach"))


def capacity(positions: DataFrame, equity: float, limits: Limits = Limits()) -> DataFrame:
    """What may still be opened: total, per symbol, long, short, positions, and the largest long and short position."""
    c = F.col
    rest = lambda share, used: F.greatest(F.lit(share * equity) - used, F.lit(0.0))
    out = exposure(positions).select(rest(limits.total, c("total")).alias("total"), F.lit(limits.symbol * equity).alias("symbol"), rest(limits.long, c("long")).alias("long"), rest(limits.short, c("short")).alias("short"), F.greatest(limits.positions - c("n"), F.lit(0)).cast("long").alias("positions"))
    return out.select("*", F.least("total", "symbol", "long").alias("most_long"), F.least("total", "symbol", "short").alias("most_short"))


# The kill switch


@dataclass(frozen=True)
class Switch:
    """Limits as shares, counts and seconds; `override` lets it switch off after the cooldown."""

    daily_loss: float = 0.05
    drawdown: float = 0.10
    losses: int = 5
    trades: int = 50
    cooldown_s: int = 3600
    override: bool = False


SWITCHES = {"conservative": Switch(0.02, 0.05, 3, 20, 7200), "moderate": Switch(), "aggressive": Switch(0.10, 0.20, 10, 100, 1800, True)}


def kill_switch(trades: DataFrame, balance: float = 100.0, limits: Switch = Switch()) -> DataFrame:
    """symbol, entry_at, exit_at, pnl -> after each trade the account, the limit that it reaches, and whether the switch is on.

    The limits are tried in order: loss of the day, fall from the peak, losses in a row, trades of the day. The switch stays on
    until the next day, after a fall from the peak until another limit is reached (whose rule then holds), and if it may be overridden
    until the cooldown is over. All from running sums, islands and the last event: no loop.
    """
    c = F.col
    order = ("exit_at", "entry_at")
    upto = W.partitionBy("symbol").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    day = W.partitionBy("symbol", "day").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("day", F.date_trunc("day", "exit_at")).withColumn("balance", balance + F.sum("pnl").over(upto))
    rows = rows.withColumn("peak", F.greatest(F.lit(balance), F.max("balance").over(upto))).withColumn("today", F.sum("pnl").over(day)).withColumn("n_today", F.count("*").over(day))
    rows = rows.withColumn("wins", F.sum(F.when(c("pnl") > 0, 1).otherwise(0)).over(upto))
    rows = rows.withColumn("in_a_row", F.sum(F.when(c("pnl") < 0, 1).otherwise(0)).over(W.partitionBy("symbol", "wins").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    start = c("balance") - c("today")
    rows = rows.withColumn("loss_share", F.when(start > 0, -c("today") / start).otherwise(0.0)).withColumn("fall_share", F.when(c("peak") > 0, (c("peak") - c("balance")) / c("peak")).otherwise(0.0))
    reached = F.when(c("loss_share") >= limits.daily_loss, "daily_loss").when(c("fall_share") >= limits.drawdown, "drawdown").when(c("in_a_row") >= limits.losses, "losses").when(c("n_today") >= limits.trades, "trades")
    rows = rows.withColumn("reached", reached).withColumn("event", F.last(F.when(c("reached").isNotNull(), F.struct("reached", "day", "exit_at")), ignorenulls=True).over(upto))
    on = c("event").isNotNull() & ((c("event.day") == c("day")) | (c("event.reached") == "drawdown"))
    if limits.override:
        on = on & (F.unix_seconds("exit_at") - F.unix_seconds("event.exit_at") < limits.cooldown_s)
    rows = rows.withColumn("reason", F.when(on, c("event.reached")).otherwise("none"))
    danger = lambda limit, share, whole: 1 - F.least(F.greatest((limit - c(share)) / whole, F.lit(0.0)), F.lit(1.0))
    worst = F.greatest(danger(limits.daily_loss, "loss_share", 0.05), danger(limits.drawdown, "fall_share", 0.10))
    level = F.when(worst < 0.5, 0).when(worst < 0.75, 1).when(worst < 0.9, 2).otherwise(3)
    return rows.select(
        "symbol", "entry_at", "exit_at", "balance", "peak", "today", "loss_share", "fall_share", c("in_a_row").cast("long").alias("in_a_row"), "n_today", F.coalesce("reached", F.lit("none")).alias("reached"), "reason", (c("reason") != "none").alias("is_on"),
        (limits.daily_loss - c("loss_share")).alias("to_daily_limit"), (limits.drawdown - c("fall_share")).alias("to_drawdown_limit"), level.alias("warning"),
    )


# Sizes by the distance of a stop

RISK_SHARES = {"conservative": 0.005, "moderate": 0.01, "aggressive": 0.02}


def stop_sizes(bars: DataFrame, balance: float = 10_000.0, target: float = 0.1, multiple: float = 2.0) -> DataFrame:
    """Sizes of a position entered at the close with a stop at the low; 0 where the stop is no distance away.

    By each preset share of the balance, by a volatility that the stop's distance stands for, and by a range that it implies.
    """
    away = F.abs(F.col("c") - F.col("l"))
    size = lambda risk, unit: F.coalesce(risk / F.nullif(unit, F.lit(0.0)), F.lit(0.0))
    shares = [size(F.lit(balance * k), away).alias(name) for name, k in RISK_SHARES.items()]
    daily = away / F.col("c")
    return bars.select("symbol", "ts", *shares, size(F.lit(balance * target), F.col("c") * daily * F.sqrt(F.lit(252.0))).alias("by_volatility"), size(F.lit(balance * RISK_SHARES["moderate"]), away / multiple * multiple).alias("by_range"))


# Positions


def positions(bars: DataFrame, stop: float = 0.05, goal: float = 0.1) -> DataFrame:
    """A long and a short position from the first close of each trade of the crossing rule, marked at its exit."""
    c, t = F.col, sma_cross_trades(bars)
    sides = t.withColumn("side", F.explode(F.array(F.lit("long"), F.lit("short")))).withColumn("way", F.when(c("side") == "long", 1.0).otherwise(-1.0))
    rows = sides.withColumn("stop", c("entry") * (1 - stop * c("way"))).withColumn("goal", c("entry") * (1 + goal * c("way"))).withColumn("size", F.lit(10.0))
    pnl = (c("exit") - c("entry")) * c("size") * c("way")
    risk = F.abs(c("entry") - c("stop")) * c("size")
    hit = lambda level, way: (c("exit") - c(level)) * c("way") * way >= 0
    return rows.select("symbol", "entry_at", "side", pnl.alias("pnl"), (c("size") * c("exit")).alias("notional"), risk.alias("risk"), F.coalesce(pnl / F.nullif(risk, F.lit(0.0)), F.lit(0.0)).alias("r_multiple"), hit("stop", -1).alias("stop_hit"), hit("goal", 1).alias("goal_hit"), "is_open", "entry", "exit")


def account_stats(held: DataFrame, balance: float = 10_000.0, margin: float = 0.1) -> DataFrame:
    """positions -> one row a symbol: balance, equity, exposure, leverage, margin level (null without margin), win rate over opened trades."""
    c = F.col
    open_ = lambda x: F.coalesce(F.sum(F.when(c("is_open"), x)), F.lit(0.0))
    out = held.groupBy("symbol").agg(F.count("*").alias("n_trades"), (balance + F.coalesce(F.sum(F.when(~c("is_open"), c("pnl"))), F.lit(0.0))).alias("balance"), open_(c("pnl")).alias("unrealised"), open_(c("notional")).alias("exposure"), (F.sum(F.when(~c("is_open") & (c("pnl") > 0), 1.0).otherwise(0.0)) / F.count("*")).alias("win_rate"))
    out = out.withColumn("equity", c("balance") + c("unrealised"))
    return out.select("symbol", "n_trades", "win_rate", "balance", "equity", "exposure", F.when(c("equity") > 0, c("exposure") / c("equity")).otherwise(0.0).alias("leverage"), (c("equity") / F.nullif(c("exposure") * margin, F.lit(0.0))).alias("margin_level"))


# Registered queries

EQUITY = 5_000_000.0


def _book(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as positions: the finished ones of a customer's first hundred keys are held, the open ones are candidates."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("n_name").alias("sector"), F.when(F.col("o_orderkey") % 3 == 0, "short").otherwise("long").alias("side"), F.col("o_totalprice").alias("notional"), F.col("o_orderstatus").alias("status"), F.col("c_mktsegment").alias("segment"))
    return rows.where("status = 'O'").select("id", "sector", "side", "notional"), rows.where("status = 'P'").select("id", "sector", "side", "notional")


_BOOK = "with x as (select o_orderkey as id, n_name as sector, case when o_orderkey % 3 = 0 then 'short' else 'long' end as side, o_totalprice as notional, o_orderstatus as status from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey), held as (select coalesce(sum(notional), 0) as total, coalesce(sum(notional) filter (side = 'long'), 0) as l, coalesce(sum(notional) filter (side = 'short'), 0) as s, count(*) as n from x where status = 'P'), se as (select sector, sum(notional) as z from x where status = 'P' group by 1)"


def _limit_sql(share: Limits, equity: str) -> str:
    return f"case when total + notional > {share.total!r}::double * {equity} then 'total' when notional > {share.symbol!r}::double * {equity} then 'symbol' when coalesce(z, 0) + notional > {share.sector!r}::double * {equity} then 'sector' when n >= {share.positions} then 'positions' when side = 'long' and l + notional > {share.long!r}::double * {equity} then 'long' when side = 'short' and s + notional > {share.short!r}::double * {equity} then 'short' else 'none' end"


#: Of equity that is a multiple of what is held, so that all limits come into play.
WIDE = Limits(1.6, 0.0007, 0.07, 1_000_000, 1.2, 0.45)


def _limits(spark, sf_dir: str) -> DataFrame:
    candidates, held = _book(spark, sf_dir)
    equity = exposure(held).first()["total"]
    return check_limits(candidates, held, equity, WIDE).select("id", "breach")


def _presets(spark, sf_dir: str) -> DataFrame:
    _, held = _book(spark, sf_dir)
    parts = [capacity(held, EQUITY, x).withColumn("preset", F.lit(k)) for k, x in LIMITS.items()]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("preset", *(r(x, digits=2) for x in ("total", "symbol", "long", "short", "most_long", "most_short")), "positions")


add("rk_limits", _limits, f"{_BOOK} select id, {_limit_sql(WIDE, 'total')} as breach from x left join se on se.sector is not distinct from x.sector, held where status = 'O'")
_REST = lambda share, used: f"greatest({share!r}::double * {EQUITY!r}::double - {used}, 0)"
add("x_rk_limit_cfg", _presets, f"{_BOOK}, q as (" + " union all ".join(f"select '{k}' as preset, {_REST(x.total, 'total')} as a, {x.symbol!r}::double * {EQUITY!r}::double as b, {_REST(x.long, 'l')} as c, {_REST(x.short, 's')} as d, greatest({x.positions} - n, 0)::bigint as positions from held" for k, x in LIMITS.items()) + ") select preset, round(a, 2) as total, round(b, 2) as symbol, round(c, 2) as long, round(d, 2) as short, round(least(a, b, c), 2) as most_long, round(least(a, b, d), 2) as most_short, positions from q")

#: Of the trades of one unit on a balance of 100, so that each limit is reached.
TRIED = Switch(0.3, 0.8, 5, 3)


def _switch_sql(x: Switch, balance: float = 100.0) -> str:
    return f"""{_T}, k1 as (select *, date_trunc('day', exit_at) as day, {balance!r}::double + sum(pnl) over w as balance, sum(case when pnl > 0 then 1 else 0 end) over w as wins from trades window w as (partition by symbol order by exit_at, entry_at)),
    k2 as (select *, greatest({balance!r}::double, max(balance) over (partition by symbol order by exit_at, entry_at)) as peak, sum(pnl) over d as today, count(*) over d as n_today, (sum(case when pnl < 0 then 1 else 0 end) over (partition by symbol, wins order by exit_at, entry_at))::bigint as in_a_row from k1 window d as (partition by symbol, day order by exit_at, entry_at)),
    k3 as (select *, case when balance - today > 0 then -today / (balance - today) else 0 end as loss_share, case when peak > 0 then (peak - balance) / peak else 0 end as fall_share, row_number() over (partition by symbol order by exit_at, entry_at) as i from k2),
    k4 as (select *, case when loss_share >= {x.daily_loss!r}::double then 'daily_loss' when fall_share >= {x.drawdown!r}::double then 'drawdown' when in_a_row >= {x.losses} then 'losses' when n_today >= {x.trades} then 'trades' end as reached from k3),
    k5 as (select a.*, (select arg_max(e.reached, e.i) from k4 e where e.symbol = a.symbol and e.i <= a.i and e.reached is not null and (e.day = a.day or e.i = (select max(f.i) from k4 f where f.symbol = a.symbol and f.i <= a.i and f.reached is not null) and e.reached = 'drawdown')) as held, (select arg_max(e.exit_at, e.i) from k4 e where e.symbol = a.symbol and e.i <= a.i and e.reached is not null) as since from k4 a)"""


_DANGER = lambda x: f"greatest(1 - least(greatest(({x.daily_loss!r}::double - loss_share) / 0.05::double, 0), 1), 1 - least(greatest(({x.drawdown!r}::double - fall_share) / 0.1::double, 0), 1))"
add(
    "rk_kill_switch",
    over_bars(lambda b: kill_switch(sma_cross_trades(b), limits=TRIED).select("symbol", wall("entry_at").alias("entry_at"), r("balance"), r("peak"), "in_a_row", "n_today", "reached", "reason", "is_on")),
    f"{_switch_sql(TRIED)} select symbol, entry_at, round(balance, 6) as balance, round(peak, 6) as peak, in_a_row, n_today, coalesce(reached, 'none') as reached, coalesce(held, 'none') as reason, held is not null as is_on from k5",
)
add(
    "rk_kill_stats",
    over_bars(lambda b: kill_switch(sma_cross_trades(b), 1000.0, TRIED).select("symbol", wall("entry_at").alias("entry_at"), r("today"), r("loss_share"), r("fall_share"), r("to_daily_limit"), r("to_drawdown_limit"), "warning")),
    f"{_switch_sql(TRIED, 1000.0)} select symbol, entry_at, round(today, 6) + 0 as today, round(loss_share, 6) + 0 as loss_share, round(fall_share, 6) as fall_share, round({TRIED.daily_loss!r}::double - loss_share, 6) as to_daily_limit, round({TRIED.drawdown!r}::double - fall_share, 6) as to_drawdown_limit, case when {_DANGER(TRIED)} < 0.5 then 0 when {_DANGER(TRIED)} < 0.75 then 1 when {_DANGER(TRIED)} < 0.9::double then 2 else 3 end as warning from k5",
)


def _switch_presets(b: DataFrame) -> DataFrame:
    out, trades = None, sma_cross_trades(b)
    for name, x in SWITCHES.items():
        part = kill_switch(trades, 1000.0, x).groupBy("symbol").agg(F.count_if("is_on").alias("n_on"), F.count_if(F.col("reached") != "none").alias("n_reached")).withColumn("preset", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.select("preset", "symbol", "n_on", "n_reached")


_ON = lambda x: "held is not null" + (f" and epoch(exit_at - since) < {x.cooldown_s}" if x.override else "")
add("x_rk_kill_cfg", over_bars(_switch_presets), " union all ".join(f"select * from ({_switch_sql(x, 1000.0)} select '{k}' as preset, symbol, count(*) filter ({_ON(x)}) as n_on, count(reached) as n_reached from k5 group by symbol)" for k, x in SWITCHES.items()))
add("x_rk_size_stop", over_bars(lambda b: stop_sizes(b).select("symbol", TS(), *(r(x) for x in (*RISK_SHARES, "by_volatility", "by_range")))), f"{B} select symbol, ts, {', '.join(f'round(coalesce({10000 * k}::double / nullif(abs(c - l), 0), 0), 6) as {n}' for n, k in RISK_SHARES.items())}, round(coalesce(1000.0::double / nullif(c * (abs(c - l) / c) * sqrt(252), 0), 0), 6) as by_volatility, round(coalesce(100.0::double / nullif(abs(c - l), 0), 0), 6) as by_range from b")

_POSITIONS = f"{_T}, ps as (select *, case side when 'long' then 1 else -1 end as way from trades, (values ('long'), ('short')) v(side)), po as (select symbol, entry_at, side, is_open, (exit - entry) * 10 * way as pnl, 10 * exit as notional, abs(entry * 0.05::double) * 10 as risk, (exit - entry * (1 - 0.05::double * way)) * way <= 0 as stop_hit, (exit - entry * (1 + 0.1::double * way)) * way >= 0 as goal_hit from ps)"
add("rk_position_pnl", over_bars(lambda b: positions(b).select("symbol", wall("entry_at").alias("entry_at"), "side", r("pnl"), r("r_multiple"), "stop_hit", "goal_hit")), f"{_POSITIONS} select symbol, entry_at, side, round(pnl, 6) + 0 as pnl, round(coalesce(pnl / nullif(risk, 0), 0), 6) + 0 as r_multiple, stop_hit, goal_hit from po")
add("x_rk_position", over_bars(lambda b: positions(b).select("symbol", wall("entry_at").alias("entry_at"), "side", r("notional"), r("risk"), "is_open")), f"{_POSITIONS} select symbol, entry_at, side, round(notional, 6) as notional, round(risk, 6) as risk, is_open from po")
add("rk_account_stats", over_bars(lambda b: account_stats(positions(b)).select("symbol", "n_trades", *(r(x) for x in ("win_rate", "balance", "equity", "exposure", "leverage", "margin_level")))), f"{_POSITIONS}, ac as (select symbol, count(*) as n_trades, count(*) filter (not is_open and pnl > 0) / count(*) as win_rate, 10000.0::double + coalesce(sum(pnl) filter (not is_open), 0) as balance, coalesce(sum(pnl) filter (is_open), 0) as un, coalesce(sum(notional) filter (is_open), 0) as exposure from po group by 1) select symbol, n_trades, round(win_rate, 6) as win_rate, round(balance, 6) as balance, round(balance + un, 6) as equity, round(exposure, 6) as exposure, round(exposure / (balance + un), 6) as leverage, round((balance + un) / nullif(exposure * 0.1::double, 0), 6) as margin_level from ac")
