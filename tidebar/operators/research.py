"""Statistics of returns, risk sizes and limits, market structure, and a backtest of moving-average crosses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

YEAR = 252.0


def by_time():
    return W.partitionBy("symbol").orderBy("ts")


def returns(bars: DataFrame) -> DataFrame:
    """symbol, ts, c, r (simple, 0 at the first bar or after a price of 0) and lr (logarithmic)."""
    before = F.lag("c").over(by_time())
    simple = F.when(before != 0, (F.col("c") - before) / F.nullif(before, F.lit(0.0))).otherwise(0.0)
    return bars.select("symbol", "ts", "c", simple.alias("r"), F.when((before > 0) & (F.col("c") > 0), F.log(F.col("c") / F.nullif(before, F.lit(0.0)))).otherwise(0.0).alias("lr"), (F.row_number().over(by_time()) - 1).alias("i"))


def moments(bars: DataFrame) -> DataFrame:
    c = F.col("c")
    return bars.groupBy("symbol").agg(F.avg(c).alias("mean"), F.var_pop(c).alias("variance"), F.stddev_pop(c).alias("stdev"), F.stddev_samp(c).alias("sample_stdev"), F.min(c).alias("low"), F.max(c).alias("high"))


def trend_line(bars: DataFrame) -> DataFrame:
    """Least squares of the close over the bar's number, from sums that add up in parts."""
    rows = returns(bars).withColumn("i", F.col("i").cast("double"))
    return rows.groupBy("symbol").agg(F.regr_slope("c", "i").alias("slope"), F.regr_intercept("c", "i").alias("intercept"), F.regr_r2("c", "i").alias("r2"))


def ratios(bars: DataFrame, rate: float = 0.0) -> DataFrame:
    """Sharpe (mean over sample deviation), Sortino (downside rows alone), profit factor and share of wins, of the returns."""
    rows = returns(bars).where("i > 0")
    x = F.col("r") - rate / YEAR
    down = F.sqrt(F.avg(F.when(x < 0, x * x)))
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("r") < 0, -F.col("r")).otherwise(0.0))
    return rows.groupBy("symbol").agg((F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)) * YEAR**0.5).alias("sharpe"), (F.avg(x) / down * YEAR**0.5).alias("sortino"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("win_rate"))


def drawdown(bars: DataFrame) -> DataFrame:
    """The largest fall from a peak so far as a share of it, with the times of trough and peak."""
    upto = by_time().rowsBetween(W.unboundedPreceding, 0)
    rows = bars.select("symbol", "ts", "c", F.max("c").over(upto).alias("peak"), F.max(F.struct("c", (-F.unix_seconds("ts")).alias("at"))).over(upto)["at"].alias("at"))
    share = (F.col("peak") - F.col("c")) / F.nullif("peak", F.lit(0.0))
    first = F.struct(share, -F.unix_seconds("ts"))
    return rows.groupBy("symbol").agg(F.max(share).alias("max_drawdown"), F.max_by("ts", first).alias("trough"), F.timestamp_seconds(-F.max_by("at", first)).alias("peak_at"))


def calmar(bars: DataFrame) -> DataFrame:
    whole = returns(bars).groupBy("symbol").agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("total_return"))
    return whole.join(drawdown(bars).select("symbol", "max_drawdown"), "symbol").withColumn("calmar", F.col("total_return") / F.nullif("max_drawdown", F.lit(0.0)))


def hurst(bars: DataFrame) -> DataFrame:
    """Rescaled range of the log returns in one window: ln(R/S)/ln(n) within 0 and 1, 0.5 for fewer than 20."""
    rows = returns(bars).where("i > 0")
    mean = F.avg("lr").over(W.partitionBy("symbol"))
    rows = rows.withColumn("d", F.col("lr") - mean).withColumn("y", F.sum("d").over(by_time().rowsBetween(W.unboundedPreceding, 0)))
    rs = (F.max("y") - F.min("y")) / F.nullif(F.stddev_pop("lr"), F.lit(0.0))
    return rows.groupBy("symbol").agg(F.when(F.count("*") < 20, 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.log(rs) / F.log(F.count("*").cast("double"))))).alias("hurst"))


def against(bars: DataFrame, market: str) -> DataFrame:
    """Of each symbol against one: beta, Jensen's alpha, correlation, information ratio, on the times that both have."""
    rows = returns(bars).where("i > 0").select("symbol", "ts", "r")
    base = rows.where(F.col("symbol") == market).select("ts", F.col("r").alias("m"))
    both = rows.join(base, "ts").withColumn("active", F.col("r") - F.col("m"))
    beta = F.covar_pop("r", "m") / F.nullif(F.var_pop("m"), F.lit(0.0))
    return both.groupBy("symbol").agg(beta.alias("beta"), (F.avg("r") - beta * F.avg("m")).alias("alpha"), F.corr("r", "m").alias("correlation"), (F.avg("active") / F.nullif(F.stddev_samp("active"), F.lit(0.0))).alias("information_ratio"))


def correlations(bars: DataFrame) -> DataFrame:
    """All pairs of symbols by an equi-join on time."""
    rows = returns(bars).where("i > 0")
    a, b = rows.select("ts", F.col("symbol").alias("a"), F.col("r").alias("x")), rows.select("ts", F.col("symbol").alias("b"), F.col("r").alias("y"))
    return a.join(b, "ts").groupBy("a", "b").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.corr("x", "y"))).alias("correlation"))


# Risk


def fixed_fraction(balance: Column, risk: float, entry: Column, stop: Column) -> Column:
    return balance * max(0.001, min(1.0, risk)) / F.nullif(F.abs(entry - stop), F.lit(0.0))


def atr_size(balance: Column, risk: float, atr: Column, mult: float) -> Column:
    return balance * risk / F.nullif(atr * mult, F.lit(0.0))


def volatility_target(balance: Column, target: float, price: Column, sigma: Column) -> Column:
    return balance * target / F.nullif(price * sigma * YEAR**0.5, F.lit(0.0))


def kelly(win_rate: Column, win_loss: Column, fraction: float = 0.5, most: float = 0.25) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), (win_rate * win_loss - (1 - win_rate)) / F.nullif(win_loss, F.lit(0.0)) * fraction))


def optimal_f(bars: DataFrame) -> DataFrame:
    """The fraction of 0.01 to 1 that makes the product of 1 + f * pnl / largest loss greatest, of equals the smaller.

    Sums of logarithms over a grid of a hundred fractions, one grouped aggregation with a hundred columns.
    """
    rows = returns(bars).where("i > 0").withColumn("worst", -F.min("r").over(W.partitionBy("symbol")))
    growth = lambda f: F.log(F.greatest(F.lit(1e-12), 1 + f * F.col("r") / F.nullif("worst", F.lit(0.0))))
    sums = rows.groupBy("symbol").agg(F.max("worst").alias("worst"), *(F.sum(growth(k / 100)).alias(f"g{k}") for k in range(1, 101)))
    best = F.array_max(F.array(*(F.struct(F.round(f"g{k}", 9).alias("g"), F.lit(-k).alias("k")) for k in range(1, 101))))["k"]
    return sums.select("symbol", F.when(F.col("worst") > 0, -best / 100).otherwise(0.25).alias("optimal_f"))


def exposures(orders: DataFrame, customers: DataFrame, nations: DataFrame) -> DataFrame:
    """Positions (an order of a customer) by sector (the customer's nation), with the share of all."""
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.col("n_name").alias("sector")).agg(F.sum("o_totalprice").alias("notional"), F.count("*").alias("n"))
    return sums.withColumn("share", F.col("notional") / F.sum("notional").over(W.partitionBy()))


# Structure


def swings(bars: DataFrame, reach: int = 5) -> DataFrame:
    """Bars whose high (low) is strictly above (below) that of `reach` bars on both sides: looks ahead."""
    before, after = by_time().rowsBetween(-reach, -1), by_time().rowsBetween(1, reach)
    out = bars.select("symbol", "ts", "h", "l", *(f.over(w).alias(n) for n, f, w in (("hb", F.max("h"), before), ("ha", F.max("h"), after), ("lb", F.min("l"), before), ("la", F.min("l"), after), ("nb", F.count("h"), before), ("na", F.count("h"), after))))
    whole = (F.col("nb") == reach) & (F.col("na") == reach)
    high, low = whole & (F.col("h") > F.greatest("hb", "ha")), whole & (F.col("l") < F.least("lb", "la"))
    kinds = F.array(F.when(high, F.struct(F.lit("high").alias("kind"), F.col("h").alias("price"))), F.when(low, F.struct(F.lit("low").alias("kind"), F.col("l").alias("price"))))
    return out.select("symbol", "ts", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("s")).select("symbol", "ts", "s.kind", "s.price")


def structure(bars: DataFrame, reach: int = 5) -> DataFrame:
    """By the last two swing highs and lows: higher highs and lows are bullish, lower ones bearish, else ranging."""
    rows = swings(bars, reach).withColumn("n", F.row_number().over(W.partitionBy("symbol", "kind").orderBy(F.desc("ts"))))
    at = lambda kind, n: F.max(F.when((F.col("kind") == kind) & (F.col("n") == n), F.col("price")))
    out = rows.where("n <= 2").groupBy("symbol").agg(at("high", 1).alias("h1"), at("high", 2).alias("h2"), at("low", 1).alias("l1"), at("low", 2).alias("l2"))
    return out.withColumn("trend", F.when((F.col("h1") > F.col("h2")) & (F.col("l1") > F.col("l2")), "bullish").when((F.col("h1") < F.col("h2")) & (F.col("l1") < F.col("l2")), "bearish").otherwise("ranging"))


def fair_value_gaps(bars: DataFrame) -> DataFrame:
    """Three bars of which the outer two leave a gap of more than a thousandth of the middle close."""
    a, d = by_time(), F.col
    out = bars.select("symbol", "ts", "c", F.lag("h").over(a).alias("h1"), F.lag("l").over(a).alias("l1"), F.lead("h").over(a).alias("h3"), F.lead("l").over(a).alias("l3"))
    up, down = d("l3") - d("h1"), d("l1") - d("h3")
    return out.select("symbol", "ts", F.when(up > 0.001 * d("c"), "bullish").when(down > 0.001 * d("c"), "bearish").alias("kind"), F.when(up > 0.001 * d("c"), d("h1")).otherwise(d("h3")).alias("bottom"), F.when(up > 0.001 * d("c"), d("l3")).otherwise(d("l1")).alias("top")).where("kind is not null")


def pivots(bars: DataFrame) -> DataFrame:
    """Classic levels of each day from the day before's bar."""
    day = W.partitionBy("symbol").orderBy("day")
    days = bars.groupBy("symbol", F.date_trunc("day", "ts").alias("day")).agg(F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "ts").alias("c"))
    days = days.select("symbol", "day", *(F.lag(x).over(day).alias(x) for x in "hlc")).where("c is not null").withColumn("p", (F.col("h") + F.col("l") + F.col("c")) / 3)
    p, h, l = F.col("p"), F.col("h"), F.col("l")  # noqa: E741
    return days.select("symbol", "day", "p", (2 * p - l).alias("r1"), (p + h - l).alias("r2"), (h + 2 * (p - l)).alias("r3"), (2 * p - h).alias("s1"), (p - h + l).alias("s2"), (l - 2 * (h - p)).alias("s3"))


# Backtest


def sma_cross_trades(bars: DataFrame, fast: int = 9, slow: int = 21) -> DataFrame:
    """Long-only trades of crossing means: a cross at a bar's close fills at the open of the bar after the next.

    Signals are windows, fills a lead, trades the pairing of an entry with the exit that follows: no loop over bars. An
    entry without an exit closes at the symbol's last close.
    """
    w = by_time()
    mean = lambda n: F.when(F.count("c").over(w.rowsBetween(1 - n, 0)) == n, F.avg("c").over(w.rowsBetween(1 - n, 0)))
    rows = bars.select("symbol", "ts", "o", "c", mean(fast).alias("a"), mean(slow).alias("b"))
    rows = rows.withColumn("d", F.sign(F.col("a") - F.col("b"))).withColumn("was", F.lag("d").over(w))
    side = F.when((F.col("d") > 0) & (F.col("was") <= 0), 1).when((F.col("d") < 0) & (F.col("was") >= 0), -1)
    rows = rows.select("symbol", "ts", side.alias("side"), F.lead("o", 2).over(w).alias("price"), F.lead("ts", 2).over(w).alias("at"), F.last("c").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end"), F.last("ts").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("end_at"))
    return paired(rows.where("side is not null"))


def paired(signals: DataFrame, *keys: str) -> DataFrame:
    """Signals (symbol, ts, side, price, at; end, end_at of the symbol; and keys) -> trades of each symbol and key.

    The first signal to buy opens, the next to sell closes; others of the same side are nothing.
    """
    w = W.partitionBy("symbol", *keys).orderBy("ts")
    fills = signals.where("price is not null").withColumn("before", F.lag("side").over(w))
    fills = fills.where((F.col("side") != F.coalesce("before", F.lit(-1))))
    trades = fills.select("symbol", *keys, "side", F.col("at").alias("entry_at"), F.col("price").alias("entry"), F.coalesce(F.lead("at").over(w), "end_at").alias("exit_at"), F.coalesce(F.lead("price").over(w), "end").alias("exit"), F.lead("price").over(w).isNull().alias("is_open"))
    return trades.where("side = 1").drop("side").withColumn("pnl", F.col("exit") - F.col("entry")).withColumn("ret", F.col("pnl") / F.nullif("entry", F.lit(0.0)))


def trade_metrics(trades: DataFrame, *keys: str) -> DataFrame:
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")).otherwise(0.0))
    return trades.groupBy("symbol", *keys).agg(F.count("*").alias("n_trades"), F.sum("pnl").alias("pnl"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.coalesce(gain / F.nullif(loss, F.lit(0.0)), F.lit(0.0)).alias("profit_factor"), F.max("pnl").alias("largest_win"), F.min("pnl").alias("largest_loss"), F.avg("ret").alias("avg_return"))


def streaks(trades: DataFrame) -> DataFrame:
    """The longest runs of wins and of losses, by gaps and islands."""
    w, kind = W.partitionBy("symbol").orderBy("entry_at"), F.col("pnl") > 0
    rows = trades.withColumn("win", kind)
    rows = rows.withColumn("run", F.row_number().over(w) - F.row_number().over(W.partitionBy("symbol", "win").orderBy("entry_at")))
    runs = rows.groupBy("symbol", "win", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("symbol").agg(F.max(F.when(F.col("win"), F.col("n")).otherwise(0)).alias("longest_wins"), F.max(F.when(~F.col("win"), F.col("n")).otherwise(0)).alias("longest_losses"))


def equity(trades: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """Equity after each closed trade of one unit, its peak and the fall from it."""
    upto = W.partitionBy("symbol").orderBy("exit_at").rowsBetween(W.unboundedPreceding, 0)
    rows = trades.withColumn("equity", capital + F.sum("pnl").over(upto))
    rows = rows.withColumn("peak", F.greatest(F.lit(capital), F.max("equity").over(upto)))
    return rows.select("symbol", "exit_at", "equity", "peak", ((F.col("peak") - F.col("equity")) / F.col("peak")).alias("drawdown"))


def sweep(bars: DataFrame, pairs: tuple[tuple[int, int], ...] = ((5, 20), (9, 21), (12, 26))) -> DataFrame:
    """Trade metrics of the crossing rule for each symbol and pair of lengths, of any number of pairs in one plan.

    Bars are exchanged once: each length's mean and the one before it are windows over the same order, and a bar gives rows
    only for the pairs that cross at it. From there on rows are signals, a small part of bars times pairs.
    """
    w = by_time()
    lengths = sorted({n for p in pairs for n in p})
    mean = lambda n: F.when(F.count("c").over(w.rowsBetween(1 - n, 0)) == n, F.avg("c").over(w.rowsBetween(1 - n, 0)))
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = bars.select("symbol", "ts", F.lead("o", 2).over(w).alias("price"), F.lead("ts", 2).over(w).alias("at"), F.last("c").over(whole).alias("end"), F.last("ts").over(whole).alias("end_at"), *(mean(n).alias(f"m{n}") for n in lengths))
    rows = rows.select("*", *(F.lag(f"m{n}").over(w).alias(f"was{n}") for n in lengths))
    rows = rows.select("symbol", "ts", "price", "at", "end", "end_at", F.array(*(f"m{n}" for n in lengths)).alias("now"), F.array(*(f"was{n}" for n in lengths)).alias("was"))
    places = F.from_json(F.lit(json.dumps([[a, z, lengths.index(a), lengths.index(z)] for a, z in pairs])), "array<array<int>>")
    sign = lambda of, p: F.sign(F.get(of, p[2]) - F.get(of, p[3]))
    side = lambda p: F.when((sign("now", p) > 0) & (sign("was", p) <= 0), 1).when((sign("now", p) < 0) & (sign("was", p) >= 0), -1)
    crossing = F.filter(F.transform(places, lambda p: F.struct(p[0].alias("fast"), p[1].alias("slow"), side(p).alias("side"))), lambda x: x["side"].isNotNull())
    signals = rows.select("symbol", "ts", "price", "at", "end", "end_at", F.explode(crossing).alias("x")).select("*", "x.*").drop("x")
    return trade_metrics(paired(signals, "fast", "slow"), "fast", "slow")

