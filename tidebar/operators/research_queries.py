"""Registered queries of operators/research.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import research as s
from tidebar.operators.market_queries import TS, B, add, over_bars, r
from tidebar.sources.candles import table, wall




_R = f"{B}, r as (select symbol, ts, c, row_number() over w - 1 as i, coalesce((c - lag(c) over w) / nullif(lag(c) over w, 0), 0) as r, coalesce(case when c > 0 and lag(c) over w > 0 then ln(c / lag(c) over w) end, 0) as lr from b window w as (partition by symbol order by ts))"
N = 252.0**0.5


def over(key: str, f, columns: list, sql: str) -> None:
    add(key, over_bars(lambda b: f(b).select(*[x() if callable(x) else x for x in columns])), sql)


def rr(*names: str) -> list:
    return [lambda n=n: r(n) for n in names]


over("pf_returns", s.returns, ["symbol", TS, *rr("r", "lr")], f"{_R} select symbol, ts, round(r, 6) + 0 as r, round(lr, 6) + 0 as lr from r")
over("st_moments", s.moments, ["symbol", *rr("mean", "variance", "stdev", "sample_stdev", "low", "high")], f"{B} select symbol, round(avg(c), 6) as mean, round(var_pop(c), 6) as variance, round(stddev_pop(c), 6) as stdev, round(stddev_samp(c), 6) as sample_stdev, min(c) as low, max(c) as high from b group by symbol")
over("st_linreg", s.trend_line, ["symbol", *rr("slope", "intercept", "r2")], f"{_R} select symbol, round(regr_slope(c, i), 6) as slope, round(regr_intercept(c, i), 6) as intercept, round(regr_r2(c, i), 6) as r2 from r group by symbol")
over("pf_sharpe", s.ratios, ["symbol", *rr("sharpe", "sortino")], f"{_R} select symbol, round(avg(r) / stddev_samp(r) * {N!r}::double, 6) as sharpe, round(avg(r) / sqrt(avg(case when r < 0 then r * r end)) * {N!r}::double, 6) as sortino from r where i > 0 group by symbol")
over("pf_sortino", s.ratios, ["symbol", *rr("sortino")], f"{_R} select symbol, round(avg(r) / sqrt(avg(case when r < 0 then r * r end)) * {N!r}::double, 6) as sortino from r where i > 0 group by symbol")
over("pf_profit_factor", s.ratios, ["symbol", *rr("profit_factor", "win_rate")], f"{_R} select symbol, round(sum(case when r > 0 then r else 0 end) / sum(case when r < 0 then -r else 0 end), 6) as profit_factor, round(avg(case when r > 0 then 1.0::double else 0 end), 6) as win_rate from r where i > 0 group by symbol")
_DD = "d as (select symbol, ts, c, max(c) over w as peak, arg_max(ts, (c, -epoch(ts))) over w as pk from b window w as (partition by symbol order by ts)), m as (select symbol, max((peak - c) / peak) as dd, arg_max(ts, ((peak - c) / peak, -epoch(ts))) as trough, arg_max(pk, ((peak - c) / peak, -epoch(ts))) as peak_at from d group by symbol)"
over("pf_max_dd", s.drawdown, ["symbol", lambda: r("max_drawdown"), lambda: wall("trough").alias("trough"), lambda: wall("peak_at").alias("peak_at")], f"{B}, {_DD} select symbol, round(dd, 6) as max_drawdown, trough, peak_at from m")
over("pf_calmar", s.calmar, ["symbol", *rr("total_return", "max_drawdown", "calmar")], f"{_R}, {_DD}, t as (select symbol, exp(sum(ln(1 + r))) - 1 as total_return from r group by symbol) select symbol, round(total_return, 6) as total_return, round(dd, 6) as max_drawdown, round(total_return / dd, 6) as calmar from t join m using (symbol)")
over("pf_hurst", s.hurst, ["symbol", *rr("hurst")], f"{_R}, d as (select symbol, ts, lr, lr - avg(lr) over (partition by symbol) as d from r where i > 0), y as (select *, sum(d) over (partition by symbol order by ts) as y from d) select symbol, round(greatest(0, least(1, ln((max(y) - min(y)) / stddev_pop(lr)) / ln(count(*)))), 6) as hurst from y group by symbol")
_BOTH = f"{_R}, x as (select a.symbol, a.r, m.r as m from r a join r m on a.ts = m.ts and m.symbol = 'view' where a.i > 0 and m.i > 0)"
over("pf_beta", lambda b: s.against(b, "view"), ["symbol", *rr("beta", "alpha")], f"{_BOTH} select symbol, round(covar_pop(r, m) / var_pop(m), 6) + 0 as beta, round(avg(r) - covar_pop(r, m) / var_pop(m) * avg(m), 6) + 0 as alpha from x group by symbol")
over("pf_info_ratio", lambda b: s.against(b, "view"), ["symbol", *rr("information_ratio")], f"{_BOTH} select symbol, round(avg(r - m) / nullif(stddev_samp(r - m), 0), 6) + 0 as information_ratio from x group by symbol")
over("st_corr", lambda b: s.against(b, "view"), ["symbol", *rr("correlation")], f"{_BOTH} select symbol, round(corr(r, m), 6) + 0 as correlation from x group by symbol")
over("rk_corr_matrix", s.correlations, ["a", "b", *rr("correlation")], f"{_R} select x.symbol as a, y.symbol as b, round(greatest(-1, least(1, corr(x.r, y.r))), 6) + 0 as correlation from r x join r y using (ts) where x.i > 0 and y.i > 0 group by 1, 2")
over("rk_optimal_f", s.optimal_f, ["symbol", *rr("optimal_f")], f"{_R}, w as (select symbol, r, -min(r) over (partition by symbol) as worst from r where i > 0), g as (select symbol, k, round(sum(ln(greatest(1e-12, 1 + k / 100.0::double * r / worst))), 9) as g from w, range(1, 101) t(k) group by symbol, k) select symbol, round(arg_max(k, (g, -k)) / 100.0::double, 6) as optimal_f from g group by symbol")


def _sized(b):
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("ts").rowsBetween(-13, 0)
    out = b.withColumn("range", F.avg(F.col("h") - F.col("l")).over(w)).withColumn("sigma", F.stddev_pop("c").over(w))
    money = F.lit(10000.0)
    return out.select("symbol", TS(), r(s.fixed_fraction(money, 0.01, F.col("c"), F.col("l")), "by_stop"), r(s.atr_size(money, 0.01, F.col("range"), 2.0), "by_range"), r(s.volatility_target(money, 0.1, F.col("c"), F.col("sigma")), "by_volatility"))


_SIZED = f"{B}, z as (select *, avg(h - l) over w as range, stddev_pop(c) over w as sigma from b window w as (partition by symbol order by ts rows 13 preceding))"
add("rk_fixed_fraction", over_bars(lambda b: _sized(b).select("symbol", "ts", "by_stop")), f"{_SIZED} select symbol, ts, round(100.0::double / nullif(abs(c - l), 0), 6) as by_stop from z")
add("rk_atr_size", over_bars(lambda b: _sized(b).select("symbol", "ts", "by_range")), f"{_SIZED} select symbol, ts, round(100.0::double / nullif(range * 2, 0), 6) as by_range from z")
add("rk_vol_target", over_bars(lambda b: _sized(b).select("symbol", "ts", "by_volatility")), f"{_SIZED} select symbol, ts, round(1000.0::double / nullif(c * sigma * {N!r}::double, 0), 6) as by_volatility from z")
add("rk_kelly", over_bars(lambda b: s.ratios(b).select("symbol", r(s.kelly(F.col("win_rate"), F.col("profit_factor")), "kelly"))), f"{_R}, q as (select symbol, sum(case when r > 0 then r else 0 end) / sum(case when r < 0 then -r else 0 end) as b, avg(case when r > 0 then 1.0::double else 0 end) as p from r where i > 0 group by symbol) select symbol, round(greatest(0, least(0.25::double, (p * b - (1 - p)) / b * 0.5::double)), 6) + 0 as kelly from q")
_EXP = "with e as (select n_name as sector, sum(o_totalprice) as notional, count(*) as n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1), x as (select *, notional / sum(notional) over () as share from e)"


def _exposed(spark, sf_dir):
    return s.exposures(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"))


add("rk_exposure", lambda spark, d: _exposed(spark, d).select("sector", r("notional", digits=2), "n", r("share")), f"{_EXP} select sector, round(notional, 2) as notional, n, round(share, 6) as share from x")

_SW = f"{B}, w as (select *, max(h) over (p rows between 5 preceding and 1 preceding) as hb, max(h) over (p rows between 1 following and 5 following) as ha, min(l) over (p rows between 5 preceding and 1 preceding) as lb, min(l) over (p rows between 1 following and 5 following) as la, row_number() over p as i, count(*) over (partition by symbol) as z from b window p as (partition by symbol order by ts)), s as (select symbol, ts, 'high' as kind, h as price from w where i > 5 and i <= z - 5 and h > greatest(hb, ha) union all select symbol, ts, 'low', l from w where i > 5 and i <= z - 5 and l < least(lb, la))"
over("smc_swings", s.swings, ["symbol", TS, "kind", "price"], f"{_SW} select symbol, ts, kind, price from s")
over("smc_structure", s.structure, ["symbol", "h1", "h2", "l1", "l2", "trend"], f"{_SW}, n as (select *, row_number() over (partition by symbol, kind order by ts desc) as n from s), q as (select symbol, max(price) filter (kind = 'high' and n = 1) as h1, max(price) filter (kind = 'high' and n = 2) as h2, max(price) filter (kind = 'low' and n = 1) as l1, max(price) filter (kind = 'low' and n = 2) as l2 from n group by symbol) select *, case when h1 > h2 and l1 > l2 then 'bullish' when h1 < h2 and l1 < l2 then 'bearish' else 'ranging' end as trend from q")
over("smc_fvg", s.fair_value_gaps, ["symbol", TS, "kind", "bottom", "top"], f"{B}, g as (select symbol, ts, c, lag(h) over w as h1, lag(l) over w as l1, lead(h) over w as h3, lead(l) over w as l3 from b window w as (partition by symbol order by ts)) select symbol, ts, case when l3 - h1 > 0.001::double * c then 'bullish' else 'bearish' end as kind, case when l3 - h1 > 0.001::double * c then h1 else h3 end as bottom, case when l3 - h1 > 0.001::double * c then l3 else l1 end as top from g where l3 - h1 > 0.001::double * c or l1 - h3 > 0.001::double * c")
over("ch_pivots", s.pivots, ["symbol", lambda: wall("day").alias("day"), *rr("p", "r1", "r2", "r3", "s1", "s2", "s3")], f"{B}, d as (select symbol, date_trunc('day', ts)::timestamp as day, max(h) as h, min(l) as l, arg_max(c, ts) as c from b group by 1, 2), y as (select symbol, day, lag(h) over w as h, lag(l) over w as l, lag(c) over w as c from d window w as (partition by symbol order by day)), z as (select *, (h + l + c) / 3 as p from y where c is not null) select symbol, day, round(p, 6) as p, round(2 * p - l, 6) as r1, round(p + h - l, 6) as r2, round(h + 2 * (p - l), 6) as r3, round(2 * p - h, 6) + 0 as s1, round(p - h + l, 6) + 0 as s2, round(l - 2 * (h - p), 6) + 0 as s3 from z")


def _trades(a: int, z: int) -> str:
    return f"""m as (select *, case when row_number() over w >= {a} then avg(c) over (w rows {a - 1} preceding) end as a, case when row_number() over w >= {z} then avg(c) over (w rows {z - 1} preceding) end as b,
        lead(o, 2) over w as price, lead(ts, 2) over w as fill from b window w as (partition by symbol order by ts)),
        g as (select *, sign(a - b) as d, lag(sign(a - b)) over (partition by symbol order by ts) as was from m),
        f as (select symbol, ts, price, fill, case when d > 0 and was <= 0 then 1 else -1 end as side from g where ((d > 0 and was <= 0) or (d < 0 and was >= 0)) and price is not null),
        k as (select *, lag(side) over (partition by symbol order by ts) as before from f), q as (select * from k where side <> coalesce(before, -1)),
        e as (select symbol, max(ts) as end_at, arg_max(c, ts) as close from b group by symbol),
        t as (select q.symbol, side, fill as entry_at, price as entry, coalesce(lead(fill) over w, end_at) as exit_at, coalesce(lead(price) over w, close) as exit, lead(price) over w is null as is_open from q join e on e.symbol = q.symbol window w as (partition by q.symbol order by ts)),
        trades as (select symbol, entry_at, entry, exit_at, exit, is_open, exit - entry as pnl, (exit - entry) / entry as ret from t where side = 1)"""


_T = f"{B}, {_trades(9, 21)}"
_METRICS = "select symbol, count(*) as n_trades, round(sum(pnl), 6) as pnl, round(avg(case when pnl > 0 then 1.0::double else 0 end), 6) as win_rate, round(coalesce(sum(case when pnl > 0 then pnl else 0 end) / nullif(sum(case when pnl < 0 then -pnl else 0 end), 0), 0), 6) as profit_factor, round(max(pnl), 6) as largest_win, round(min(pnl), 6) as largest_loss, round(avg(ret), 6) as avg_return"
_M = ["n_trades", *rr("pnl", "win_rate", "profit_factor", "largest_win", "largest_loss", "avg_return")]
over("bt_sma_cross", s.sma_cross_trades, ["symbol", lambda: wall("entry_at").alias("entry_at"), "entry", lambda: wall("exit_at").alias("exit_at"), "exit", "is_open", *rr("pnl", "ret")], f"{_T} select symbol, entry_at, entry, exit_at, exit, is_open, round(pnl, 6) + 0 as pnl, round(ret, 6) + 0 as ret from trades")
over("bt_streaks", lambda b: s.streaks(s.sma_cross_trades(b)), ["symbol", lambda: F.col("longest_wins").cast("long").alias("longest_wins"), lambda: F.col("longest_losses").cast("long").alias("longest_losses")], f"{_T}, n as (select symbol, pnl > 0 as win, row_number() over (partition by symbol order by entry_at) - row_number() over (partition by symbol, pnl > 0 order by entry_at) as run from trades), u as (select symbol, win, run, count(*) as n from n group by 1, 2, 3) select symbol, coalesce(max(n) filter (win), 0) as longest_wins, coalesce(max(n) filter (not win), 0) as longest_losses from u group by symbol")
over("bt_equity", lambda b: s.equity(s.sma_cross_trades(b)), ["symbol", lambda: wall("exit_at").alias("exit_at"), *rr("equity", "peak", "drawdown")], f"{_T}, e1 as (select symbol, exit_at, 10000.0::double + sum(pnl) over (partition by symbol order by exit_at) as equity from trades), e2 as (select *, greatest(10000.0::double, max(equity) over (partition by symbol order by exit_at)) as peak from e1) select symbol, exit_at, round(equity, 6) as equity, round(peak, 6) as peak, round((peak - equity) / peak, 6) + 0 as drawdown from e2")
_SWEEP = " union all ".join(f"select *, {a}::int as fast, {z}::int as slow from ({B}, {_trades(a, z)} {_METRICS} from trades group by symbol)" for a, z in ((5, 20), (9, 21), (12, 26)))
over("bt_sweep", s.sweep, ["symbol", "fast", "slow", *_M], _SWEEP)
