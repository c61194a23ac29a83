"""Registered queries of the indicators: every one over all hourly bars of events, with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import tidebar.operators.state  # noqa: F401  (adds to TA)
from tidebar.operators.order import MORE
from tidebar.operators.patterns import GROUPS, SIGNALS, counts, group
from tidebar.operators.ta import TA, cross
from tidebar.operators.waiting import WAITING
from tidebar.plans.chain import Chain
from tidebar.sources.candles import hourly, wall

HOURLY_SQL = """select event_type as symbol, time_bucket(interval 1 hour, ts, timestamp '1970-01-01') as ts,
    arg_min(value, (ts, event_id)) as o, max(value) as h, min(value) as l, arg_max(value, (ts, event_id)) as c,
    sum(value) as v, count(*) as n from events group by 1, 2"""

#: Names under which a batch indicator is registered besides ta_<name>: the chart's plugin ids.
PLUGINS = "adr adr_percent adx alligator alma aroon atr awesome bb bb_bandwidth bb_percent_b bbtrend bop bull_bear_power cci cmf chaikin_osc chande_kroll chande_mo choppiness coppock cvd volume_delta dema dmi donchian dpo elder_force ema envelope eom fisher hist_vol hma ichimoku jma keltner klinger lsma ma_cross ma_ribbon macd mass_index mcginley mfi momentum obv psar price_osc pvt median rci rma roc rsi rvi sma smi_ergodic smi_ergodic_osc smma stdev stoch stoch_rsi supertrend tema trend_strength trix tsi ultimate vol_osc net_volume vortex vwma williams_r wma woodies_cci zigzag".split()
#: Constant lines that a plugin draws.
LINES = {"bop": {"zero": 0}, "bull_bear_power": {"zero": 0}, "fisher": {"zero": 0}, "rci": {"overbought": 80, "oversold": -80}, "rsi": {"overbought": 70, "oversold": 30, "midline": 50}, "woodies_cci": {"plus100": 100, "minus100": -100, "zero": 0}}
#: Outputs that aren't rounded.
EXACT = {"nvi", "pvi", "mcginley"}
#: Outputs that are true or false; before the indicator is ready false.
TESTS = {"over", "under", "either", "is_bullish", "is_strong_trend", "is_uptrend"}


def rounded(out: dict[str, str], digits: int = 6) -> dict[str, str]:
    """Some decimals, so that sums in another order compare equal; -0 as 0."""
    return {k: e if e.startswith("coalesce(") and e.endswith(", false)") else f"coalesce({e}, false)" if k in TESTS else e if k in EXACT else f"round({e}, {digits}) + 0e0" for k, e in out.items()}


def indicator(make: Callable[[Chain], dict[str, str]], digits: int = 6) -> tuple[Callable[[SparkSession, str], DataFrame], str]:
    """The query of an indicator over hourly bars, and its SQL."""
    chain = Chain()
    chain.out = rounded(make(chain), digits)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = chain.apply_in_parts(hourly(spark, sf_dir))
        return out.select("symbol", wall("ts").alias("ts"), *chain.out)

    return query, chain.sql(HOURLY_SQL)


def _with_lines(name: str) -> Callable[[Chain], dict[str, str]]:
    return lambda c: TA[name](c) | {k: f"{v}e0" for k, v in LINES.get(name, {}).items()}


#: Where exact values end in a 5 at the seventh decimal.
DIGITS = {"envelope": 9, "covariance": 9}

MADE = {f"ta_{name}": indicator(f, DIGITS.get(name, 6)) for name, f in TA.items()} | {name: indicator(_with_lines(name), DIGITS.get(name, 6)) for name in PLUGINS}
MADE |= {f"s_{name}": indicator(f, DIGITS.get(name, 6)) for name, f in WAITING.items()}
MADE |= {k: indicator(group(names)) for k, names in GROUPS.items()} | {"pt_detect": indicator(counts)}
MADE |= {k: indicator(f, 9 if k in ("s_fibonacci", "x_wy_avg") else 6) for k, f in MORE.items()}
MADE |= {k: indicator(f) for k, f in SIGNALS.items()} | {"sg_cross": indicator(cross), "sg_buffer": indicator(lambda c: cross(c, 5, 10))}
QUERIES = {k: q for k, (q, _) in MADE.items()}
ORACLE_SQL = {k: s for k, (_, s) in MADE.items()}
