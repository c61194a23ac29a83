"""The streaming family in batch form: a stage that isn't ready gives nothing and later stages wait for it.

Names are shared with operators/ta.py, results are not: warm-up, flat ranges and seeds differ. As an incremental query the
same definitions run on final bars only.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from tidebar.functions.windows import cumulative, frame, highest, hl2, hlc3, lag, lowest, mean, num, pstdev, total, true_range
from tidebar.operators.ta import Out, _atr, _ema, _rma, _wma, alma, bull_bear_power, sma, vwma
from tidebar.operators.ta import donchian as channel
from tidebar.operators.ta import obv as on_balance
from tidebar.plans.chain import W_SQL, Chain

WAITING: dict[str, Callable[..., Out]] = {"sma": sma, "vwma": vwma, "alma": alma}


def waiting(f: Callable[..., Out]) -> Callable[..., Out]:
    WAITING[f.__name__] = f
    return f


def test(condition: str) -> str:
    """A condition on a bar's outputs; false before they are ready."""
    return f"coalesce({condition}, false)"


@waiting
def ema(c: Chain, source: str = "c", length: int = 21, multiplier: float | None = None) -> Out:
    """By default with the usual multiplier, 2 / (length + 1)."""
    k = 2 / (length + 1) if multiplier is None else multiplier
    return {"ema": c.ema(source, k, length)}


@waiting
def donchian(c: Chain, length: int = 20) -> Out:
    out = channel(c, length)
    up, lo = c.col(out["upper"]), c.col(out["lower"])
    return out | {"width": f"{up} - {lo}", "is_at_upper": test(f"c = {up}"), "is_at_lower": test(f"c = {lo}")}


@waiting
def obv(c: Chain, bars: int = 3) -> Out:
    """Rising or falling: at each of the last bars."""
    line = c.col(on_balance(c)["obv"])
    steps = lambda sign: test(" and ".join(f"{line if j == 0 else lag(line, j)} {sign} {lag(line, j + 1)}" for j in range(bars - 1)))
    return {"obv": line, "is_rising": steps(">"), "is_falling": steps("<")}


@waiting
def dema(c: Chain, length: int = 21) -> Out:
    a = _ema(c, "c", length)
    b = _ema(c, a, length)
    d = _ema(c, b, length)
    return {"dema": f"2e0 * {a} - {b}", "tema": f"3e0 * {a} - 3e0 * {b} + {d}"}


@waiting
def macd(c: Chain, fast: int = 12, slow: int = 26, signal: int = 9) -> Out:
    line = c.col(f"{_ema(c, 'c', fast)} - {_ema(c, 'c', slow)}")
    s = _ema(c, line, signal)
    ready = lambda x: f"case when {s} is not null then {x} end"
    return {"macd": ready(line), "signal": s, "histogram": f"{line} - {s}", "is_bullish": test(f"{line} > {s}"), "is_bearish": test(f"{line} < {s}")}


@waiting
def adx(c: Chain, length: int = 14) -> Out:
    up, down = c.col(f"h - {lag('h')}"), c.col(f"{lag('l')} - l")
    a = _rma(c, f"case when i > 0 then {true_range} end", length)
    plus = _rma(c, f"case when i > 0 then case when {up} > {down} and {up} > 0 then {up} else 0e0 end end", length)
    minus = _rma(c, f"case when i > 0 then case when {down} > {up} and {down} > 0 then {down} else 0e0 end end", length)
    di = lambda x: c.col(f"case when {a} is not null then coalesce(100e0 * {x} / nullif({a}, 0e0), 0e0) end")
    p, m = di(plus), di(minus)
    x = _rma(c, f"case when {p} is not null then coalesce(100e0 * abs({p} - {m}) / nullif({p} + {m}, 0e0), 0e0) end", length)
    ready = lambda e: f"case when {x} is not null then {e} end"
    return {"adx": x, "plus_di": ready(p), "minus_di": ready(m), "is_strong_trend": test(f"{x} > 25"), "is_bullish": test(ready(f"{p} > {m}")), "is_bearish": test(ready(f"{m} > {p}"))}


@waiting
def aroon(c: Chain, length: int = 25) -> Out:
    """Of equal extremes the one of the highest bar number modulo the length counts, as in a ring buffer."""

    def share(x: str, best: str) -> str:
        extreme = frame(f"{best}({x})", length)
        slots = ", ".join(f"case when {x if j == 0 else lag(x, j)} = {extreme} then (i - {j}) % {length} end" for j in range(length))
        since = c.col(f"case when i >= {length - 1} then (i - greatest({slots}) + {length}) % {length} end")
        return c.col(f"({num(length)} - {since}) / {num(length)} * 100e0")

    up, down = share("h", "max"), share("l", "min")
    strong = lambda a, b: test(f"{a} > 70 and {b} < 30")
    return {"up": up, "down": down, "osc": f"{up} - {down}", "is_bullish": test(f"{up} > {down}"), "is_bearish": test(f"{down} > {up}"), "is_strong_uptrend": strong(up, down), "is_strong_downtrend": strong(down, up)}


@waiting
def keltner(c: Chain, length: int = 20, mult: float = 2.0) -> Out:
    m, a = _ema(c, "c", length), _atr(c, length)
    up, lo = c.col(f"{m} + {num(mult)} * {a}"), c.col(f"{m} - {num(mult)} * {a}")
    share = f"case when {up} > {lo} then (c - {lo}) / nullif({up} - {lo}, 0e0) when {up} is not null then 0.5e0 end"
    return {"upper": up, "middle": m, "lower": lo, "percent_b": share, "is_above_upper": test(f"c > {up}"), "is_below_lower": test(f"c < {lo}")}


@waiting
def ichimoku(c: Chain, tenkan: int = 9, kijun: int = 26, senkou_b: int = 52) -> Out:
    mid = lambda n: c.col(f"case when i >= {senkou_b - 1} then ({highest('h', n)} + {lowest('l', n)}) / 2e0 end")
    a, b, s = mid(tenkan), mid(kijun), mid(senkou_b)
    lead = c.col(f"({a} + {b}) / 2e0")
    top, bottom = f"greatest({lead}, {s})", f"least({lead}, {s})"
    ready = f"{s} is not null"
    return {
        "tenkan": a, "kijun": b, "senkou_a": lead, "senkou_b": s, "chikou": f"case when i >= {senkou_b - 1} then {lag('c', kijun - 1)} end", "cloud_thickness": f"abs({lead} - {s})",
        "is_bullish": test(f"{ready} and c > {top}"), "is_bearish": test(f"{ready} and c < {bottom}"), "is_in_cloud": test(f"{ready} and c between {bottom} and {top}"), "is_tenkan_above_kijun": test(f"{a} > {b}"), "is_cloud_bullish": test(f"{lead} > {s}"),
    }


@waiting
def hma(c: Chain, length: int = 20) -> Out:
    """Weights in order of time."""
    raw = c.col(f"2e0 * {_wma(c, 'c', length // 2)} - {_wma(c, 'c', length)}")
    return {"hma": _wma(c, raw, round(math.sqrt(length)))}


@waiting
def zlema(c: Chain, length: int = 21) -> Out:
    by = (length - 1) // 2
    return {"zlema": _ema(c, f"case when i > {by} then 2e0 * c - {lag('c', by)} else c end", length)}


@waiting
def rsi(c: Chain, length: int = 14) -> Out:
    gain = _rma(c, f"case when i > 0 then greatest(c - {lag('c')}, 0e0) end", length)
    loss = _rma(c, f"case when i > 0 then greatest({lag('c')} - c, 0e0) end", length)
    value = c.col(f"case when {loss} < 2.3e-16 then 100e0 when {gain} < 2.3e-16 then 0e0 else 100e0 - 100e0 / (1e0 + {gain} / nullif({loss}, 0e0)) end")
    return {"rsi": value, "is_overbought": test(f"{value} > 70"), "is_oversold": test(f"{value} < 30"), "is_neutral": test(f"{value} >= 30 and {value} <= 70")}


@waiting
def stochastic(c: Chain, k_period: int = 14, slow: int = 3, d_period: int = 3) -> Out:
    hi, lo = highest("h", k_period), lowest("l", k_period)
    raw = c.col(f"case when i >= {k_period - 1} then coalesce((c - {lo}) / nullif({hi} - {lo}, 0e0) * 100e0, 50e0) end")
    k = c.col(mean(raw, slow))
    d = c.col(mean(k, d_period))
    k = c.col(f"case when {d} is not null then {k} end")
    crossed = lambda before, after: test(f"{lag(k)} {before} {lag(d)} and {k} {after} {d}")
    return {"k": k, "d": d, "is_overbought": test(f"{k} > 80"), "is_oversold": test(f"{k} < 20"), "is_bullish_crossover": crossed("<=", ">"), "is_bearish_crossover": crossed(">=", "<")}


@waiting
def cci(c: Chain, length: int = 20) -> Out:
    tp = c.col(hlc3)
    m = c.col(mean(tp, length))
    deviation = c.col("(" + " + ".join(f"abs({tp if j == 0 else lag(tp, j)} - {m})" for j in range(length)) + f") / {num(length)}")
    return {"cci": f"case when {m} is not null then coalesce(({tp} - {m}) / nullif(0.015e0 * {deviation}, 0e0), 0e0) end"}


@waiting
def cmo(c: Chain, length: int = 14) -> Out:
    change = c.col(f"c - {lag('c')}")
    size = c.col(f"abs({change})")
    return {"cmo": f"case when i >= {length} then coalesce(100e0 * {total(change, length)} / nullif({total(size, length)}, 0e0), 0e0) end"}


@waiting
def dpo(c: Chain, length: int = 20) -> Out:
    """The price of n/2 + 1 bars ago less the current mean."""
    return {"dpo": f"{lag('c', length // 2 + 1)} - {mean('c', length)}"}


@waiting
def elder_ray(c: Chain, length: int = 13) -> Out:
    out = bull_bear_power(c, length)
    bull, bear = c.col(out["bull"]), c.col(out["bear"])
    both = lambda sign, a="0e0", b="0e0": test(f"{bull} {sign} {a} and {bear} {sign} {b}")
    return {"bull": bull, "bear": bear, "ema": _ema(c, "c", length), "is_bullish": both(">"), "is_bearish": both("<"), "is_strong_bullish": both(">", lag(bull), lag(bear)), "is_strong_bearish": both("<", lag(bull), lag(bear))}


@waiting
def fisher(c: Chain, length: int = 10) -> Out:
    x = c.col(hl2)
    hi, lo = frame(f"max({x})", length), frame(f"min({x})", length)
    norm = f"greatest(-0.999e0, least(0.999e0, coalesce(({x} - {lo}) / nullif({hi} - {lo}, 0e0) * 2e0 - 1e0, 0e0)))"
    value = c.scan(num(2 / 3), f"case when i > 0 then {norm} / 3e0 end")
    raw = f"0.5e0 * ln((1e0 + {value}) / nullif(1e0 - {value}, 0e0))"
    # f = raw/2 + f1/4 + f2/4 is two recurrences of one term, by the roots of z*z = (z + 1)/4.
    root = math.sqrt(1 / 64 + 1 / 4)
    one = c.scan(num(1 / 8 + root), f"0.5e0 * {raw}")
    two = c.scan(num(1 / 8 - root), one)
    signal = c.col(f"case when i > 0 then coalesce({lag(two)}, 0e0) end")
    return {"fisher": two, "signal": signal, "is_bullish_cross": test(f"{two} > {signal} and {two} > 0"), "is_bearish_cross": test(f"{two} < {signal} and {two} < 0")}


@waiting
def kst(c: Chain, roc: tuple = (10, 15, 20, 30), smooth: tuple = (10, 10, 10, 15), signal: int = 9) -> Out:
    parts = []
    for n, m in zip(roc, smooth):
        change = c.col(f"case when i >= {n} then coalesce((c - {lag('c', n)}) / nullif({lag('c', n)}, 0e0) * 100e0, 0e0) end")
        parts.append(mean(change, m))
    line = c.col(" + ".join(f"{num(k)} * {p}" for k, p in enumerate(parts, 1)))
    s = c.col(mean(line, signal))
    return {"kst": f"case when {s} is not null then {line} end", "signal": s, "is_bullish": test(f"{line} > {s}")}


@waiting
def mfi(c: Chain, length: int = 14) -> Out:
    tp = c.col(hlc3)
    plus = c.col(f"case when i > 0 then case when {tp} > {lag(tp)} then {tp} * v else 0e0 end end")
    minus = c.col(f"case when i > 0 then case when {tp} < {lag(tp)} then {tp} * v else 0e0 end end")
    a, b = c.col(total(plus, length)), c.col(total(minus, length))
    value = c.col(f"case when {b} < 2.3e-16 then 100e0 else 100e0 - 100e0 / (1e0 + {a} / nullif({b}, 0e0)) end")
    return {"mfi": value, "is_overbought": test(f"{value} > 80"), "is_oversold": test(f"{value} < 20")}


@waiting
def sortino(c: Chain, length: int = 20, rate: float = 0.02, periods: float = 252.0) -> Out:
    r, rf = c.col(f"(c - {lag('c')}) / nullif({lag('c')}, 0e0)"), rate / periods
    low = c.col(f"case when {r} < {num(rf)} then ({r} - {num(rf)}) * ({r} - {num(rf)}) end")
    m = c.col(frame(f"avg({r})", length))
    deviation = c.col(f"coalesce(sqrt({frame(f'avg({low})', length)}), 1e-10)")
    ready = lambda x: f"case when i > 0 then {x} end"
    return {"sortino": ready(f"({m} - {num(rf)}) / {deviation} * {num(math.sqrt(periods))}"), "avg_return": ready(f"{m} * {num(periods)}"), "downside": ready(f"{deviation} * {num(math.sqrt(periods))}")}


@waiting
def trix(c: Chain, length: int = 15) -> Out:
    e = _ema(c, _ema(c, _ema(c, "c", length), length), length)
    return {"trix": f"100e0 * ({e} - {lag(e)}) / nullif({lag(e)}, 0e0)"}


@waiting
def ultimate(c: Chain, short: int = 7, medium: int = 14, long: int = 28) -> Out:
    tr = c.col(f"case when i > 0 then {true_range} end")
    bp = c.col(f"c - least(l, {lag('c')}) + 0e0 * {lag('c')}")
    share = lambda n: f"coalesce({total(bp, n)} / nullif({total(tr, n)}, 0e0), 0e0)"
    return {"uo": f"case when i >= {long} then 100e0 * (4e0 * {share(short)} + 2e0 * {share(medium)} + {share(long)}) / 7e0 end"}


@waiting
def williams_r(c: Chain, length: int = 14) -> Out:
    hi, lo = highest("h", length), lowest("l", length)
    return {"wr": f"case when i >= {length - 1} then coalesce(({hi} - c) / nullif({hi} - {lo}, 0e0) * -100e0, -50e0) end"}


@waiting
def awesome(c: Chain, fast: int = 5, slow: int = 34) -> Out:
    x = c.col(hl2)
    return {"ao": f"{mean(x, fast)} - {mean(x, slow)}"}


@waiting
def atr(c: Chain, length: int = 14) -> Out:
    return {"atr": _atr(c, length), "true_range": c.col(true_range)}


@waiting
def bollinger(c: Chain, length: int = 20, mult: float = 2.0, squeeze: float = 0.5) -> Out:
    m, s = c.col(mean("c", length)), c.col(pstdev("c", length))
    up, lo = c.col(f"{m} + {num(mult)} * {s}"), c.col(f"{m} - {num(mult)} * {s}")
    width = c.col(f"({up} - {lo}) / nullif({m}, 0e0)")
    return {"upper": up, "middle": m, "lower": lo, "bandwidth": width, "percent_b": f"(c - {lo}) / nullif({up} - {lo}, 0e0)", "is_above_upper": test(f"c > {up}"), "is_below_lower": test(f"c < {lo}"), "is_squeeze": test(f"{width} < {num(squeeze)}")}


@waiting
def chandelier(c: Chain, length: int = 22, mult: float = 3.0) -> Out:
    a = _atr(c, length)
    return {"long_exit": f"{highest('h', length)} - {num(mult)} * {a}", "short_exit": f"{lowest('l', length)} + {num(mult)} * {a}"}


@waiting
def hist_vol(c: Chain, length: int = 20, periods: float = 252.0) -> Out:
    r = c.col(f"case when c > 0 and {lag('c')} > 0 then ln(c / nullif({lag('c')}, 0e0)) end")
    return {"hv": f"case when i >= 2 then {frame(f'stddev_pop({r})', length)} * {num(math.sqrt(periods) * 100)} end"}


def _flow(c: Chain) -> str:
    return c.col("coalesce(((c - l) - (h - c)) / nullif(h - l, 0e0), 0e0) * v")


@waiting
def ad_line(c: Chain) -> Out:
    return {"ad": c.cum("sum", _flow(c))}


@waiting
def chaikin_osc(c: Chain, fast: int = 3, slow: int = 10) -> Out:
    line = c.cum("sum", _flow(c))
    return {"co": f"{_ema(c, line, fast)} - {_ema(c, line, slow)}"}


@waiting
def cmf(c: Chain, length: int = 20) -> Out:
    return {"cmf": f"case when i >= {length - 1} then coalesce({total(_flow(c), length)} / nullif({total('v', length)}, 0e0), 0e0) end"}


@waiting
def eom(c: Chain, length: int = 14, scale: float = 1e6) -> Out:
    move = f"({hl2} - ({lag('h')} + {lag('l')}) / 2e0)"
    x = c.col(f"case when i > 0 then coalesce({move} / nullif((v / {num(scale)}) / nullif(h - l, 0e0), 0e0), 0e0) end")
    return {"eom": mean(x, length)}


@waiting
def force_index(c: Chain, length: int = 13) -> Out:
    raw = c.col(f"(c - {lag('c')}) * v")
    return {"fi": _ema(c, raw, length), "raw": raw}


@waiting
def klinger(c: Chain, fast: int = 34, slow: int = 55, signal: int = 13) -> Out:
    """The slow stage is only fed once the fast one is ready."""
    tp = c.col(hlc3)
    sign = c.col(f"nullif(sign({tp} - {lag(tp)}), 0e0)")
    group = c.col(f"count({sign}) over ({W_SQL} rows between unbounded preceding and current row)")
    trend = c.col(f"coalesce(max({sign}) over (partition by symbol, {group}), TREND)".replace("TREND", "1e0"))
    x = c.col(f"{_flow(c)} * {trend}")
    f = _ema(c, x, fast)
    s = _ema(c, f"case when {f} is not null then {x} end", slow)
    line = c.col(f"{f} - {s}")
    sig = _ema(c, line, signal)
    return {"kvo": f"case when {sig} is not null then {line} end", "signal": sig, "histogram": f"{line} - {sig}"}


@waiting
def volume_osc(c: Chain, short: int = 5, long: int = 10) -> Out:
    return {"vo": f"case when i >= {long - 1} then coalesce(({mean('v', short)} - {mean('v', long)}) / nullif({mean('v', long)}, 0e0) * 100e0, 0e0) end"}


@waiting
def vwap(c: Chain) -> Out:
    volume = c.cum("sum", "v")
    line = c.col(f"{c.cum('sum', f'{c.col(hlc3)} * v')} / nullif({volume}, 0e0)")
    return {"vwap": line, "cumulative_volume": volume, "periods": "i + 1", "is_above": test(f"c > {line}"), "is_below": test(f"c < {line}")}


@waiting
def supertrend(c: Chain, length: int = 10, mult: float = 3.0) -> Out:
    """+1 is up. Bands start with the first range and are carried while price stays inside."""
    a = _atr(c, length)
    up, low = c.col(f"{hl2} + {num(mult)} * {a}"), c.col(f"{hl2} - {num(mult)} * {a}")
    back = c.col(lag("c"))

    def step(fu, fl, way, u, l, close, last):  # noqa: E741
        if u is None:
            return None, None, None
        if fu is None:
            return u, l, -1.0 if close <= l else 1.0
        upper = u if u < fu or last > fu else fu
        lower = l if l > fl or last < fl else fl
        return upper, lower, (-1.0 if close <= lower else 1.0) if way > 0 else (1.0 if close >= upper else -1.0)

    fu = "(case when r.fu is null or t.in0 < r.fu or t.in3 > r.fu then t.in0 else r.fu end)"
    fl = "(case when r.fl is null or t.in1 > r.fl or t.in3 < r.fl then t.in1 else r.fl end)"
    way = f"case when t.in0 is null then null when r.way is null then case when t.in2 <= t.in1 then -1e0 else 1e0 end when r.way > 0 then case when t.in2 <= {fl} then -1e0 else 1e0 end else case when t.in2 >= {fu} then 1e0 else -1e0 end end"
    first = lambda u, l, close, last: step(None, None, None, u, l, close, last)  # noqa: E731, E741
    u, l, w = c.fold([up, low, "c", back], ["fu", "fl", "way"], first, step, ["t.in0", "t.in1", "null::double"], [fu, fl, way])  # noqa: E741
    return {"supertrend": f"case when {w} > 0 then {l} else {u} end", "trend": w, "upper": u, "lower": l, "is_uptrend": test(f"{w} > 0"), "is_downtrend": test(f"{w} < 0")}


@waiting
def psar(c: Chain, start: float = 0.02, increment: float = 0.02, maximum: float = 0.2) -> Out:
    """Direction from the first two bars; only the bar before limits the next value."""
    low1, high1 = c.col(lag("l")), c.col(lag("h"))

    def step(sar, ep, af, up, high, low, close, floor, roof):
        if sar is None:
            rise = close > (roof + floor) / 2
            return (floor, high, start, 1.0) if rise else (roof, low, start, 0.0)
        sar = sar + af * (ep - sar)
        if up:
            sar = min(sar, floor)
            if low < sar:
                return ep, low, start, 0.0
            return (sar, high, min(af + increment, maximum), up) if high > ep else (sar, ep, af, up)
        sar = max(sar, roof)
        if high > sar:
            return ep, high, start, 1.0
        return (sar, low, min(af + increment, maximum), up) if low < ep else (sar, ep, af, up)

    rise = "t.in2 > (t.in4 + t.in3) / 2e0"
    sar = "(case when r.up = 1 then least(r.sar + r.af * (r.ep - r.sar), t.in3) else greatest(r.sar + r.af * (r.ep - r.sar), t.in4) end)"
    turn = f"(case when r.up = 1 then t.in1 < {sar} else t.in0 > {sar} end)"
    more = "(case when r.up = 1 then t.in0 > r.ep else t.in1 < r.ep end)"
    begin = lambda a, b, rest: f"case when r.sar is null then case when {rise} then {a} else {b} end else {rest} end"
    sql = [
        begin("t.in3", "t.in4", f"case when {turn} then r.ep else {sar} end"),
        begin("t.in0", "t.in1", f"case when {turn} then case when r.up = 1 then t.in1 else t.in0 end when {more} then case when r.up = 1 then t.in0 else t.in1 end else r.ep end"),
        begin(num(start), num(start), f"case when {turn} then {num(start)} when {more} then least(r.af + {num(increment)}, {num(maximum)}) else r.af end"),
        begin("1e0", "0e0", f"case when {turn} then 1e0 - r.up else r.up end"),
    ]
    none = ["null::double"] * 4
    out = c.fold(["h", "l", "c", low1, high1], ["sar", "ep", "af", "up"], lambda *_: (None, None, None, None), step, none, sql)
    return {"sar": out[0], "is_uptrend": test(f"{out[3]} = 1")}
