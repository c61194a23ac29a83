"""The batch indicators: functions of a chain and parameters that return named output expressions.

Rows are null until an indicator is ready. A later stage sees such a row as 0 (`zero`), which is this family's rule; the
streaming family (operators/waiting.py) waits instead.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from tidebar.functions.windows import bars_since, div, filled, frame, highest, hl2, hlc3, lag, lagged_sum, lead, lowest, mean, num, pstdev, rolling, total, true_range, zero
from tidebar.plans.chain import Chain

Out = dict[str, str]
TA: dict[str, Callable[..., Out]] = {}


def ta(f: Callable[..., Out]) -> Callable[..., Out]:
    TA[f.__name__] = f
    return f


# Moving averages


@ta
def sma(c: Chain, source: str = "c", length: int = 20) -> Out:
    return {"sma": mean(c.col(source), length)}


def _ema(c: Chain, source: str, n: int) -> str:
    return c.ema(source, 2 / (n + 1), n)


def _rma(c: Chain, source: str, n: int, exact: bool = False) -> str:
    return c.ema(source, 1 / n, n, exact)


@ta
def ema(c: Chain, source: str = "c", length: int = 21) -> Out:
    return {"ema": _ema(c, source, length)}


@ta
def rma(c: Chain, source: str = "c", length: int = 14) -> Out:
    return {"rma": _rma(c, source, length)}


@ta
def smma(c: Chain, source: str = "c", length: int = 14) -> Out:
    return {"smma": _rma(c, source, length)}


def _wma(c: Chain, source: str, n: int) -> str:
    whole = n * (n + 1) / 2
    return lagged_sum(c.col(source), [(n - j) / whole for j in range(n)])


@ta
def wma(c: Chain, source: str = "c", length: int = 20) -> Out:
    return {"wma": _wma(c, source, length)}


def _emas(c: Chain, source: str, n: int, times: int) -> list[str]:
    out = [_ema(c, source, n)]
    for _ in range(times - 1):
        out.append(_ema(c, zero(out[-1]), n))
    return out


@ta
def dema(c: Chain, source: str = "c", length: int = 21) -> Out:
    a, b = _emas(c, source, length, 2)
    return {"dema": f"2e0 * {a} - {b}"}


@ta
def tema(c: Chain, source: str = "c", length: int = 21) -> Out:
    a, b, d = _emas(c, source, length, 3)
    return {"tema": f"3e0 * {a} - 3e0 * {b} + {d}"}


@ta
def t3(c: Chain, source: str = "c", length: int = 5, factor: float = 0.7) -> Out:
    e = _emas(c, source, length, 6)
    v = factor
    parts = [(-(v**3), e[5]), (3 * v**2 + 3 * v**3, e[4]), (-6 * v**2 - 3 * v - 3 * v**3, e[3]), (1 + 3 * v + v**3 + 3 * v**2, e[2])]
    return {"t3": " + ".join(f"{num(w)} * {x}" for w, x in parts)}


@ta
def trix(c: Chain, source: str = "c", length: int = 18) -> Out:
    e = _emas(c, source, length, 3)[-1]
    return {"trix": f"({e} - {lag(e)}) / nullif({lag(e)}, 0e0) * 100e0"}


@ta
def hma(c: Chain, source: str = "c", length: int = 20) -> Out:
    half, root = length // 2, int(math.sqrt(length))
    raw = c.col(zero(f"2e0 * {_wma(c, source, half)} - {_wma(c, source, length)}"))
    return {"hma": _wma(c, raw, root)}


@ta
def vwma(c: Chain, source: str = "c", length: int = 20) -> Out:
    return {"vwma": f"{total(c.col(f'{source} * v'), length)} / nullif({total('v', length)}, 0e0)"}


def _line(c: Chain, source: str, n: int) -> tuple[str, str]:
    """Slope and intercept of the last n values over 0 to n - 1."""
    x = c.col(source)
    # The weights of least squares over fixed places are constants.
    mid, var = (n - 1) / 2, (n * n - 1) / 12 * n
    slope = c.col(lagged_sum(x, [(n - 1 - j - mid) / var for j in range(n)]))
    return slope, f"({mean(x, n)} - {slope} * {num(mid)})"


@ta
def lsma(c: Chain, source: str = "c", length: int = 25) -> Out:
    slope, start = _line(c, source, length)
    return {"lsma": f"{start} + {slope} * {num(length - 1)}"}


@ta
def linreg(c: Chain, source: str = "c", length: int = 14) -> Out:
    slope, start = _line(c, source, length)
    return {"slope": slope, "intercept": start, "forecast": f"{start} + {slope} * {num(length - 1)}"}


@ta
def alma(c: Chain, source: str = "c", length: int = 9, offset: float = 0.85, sigma: float = 6.0) -> Out:
    m, s = offset * (length - 1), length / sigma
    w = [math.exp(-((k - m) ** 2) / (2 * s * s)) for k in range(length)]
    return {"alma": lagged_sum(c.col(source), [w[length - 1 - j] / sum(w) for j in range(length)])}


@ta
def zlema(c: Chain, source: str = "c", length: int = 21) -> Out:
    shift = (length - 1) // 2
    return {"zlema": _ema(c, f"case when i >= {shift} then 2e0 * {source} - {lag(source, shift)} else {source} end", length)}


@ta
def kama(c: Chain, source: str = "c", length: int = 10, fast: int = 2, slow: int = 30) -> Out:
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    step = c.col(f"abs({source} - {lag(source)})")
    ratio = c.col(f"coalesce(abs({source} - {lag(source, length)}) / nullif({total(step, length)}, 0e0), 0e0)")
    sc = c.col(f"power({ratio} * {num(f - s)} + {num(s)}, 2)")
    at = length - 1
    return {"kama": c.scan(f"case when i > {at} then 1e0 - {sc} else 0e0 end", f"case when i = {at} then {source} when i > {at} then {sc} * {source} end")}


@ta
def vidya(c: Chain, source: str = "c", length: int = 14, cmo_length: int = 9) -> Out:
    change = c.col(f"{source} - {lag(source)}")
    cmo = c.col(f"abs(coalesce({total(change, cmo_length)} / nullif({total(c.col(f'abs({change})'), cmo_length)}, 0e0), 0e0))")
    k = f"{num(2 / (length + 1))} * {cmo}"
    return {"vidya": c.scan(f"case when i > {cmo_length} then 1e0 - {k} else 0e0 end", f"case when i = {cmo_length} then {source} when i > {cmo_length} then {k} * {source} end")}


@ta
def frama(c: Chain, length: int = 16) -> Out:
    half = length // 2
    span = lambda n, skip: f"(max(h) over ({ORDER} rows between {n} preceding and {skip}) - min(l) over ({ORDER} rows between {n} preceding and {skip}))"
    n1 = c.col(f"{span(length - 1, f'{half} preceding')} / {num(half)}")
    n2 = c.col(f"{span(half - 1, 'current row')} / {num(half)}")
    n3 = c.col(f"{span(length - 1, 'current row')} / {num(length)}")
    d = f"case when {n1} > 0 and {n2} > 0 and {n3} > 0 then (ln(nullif({n1} + {n2}, 0e0)) - ln(nullif({n3}, 0e0))) / {num(math.log(2))} else 1e0 end"
    alpha = c.col(f"greatest(0.01e0, least(1e0, exp(-4.6e0 * ({d} - 1e0))))")
    at = length - 1
    return {"frama": c.scan(f"case when i > {at} then 1e0 - {alpha} else 0e0 end", f"case when i = {at} then c when i > {at} then {alpha} * c end")}


ORDER = "partition by symbol order by ts"


# Momentum


@ta
def rsi(c: Chain, source: str = "c", length: int = 14, exact: bool = False) -> Out:
    """exact: for comparisons; where the close stays as it was, so does the index but for its last bits."""
    gain = _rma(c, f"coalesce(greatest({source} - {lag(source)}, 0e0), 0e0)", length, exact)
    loss = _rma(c, f"coalesce(greatest({lag(source)} - {source}, 0e0), 0e0)", length, exact)
    return {"rsi": f"100e0 - 100e0 / (1e0 + case when {loss} = 0 then 100e0 else {gain} / nullif({loss}, 0e0) end)"}


@ta
def macd(c: Chain, source: str = "c", fast: int = 12, slow: int = 26, signal: int = 9) -> Out:
    line = c.col(f"{_ema(c, source, fast)} - {_ema(c, source, slow)}")
    sig = _ema(c, zero(line), signal)
    return {"macd": line, "signal": sig, "histogram": f"{line} - {sig}"}


def _stoch_k(c: Chain, x: str, high: str, low: str, n: int) -> str:
    return f"({x} - {lowest(low, n)}) / nullif({highest(high, n)} - {lowest(low, n)}, 0e0) * 100e0"


@ta
def stoch_k(c: Chain, length: int = 14) -> Out:
    return {"k": _stoch_k(c, "c", "h", "l", length)}


@ta
def stoch(c: Chain, k_period: int = 14, k_smooth: int = 1, d_period: int = 3) -> Out:
    raw = c.col(zero(_stoch_k(c, "c", "h", "l", k_period)))
    k = c.col(mean(raw, k_smooth))
    return {"k": k, "d": mean(c.col(zero(k)), d_period)}


@ta
def cci(c: Chain, length: int = 20) -> Out:
    tp = c.col(hlc3)
    m = c.col(mean(tp, length))
    deviation = c.col("(" + " + ".join(f"abs({tp if j == 0 else lag(tp, j)} - {m})" for j in range(length)) + f") / {num(length)}")
    return {"cci": f"({tp} - {m}) / nullif(0.015e0 * {deviation}, 0e0)"}


@ta
def woodies_cci(c: Chain, cci_length: int = 14, turbo_length: int = 6) -> Out:
    a = c.col(cci(c, cci_length)["cci"])
    return {"cci": a, "turbo": cci(c, turbo_length)["cci"], "histogram": a}


@ta
def williams_r(c: Chain, length: int = 14) -> Out:
    return {"wr": f"({highest('h', length)} - c) / nullif({highest('h', length)} - {lowest('l', length)}, 0e0) * -100e0"}


@ta
def momentum(c: Chain, source: str = "c", length: int = 10) -> Out:
    return {"mom": f"{source} - {lag(source, length)}"}


@ta
def awesome(c: Chain, fast: int = 5, slow: int = 34) -> Out:
    x = c.col(hl2)
    return {"ao": f"{mean(x, fast)} - {mean(x, slow)}"}


@ta
def tsi(c: Chain, source: str = "c", long: int = 25, short: int = 13, signal: int = 13) -> Out:
    change = c.col(f"coalesce({source} - {lag(source)}, 0e0)")
    twice = lambda x: _ema(c, zero(_ema(c, x, long)), short)
    a, b = twice(change), twice(c.col(f"abs({change})"))
    line = c.col(f"{a} / nullif({b}, 0e0) * 100e0")
    return {"tsi": line, "signal": _ema(c, zero(line), signal)}


@ta
def smi_ergodic(c: Chain, source: str = "c", long: int = 20, short: int = 5, signal: int = 5) -> Out:
    out = tsi(c, source, long, short, signal)
    return {"smi": out["tsi"], "signal": out["signal"]}


@ta
def smi_ergodic_osc(c: Chain, source: str = "c", long: int = 20, short: int = 5, signal: int = 5) -> Out:
    out = tsi(c, source, long, short, signal)
    return {"osc": f"{out['tsi']} - {out['signal']}"}


@ta
def rvi(c: Chain, length: int = 10) -> Out:
    weighted = lambda x: c.col(f"coalesce(({x} + 2e0 * {lag(x, 1)} + 2e0 * {lag(x, 2)} + {lag(x, 3)}) / 6e0, 0e0)")
    a, b = weighted(c.col("c - o")), weighted(c.col("h - l"))
    line = c.col(f"case when i >= {length + 2} then {frame(f'sum({a})', length)} / nullif({frame(f'sum({b})', length)}, 0e0) end")
    return {"rvi": line, "signal": f"({line} + 2e0 * {lag(line, 1)} + 2e0 * {lag(line, 2)} + {lag(line, 3)}) / 6e0"}


@ta
def chande_mo(c: Chain, source: str = "c", length: int = 9) -> Out:
    change = c.col(f"{source} - {lag(source)}")
    size = c.col(f"abs({change})")
    return {"cmo": f"case when i >= {length} then coalesce({total(change, length)} / nullif({total(size, length)}, 0e0) * 100e0, 0e0) end"}


def _roc(source: str, n: int) -> str:
    return f"({source} - {lag(source, n)}) / nullif({lag(source, n)}, 0e0) * 100e0"


@ta
def roc(c: Chain, source: str = "c", length: int = 9) -> Out:
    return {"roc": _roc(c.col(source), length)}


@ta
def coppock(c: Chain, source: str = "c", wma: int = 10, long_roc: int = 14, short_roc: int = 11) -> Out:
    return {"coppock": _wma(c, f"{zero(_roc(source, long_roc))} + {zero(_roc(source, short_roc))}", wma)}


@ta
def dpo(c: Chain, source: str = "c", length: int = 21) -> Out:
    m = c.col(mean(source, length))
    return {"dpo": f"{source} - {lag(m, length // 2 + 1)}"}


@ta
def price_osc(c: Chain, source: str = "c", short: int = 12, long: int = 26) -> Out:
    a, b = _ema(c, source, short), _ema(c, source, long)
    return {"po": f"case when {b} = 0 then {a} - {b} else ({a} - {b}) / nullif({b}, 0e0) * 100e0 end"}


@ta
def ultimate(c: Chain, short: int = 7, medium: int = 14, long: int = 28) -> Out:
    low = f"least(l, coalesce({lag('c')}, l))"
    bp = c.col(f"c - {low}")
    tr = c.col(f"greatest(h, coalesce({lag('c')}, h)) - {low}")
    share = lambda n: f"{total(bp, n)} / case when {total(tr, n)} > 0 then {total(tr, n)} end"
    return {"uo": filled(f"100e0 * (4e0 * {share(short)} + 2e0 * {share(medium)} + {share(long)}) / 7e0", long)}


@ta
def bop(c: Chain, smooth: int = 14) -> Out:
    raw = c.col("coalesce((c - o) / nullif(h - l, 0e0), 0e0)")
    return {"bop": mean(raw, smooth)}


@ta
def bull_bear_power(c: Chain, length: int = 13) -> Out:
    e = _ema(c, "c", length)
    return {"bull": f"h - {e}", "bear": f"l - {e}", "total": f"(h - {e}) + (l - {e})"}


@ta
def alligator(c: Chain, jaw_length: int = 13, jaw_offset: int = 8, teeth_length: int = 8, teeth_offset: int = 5, lips_length: int = 5, lips_offset: int = 3) -> Out:
    x = c.col(hl2)
    return {name: lag(_rma(c, x, n), by) for name, n, by in (("jaw", jaw_length, jaw_offset), ("teeth", teeth_length, teeth_offset), ("lips", lips_length, lips_offset))}


@ta
def stoch_rsi(c: Chain, source: str = "c", rsi_length: int = 14, stoch_length: int = 14, k_smooth: int = 3, d_smooth: int = 3) -> Out:
    r = c.col(f"coalesce({rsi(c, source, rsi_length)['rsi']}, 50e0)")
    hi, lo = frame(f"max({r})", stoch_length), frame(f"min({r})", stoch_length)
    raw = c.col(f"case when i < {stoch_length - 1} then 0e0 when {hi} = {lo} then 50e0 else ({r} - {lo}) / nullif({hi} - {lo}, 0e0) * 100e0 end")
    k = c.col(mean(raw, k_smooth))
    return {"k": k, "d": mean(c.col(zero(k)), d_smooth)}


# Volatility and channels


@ta
def tr(c: Chain) -> Out:
    return {"tr": true_range}


def _atr(c: Chain, n: int) -> str:
    return _rma(c, true_range, n)


@ta
def atr(c: Chain, length: int = 14) -> Out:
    return {"atr": _atr(c, length)}


def _bands(c: Chain, source: str, n: int, mult: float) -> tuple[str, str, str]:
    m, s = c.col(mean(source, n)), c.col(pstdev(source, n))
    return m, c.col(f"{m} + {num(mult)} * {s}"), c.col(f"{m} - {num(mult)} * {s}")


@ta
def bb(c: Chain, source: str = "c", length: int = 20, mult: float = 2.0) -> Out:
    return dict(zip(("basis", "upper", "lower"), _bands(c, source, length, mult)))


@ta
def bb_percent_b(c: Chain, source: str = "c", length: int = 20, mult: float = 2.0) -> Out:
    _, up, lo = _bands(c, source, length, mult)
    return {"percentb": f"({source} - {lo}) / nullif({up} - {lo}, 0e0)"}


@ta
def bb_bandwidth(c: Chain, source: str = "c", length: int = 20, mult: float = 2.0) -> Out:
    m, up, lo = _bands(c, source, length, mult)
    return {"bandwidth": f"({up} - {lo}) / nullif({m}, 0e0) * 100e0"}


@ta
def bbtrend(c: Chain, source: str = "c", short: int = 20, long: int = 50, mult: float = 2.0) -> Out:
    _, us, ls = _bands(c, source, short, mult)
    _, ul, ll = _bands(c, source, long, mult)
    return {"bbtrend": f"(({us} - {ls}) - ({ul} - {ll})) / nullif({ul} - {ll}, 0e0) * 100e0"}


@ta
def keltner(c: Chain, source: str = "c", length: int = 20, atr_length: int = 10, mult: float = 2.0) -> Out:
    m, a = _ema(c, source, length), _atr(c, atr_length)
    return {"upper": f"{m} + {num(mult)} * {a}", "basis": m, "lower": f"{m} - {num(mult)} * {a}"}


@ta
def donchian(c: Chain, length: int = 20) -> Out:
    return {"upper": highest("h", length), "middle": f"({highest('h', length)} + {lowest('l', length)}) / 2e0", "lower": lowest("l", length)}


@ta
def adr(c: Chain, length: int = 14) -> Out:
    return {"adr": mean(c.col("h - l"), length)}


@ta
def adr_percent(c: Chain, length: int = 14) -> Out:
    x = c.col(f"coalesce((h - l) / nullif({hl2}, 0e0) * 100e0, 0e0)")
    return {"adr_pct": filled(f"{total(x, length)} / {num(length)}", length + 1)}


@ta
def hist_vol(c: Chain, length: int = 20, annual: float = 252.0) -> Out:
    r = c.col(f"case when {lag('c')} > 0 and c > 0 then ln(c / nullif({lag('c')}, 0e0)) else 0e0 end")
    return {"hv": filled(f"{pstdev(r, length)} * {num(math.sqrt(annual) * 100)}", length + 1)}


@ta
def choppiness(c: Chain, length: int = 14) -> Out:
    t = c.col(true_range)
    span, s = c.col(f"{highest('h', length)} - {lowest('l', length)}"), c.col(total(t, length))
    return {"chop": f"case when {span} > 0 and {s} > 0 then 100e0 * ln({s} / nullif({span}, 0e0)) / {num(math.log(length))} end"}


@ta
def envelope(c: Chain, source: str = "c", length: int = 20, percent: float = 2.5) -> Out:
    m = c.col(mean(source, length))
    return {"upper": f"{m} * {num(1 + percent / 100)}", "basis": m, "lower": f"{m} * {num(1 - percent / 100)}"}


@ta
def ulcer(c: Chain, source: str = "c", length: int = 14) -> Out:
    top = c.col(highest(source, length))
    parts = " + ".join(f"power(({source if j == 0 else lag(source, j)} - {top}) / nullif({top}, 0e0) * 100e0, 2)" for j in range(length))
    return {"ulcer": f"sqrt(({parts}) / {num(length)})"}


@ta
def stdev(c: Chain, source: str = "c", length: int = 20) -> Out:
    return {"stdev": pstdev(source, length)}


@ta
def mass_index(c: Chain, length: int = 25) -> Out:
    one = c.ema("h - l", 0.2, 1)
    two = c.ema(one, 0.2, 1)
    return {"mass_index": total(c.col(f"coalesce({one} / nullif({two}, 0e0), 1e0)"), length)}


# Trend


def _dm(c: Chain, n: int) -> tuple[str, str]:
    up, down = c.col(f"h - {lag('h')}"), c.col(f"{lag('l')} - l")
    plus = _rma(c, f"case when {up} > {down} and {up} > 0 then {up} else 0e0 end", n)
    minus = _rma(c, f"case when {down} > {up} and {down} > 0 then {down} else 0e0 end", n)
    a = _atr(c, n)
    di = lambda x: c.col(f"case when {a} > 0 then {x} / nullif({a}, 0e0) * 100e0 end")
    return di(plus), di(minus)


@ta
def adx(c: Chain, di_length: int = 14, adx_smooth: int = 14) -> Out:
    plus, minus = _dm(c, di_length)
    dx = f"coalesce(abs({plus} - {minus}) / nullif({plus} + {minus}, 0e0) * 100e0, 0e0)"
    return {"adx": _rma(c, dx, adx_smooth), "plus_di": plus, "minus_di": minus}


@ta
def dmi(c: Chain, length: int = 14) -> Out:
    return dict(zip(("plus_di", "minus_di"), _dm(c, length)))


@ta
def aroon(c: Chain, length: int = 25) -> Out:
    up = c.col(f"100e0 * ({num(length)} - ({bars_since('h', length + 1, 'max')})) / {num(length)}")
    down = c.col(f"100e0 * ({num(length)} - ({bars_since('l', length + 1, 'min')})) / {num(length)}")
    return {"up": up, "down": down, "osc": f"{up} - {down}"}


@ta
def ichimoku(c: Chain, tenkan: int = 9, kijun: int = 26, senkou_b: int = 52, displacement: int = 26) -> Out:
    """chikou looks ahead: it is the close of a later bar."""
    mid = lambda n: c.col(f"({highest('h', n)} + {lowest('l', n)}) / 2e0")
    a, b, s = mid(tenkan), mid(kijun), mid(senkou_b)
    by = displacement - 1
    both = c.col(f"({a} + {b}) / 2e0")
    return {"tenkan": a, "kijun": b, "senkou_a": lag(both, by), "senkou_b": lag(s, by), "chikou": lead("c", by)}


@ta
def vortex(c: Chain, length: int = 14) -> Out:
    plus, minus = c.col(f"abs(h - {lag('l')})"), c.col(f"abs(l - {lag('h')})")
    t = c.col(f"case when i > 0 then {true_range} end")
    return {"vi_plus": f"{total(plus, length)} / nullif({total(t, length)}, 0e0)", "vi_minus": f"{total(minus, length)} / nullif({total(t, length)}, 0e0)"}


@ta
def trend_strength(c: Chain, length: int = 14) -> Out:
    change = c.col(f"c - {lag('c')}")
    return {"strength": f"case when i >= {length} then coalesce({total(change, length)} / nullif({total(c.col(f'abs({change})'), length)}, 0e0) * 100e0, 0e0) end"}


@ta
def chande_kroll(c: Chain, p: int = 10, q: int = 9, x: float = 1.0) -> Out:
    a = _atr(c, p)
    first_high = c.col(f"case when i < {p - 1} then h else {highest('h', p)} - {num(x)} * {zero(a)} end")
    first_low = c.col(f"case when i < {p - 1} then l else {lowest('l', p)} + {num(x)} * {zero(a)} end")
    return {"stop_long": highest(first_high, q), "stop_short": lowest(first_low, q)}


@ta
def ma_cross(c: Chain, source: str = "c", fast: int = 9, slow: int = 21) -> Out:
    return {"fast": _ema(c, source, fast), "slow": _ema(c, source, slow)}


@ta
def ma_ribbon(c: Chain, source: str = "c", start: int = 8, increment: int = 5, count: int = 8) -> Out:
    return {f"ma{k + 1}": _ema(c, source, start + k * increment) for k in range(count)}


# Volume


def _direction(c: Chain) -> str:
    return f"sign(coalesce(c - {lag('c')}, 0e0))"


@ta
def obv(c: Chain) -> Out:
    return {"obv": c.cum("sum", c.col(f"{_direction(c)} * v"))}


def _flow(c: Chain) -> str:
    return c.col("coalesce(((c - l) - (h - c)) / nullif(h - l, 0e0), 0e0) * v")


@ta
def ad_line(c: Chain) -> Out:
    return {"ad": c.cum("sum", _flow(c))}


@ta
def cmf(c: Chain, length: int = 20) -> Out:
    return {"cmf": f"{total(_flow(c), length)} / nullif({total('v', length)}, 0e0)"}


@ta
def chaikin_osc(c: Chain, fast: int = 3, slow: int = 10) -> Out:
    line = c.cum("sum", _flow(c))
    return {"co": f"{_ema(c, line, fast)} - {_ema(c, line, slow)}"}


@ta
def mfi(c: Chain, length: int = 14) -> Out:
    tp = c.col(hlc3)
    plus = c.col(f"case when {tp} > {lag(tp)} then {tp} * v when i > 0 then 0e0 end")
    minus = c.col(f"case when {tp} < {lag(tp)} then {tp} * v when i > 0 then 0e0 end")
    a, b = c.col(total(plus, length)), c.col(total(minus, length))
    return {"mfi": f"case when {b} = 0 then case when {a} = 0 then 50e0 else 100e0 end else 100e0 - 100e0 / (1e0 + {a} / nullif({b}, 0e0)) end"}


@ta
def pvt(c: Chain) -> Out:
    x = c.col(f"coalesce((c - {lag('c')}) / nullif({lag('c')}, 0e0) * v, 0e0)")
    return {"pvt": c.cum("sum", x)}


@ta
def vol_osc(c: Chain, short: int = 5, long: int = 10) -> Out:
    return {"vo": f"({mean('v', short)} - {mean('v', long)}) / nullif({mean('v', long)}, 0e0) * 100e0"}


@ta
def klinger(c: Chain, fast: int = 34, slow: int = 55, signal: int = 13) -> Out:
    tp = c.col(hlc3)
    x = c.col(f"case when {tp} < {lag(tp)} then -v else v end")
    line = c.col(f"{_ema(c, x, fast)} - {_ema(c, x, slow)}")
    return {"kvo": line, "signal": _ema(c, zero(line), signal)}


@ta
def net_volume(c: Chain) -> Out:
    return {"net": f"{_direction(c)} * v"}


@ta
def volume_delta(c: Chain) -> Out:
    return {"delta": "case when h > l then v * (2e0 * (c - l) / nullif(h - l, 0e0) - 1e0) else 0e0 end"}


@ta
def cvd(c: Chain) -> Out:
    return {"cvd": c.cum("sum", c.col(volume_delta(c)["delta"]))}


@ta
def elder_force(c: Chain, length: int = 13) -> Out:
    return {"efi": _ema(c, f"coalesce((c - {lag('c')}) * v, 0e0)", length)}


@ta
def eom(c: Chain, length: int = 14) -> Out:
    x = c.col(f"coalesce(({hl2} - ({lag('h')} + {lag('l')}) / 2e0) / nullif(v / 10000e0 / greatest(h - l, 0.0001e0), 0e0), 0e0)")
    return {"eom": mean(x, length)}


@ta
def rel_volume(c: Chain, periods: int = 5, length: int = 24) -> Out:
    parts = " + ".join(lag("v", p * length) for p in range(1, periods + 1))
    return {"rel_volume": f"v / nullif(({parts}) / {num(periods)}, 0e0)"}


def _compounded(c: Chain, cond: str) -> str:
    return c.scan(f"coalesce(case when {cond} then 1e0 + (c - {lag('c')}) / nullif({lag('c')}, 0e0) end, 1e0)", "case when i = 0 then 1000e0 else 0e0 end")


@ta
def nvi(c: Chain) -> Out:
    return {"nvi": _compounded(c, f"v < {lag('v')}"), "pvi": _compounded(c, f"v > {lag('v')}")}


@ta
def vwap(c: Chain) -> Out:
    tp = c.col(hlc3)
    return {"vwap": f"coalesce({c.cum('sum', f'{tp} * v')} / nullif({c.cum('sum', 'v')}, 0e0), {tp})"}


# Statistics


@ta
def extremes(c: Chain, source: str = "c", length: int = 14) -> Out:
    return {"highest": highest(source, length), "lowest": lowest(source, length)}


@ta
def extreme_bars(c: Chain, length: int = 14) -> Out:
    return {"highest_bars": bars_since("h", length, "max"), "lowest_bars": bars_since("l", length, "min")}


@ta
def rolling_sum(c: Chain, source: str = "c", length: int = 14) -> Out:
    return {"sum": total(source, length)}


def _both(c: Chain, x: str, y: str, n: int) -> tuple[str, str, str]:
    mx, my, mxy = mean(x, n), mean(y, n), mean(c.col(f"{x} * {y}"), n)
    return c.col(f"{mxy} - {mx} * {my}"), c.col(pstdev(x, n)), c.col(pstdev(y, n))


@ta
def correlation(c: Chain, x: str = "c", y: str = "v", length: int = 20) -> Out:
    cov, a, b = _both(c, x, y, length)
    return {"correlation": f"{cov} / nullif({a} * {b}, 0e0)"}


@ta
def covariance(c: Chain, x: str = "c", y: str = "v", length: int = 20) -> Out:
    return {"covariance": _both(c, x, y, length)[0]}


@ta
def pct_rank(c: Chain, source: str = "c", length: int = 14) -> Out:
    below = " + ".join(f"case when {lag(source, j)} < {source} then 1e0 else 0e0 end" for j in range(1, length))
    return {"pct_rank": filled(f"({below}) / {num(length)} * 100e0", length)}


@ta
def cross(c: Chain, fast: int = 9, slow: int = 21) -> Out:
    a, b = c.col(mean("c", fast)), c.col(mean("c", slow))
    pa, pb = c.col(lag(a)), c.col(lag(b))
    up, down = f"coalesce({a} > {b} and {pa} <= {pb}, false)", f"coalesce({a} < {b} and {pa} >= {pb}, false)"
    return {"over": up, "under": down, "either": f"{up} or {down}"}


@ta
def bars_since_cross(c: Chain, fast: int = 9, slow: int = 21) -> Out:
    up = c.col(cross(c, fast, slow)["over"])
    return {"bars_since": f"i - {c.cum('max', f'case when {up} then i end')}"}
