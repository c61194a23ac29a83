"""Indicators, signals and events against plain loops that are written from their definitions, not from the library's expressions.

`at(i)` functions give the value of bar i from the bars up to it, or None before it is ready.
"""

import math
import random
from datetime import datetime, timedelta
from statistics import fmean, pstdev

import pytest

from tests.test_indicators import close, loop_ema, series
from tidebar.operators.order import MORE
from tidebar.operators.patterns import SIGNALS
from tidebar.operators.ta import TA
from tidebar.operators.waiting import WAITING
from tidebar.plans.chain import Chain

BARS = series("walk", 170, 5)
O, H, L, C, V = (list(x) for x in zip(*BARS))
N = len(BARS)
TP = [(h + l + c) / 3 for h, l, c in zip(H, L, C)]  # noqa: E741
MID = [(h + l) / 2 for h, l in zip(H, L)]  # noqa: E741
TR = [H[i] - L[i] if not i else max(H[i] - L[i], abs(H[i] - C[i - 1]), abs(L[i] - C[i - 1])) for i in range(N)]


@pytest.fixture(scope="module")
def bars(spark):
    start = datetime(2024, 1, 1)
    rows = [("a", start + timedelta(hours=i), *x) for i, x in enumerate(BARS)]
    random.Random(0).shuffle(rows)
    return spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double").cache()


def got(bars, make, **params):
    chain = Chain()
    chain.out = make(chain, **params)
    rows = chain.apply(bars).orderBy("ts").collect()
    return {n: [r[n] for r in rows] for n in chain.out}


def window(xs, i, n):
    """The last n values up to i, or None if one is missing."""
    some = xs[i - n + 1 : i + 1] if i >= n - 1 else []
    return some if len(some) == n and None not in some else None


def over(f, xs, n):
    return [None if (w := window(xs, i, n)) is None else f(w) for i in range(N)]


def later(f, xs, *more):
    """f of a series that begins late, over its own values, put back where they are."""
    first = next((i for i, x in enumerate(xs) if x is not None), N)
    return [None] * first + f(xs[first:], *more)


def ema(xs, n):
    return later(lambda some: loop_ema(some, n), xs)


def rma(xs, n):
    return later(lambda some: loop_ema(some, n, 1 / n), xs)


def wma(xs, n):
    return over(lambda w: sum((k + 1) * x for k, x in enumerate(w)) / (n * (n + 1) / 2), xs, n)


def zip_with(f, *series):
    return [None if None in row else f(*row) for row in zip(*series)]


def back(xs, n):
    return [None] * n + xs[: N - n]


CHANGE = [None] + [b - a for a, b in zip(C, C[1:])]
GAIN, LOSS = [x if x is None else max(x, 0) for x in CHANGE], [x if x is None else max(-x, 0) for x in CHANGE]
UP = [None] + [H[i] - H[i - 1] for i in range(1, N)]
DOWN = [None] + [L[i - 1] - L[i] for i in range(1, N)]
PLUS = [None if u is None else u if u > d and u > 0 else 0.0 for u, d in zip(UP, DOWN)]
MINUS = [None if u is None else d if d > u and d > 0 else 0.0 for u, d in zip(UP, DOWN)]
FLOW = [((c - l) - (h - c)) / (h - l) * v for h, l, c, v in zip(H, L, C, V)]  # noqa: E741
RSI = zip_with(lambda g, s: 100 - 100 / (1 + g / s), rma(GAIN, 14), rma(LOSS, 14))
HH, LL = (lambda n: over(max, H, n)), (lambda n: over(min, L, n))


def running(xs):
    out, s = [], 0.0
    for x in xs:
        s += x
        out.append(s)
    return out


def adx(n=14):
    a = rma([None, *TR[1:]], n)
    p, m = (zip_with(lambda x, t: 100 * x / t, rma(s, n), a) for s in (PLUS, MINUS))
    x = rma(zip_with(lambda u, d: 100 * abs(u - d) / (u + d), p, m), n)
    ready = lambda s: [y if z is not None else None for y, z in zip(s, x)]
    return {"adx": x, "plus_di": ready(p), "minus_di": ready(m)}


def stochastic():
    raw = zip_with(lambda c, h, l: (c - l) / (h - l) * 100, C, HH(14), LL(14))  # noqa: E741
    k = over(fmean, raw, 3)
    d = over(fmean, k, 3)
    return {"k": [x if y is not None else None for x, y in zip(k, d)], "d": d}


def ultimate():
    bp = [None] + [C[i] - min(L[i], C[i - 1]) for i in range(1, N)]
    share = lambda n: zip_with(lambda a, b: a / b, over(sum, bp, n), over(sum, [None, *TR[1:]], n))
    return {"uo": zip_with(lambda a, b, c: 100 * (4 * a + 2 * b + c) / 7, share(7), share(14), share(28))}


def mfi(n=14):
    up = [None] + [TP[i] * V[i] if TP[i] > TP[i - 1] else 0.0 for i in range(1, N)]
    down = [None] + [TP[i] * V[i] if TP[i] < TP[i - 1] else 0.0 for i in range(1, N)]
    return {"mfi": zip_with(lambda a, b: 100 - 100 / (1 + a / b), over(sum, up, n), over(sum, down, n))}


def obv():
    s, out = 0.0, []
    for i in range(N):
        s += V[i] * ((C[i] > C[i - 1]) - (C[i] < C[i - 1])) if i else 0.0
        out.append(s)
    return {"obv": out, "is_rising": [i >= 2 and out[i] > out[i - 1] > out[i - 2] for i in range(N)], "is_falling": [i >= 2 and out[i] < out[i - 1] < out[i - 2] for i in range(N)]}


def macd():
    line = zip_with(lambda a, b: a - b, ema(C, 12), ema(C, 26))
    signal = ema(line, 9)
    return {"macd": [x if y is not None else None for x, y in zip(line, signal)], "signal": signal, "is_bullish": [y is not None and x > y for x, y in zip(line, signal)], "is_bearish": [y is not None and x < y for x, y in zip(line, signal)]}


def ichimoku():
    mid = lambda n: zip_with(lambda a, b: (a + b) / 2, HH(n), LL(n))
    a, b, s = ([None] * 51 + x[51:] for x in (mid(9), mid(26), mid(52)))
    lead = zip_with(lambda x, y: (x + y) / 2, a, b)
    inside = [x is not None and min(x, y) <= c <= max(x, y) for x, y, c in zip(lead, s, C)]
    return {"tenkan": a, "kijun": b, "senkou_a": lead, "senkou_b": s, "cloud_thickness": zip_with(lambda x, y: abs(x - y), lead, s), "is_in_cloud": inside, "is_bullish": [x is not None and c > max(x, y) for x, y, c in zip(lead, s, C)], "is_cloud_bullish": [x is not None and x > y for x, y in zip(lead, s)]}


def elder_ray():
    e = ema(C, 13)
    bull, bear = zip_with(lambda h, x: h - x, H, e), zip_with(lambda l, x: l - x, L, e)  # noqa: E741
    strong = lambda f: [i > 0 and bull[i - 1] is not None and f(bull[i], bull[i - 1]) and f(bear[i], bear[i - 1]) for i in range(N)]
    return {"bull": bull, "bear": bear, "ema": e, "is_bullish": [x is not None and x > 0 and y > 0 for x, y in zip(bull, bear)], "is_strong_bullish": strong(lambda x, y: x > y), "is_strong_bearish": strong(lambda x, y: x < y)}


def fisher(n=10):
    value, f1, f2, f, signal = 0.0, 0.0, 0.0, [None], [None]
    for i in range(1, N):
        some = MID[max(0, i - n + 1) : i + 1]
        hi, lo = max(some), min(some)
        x = max(-0.999, min(0.999, 2 * (MID[i] - lo) / (hi - lo) - 1)) if hi > lo else 0.0
        value = x / 3 + 2 / 3 * value
        now = 0.25 * math.log((1 + value) / (1 - value)) + 0.25 * f1 + 0.25 * f2
        signal.append(f1)
        f.append(now)
        f1, f2 = now, f1
    return {"fisher": f, "signal": signal}


def psar():
    out, sar, ep, af, up = [None], None, None, 0.02, True
    for i in range(1, N):
        if sar is None:
            up = C[i] > (H[i - 1] + L[i - 1]) / 2
            sar, ep = (L[i - 1], H[i]) if up else (H[i - 1], L[i])
        else:
            sar += af * (ep - sar)
            sar = min(sar, L[i - 1]) if up else max(sar, H[i - 1])
            if L[i] < sar if up else H[i] > sar:
                sar, ep, af, up = ep, L[i] if up else H[i], 0.02, not up
            elif H[i] > ep if up else L[i] < ep:
                ep, af = H[i] if up else L[i], min(af + 0.02, 0.2)
        out.append(sar)
    return {"sar": out}


def kst():
    parts = []
    for r, m in zip((10, 15, 20, 30), (10, 10, 10, 15)):
        parts.append(over(fmean, zip_with(lambda a, b: (a - b) / b * 100, C, back(C, r)), m))
    line = zip_with(lambda a, b, c, d: a + 2 * b + 3 * c + 4 * d, *parts)
    s = over(fmean, line, 9)
    return {"kst": [x if y is not None else None for x, y in zip(line, s)], "signal": s, "is_bullish": [y is not None and x > y for x, y in zip(line, s)]}


def bands(n=20, k=2):
    m, s = over(fmean, C, n), over(pstdev, C, n)
    up, lo = zip_with(lambda a, b: a + k * b, m, s), zip_with(lambda a, b: a - k * b, m, s)
    return {"upper": up, "middle": m, "lower": lo, "bandwidth": zip_with(lambda a, b, c: (a - b) / c, up, lo, m), "is_above_upper": [x is not None and c > x for c, x in zip(C, up)]}


def cci(n=20):
    return {"cci": over(lambda w: (w[-1] - fmean(w)) / (0.015 * fmean(abs(x - fmean(w)) for x in w)), TP, n)}


VWAP = [a / b for a, b in zip(running([t * v for t, v in zip(TP, V)]), running(V))]
WAIT = {
    "sma": {"sma": over(fmean, C, 20)}, "ema": {"ema": ema(C, 21)}, "dema": {"dema": zip_with(lambda a, b: 2 * a - b, ema(C, 21), ema(ema(C, 21), 21))}, "macd": macd(), "adx": adx(), "ichimoku": ichimoku(),
    "donchian": {"upper": HH(20), "lower": LL(20), "width": zip_with(lambda a, b: a - b, HH(20), LL(20)), "is_at_upper": [x is not None and c == x for c, x in zip(C, HH(20))]},
    "keltner": {"upper": zip_with(lambda m, a: m + 2 * a, ema(C, 20), rma(TR, 20)), "lower": zip_with(lambda m, a: m - 2 * a, ema(C, 20), rma(TR, 20))},
    "hma": {"hma": wma(zip_with(lambda a, b: 2 * a - b, wma(C, 10), wma(C, 20)), 4)}, "zlema": {"zlema": ema([2 * C[i] - C[i - 10] if i > 10 else C[i] for i in range(N)], 21)},
    "rsi": {"rsi": RSI, "is_overbought": [x is not None and x > 70 for x in RSI], "is_neutral": [x is not None and 30 <= x <= 70 for x in RSI]}, "stochastic": stochastic(), "cci": cci(),
    "cmo": {"cmo": zip_with(lambda a, b: 100 * a / b, over(sum, CHANGE, 14), over(sum, [x if x is None else abs(x) for x in CHANGE], 14))}, "dpo": {"dpo": zip_with(lambda a, b: a - b, back(C, 11), over(fmean, C, 20))},
    "elder_ray": elder_ray(), "fisher": fisher(), "kst": kst(), "mfi": mfi(), "trix": {"trix": zip_with(lambda a, b: 100 * (a - b) / b, (t := ema(ema(ema(C, 15), 15), 15)), back(t, 1))}, "ultimate": ultimate(),
    "williams_r": {"wr": zip_with(lambda c, h, l: (h - c) / (h - l) * -100, C, HH(14), LL(14))}, "awesome": {"ao": zip_with(lambda a, b: a - b, over(fmean, MID, 5), over(fmean, MID, 34))}, "atr": {"atr": rma(TR, 14), "true_range": TR},
    "bollinger": bands(), "chandelier": {"long_exit": zip_with(lambda h, a: h - 3 * a, HH(22), rma(TR, 22)), "short_exit": zip_with(lambda l, a: l + 3 * a, LL(22), rma(TR, 22))},  # noqa: E741
    "ad_line": {"ad": running(FLOW)}, "chaikin_osc": {"co": zip_with(lambda a, b: a - b, ema(running(FLOW), 3), ema(running(FLOW), 10))}, "cmf": {"cmf": zip_with(lambda a, b: a / b, over(sum, FLOW, 20), over(sum, V, 20))},
    "force_index": {"fi": ema([None] + [(C[i] - C[i - 1]) * V[i] for i in range(1, N)], 13)}, "obv": obv(), "volume_osc": {"vo": zip_with(lambda a, b: (a - b) / b * 100, over(fmean, V, 5), over(fmean, V, 10))},
    "vwap": {"vwap": VWAP, "cumulative_volume": running(V), "is_above": [c > x for c, x in zip(C, VWAP)]}, "vwma": {"vwma": zip_with(lambda a, b: a / b, over(sum, [c * v for c, v in zip(C, V)], 20), over(sum, V, 20))}, "psar": psar(),
}


def zeros(xs):
    return [x or 0.0 for x in xs]


def batch_rvi(n=10):
    w = lambda xs: [(xs[i] + 2 * xs[i - 1] + 2 * xs[i - 2] + xs[i - 3]) / 6 if i > 2 else 0.0 for i in range(N)]
    a, b = w([c - o for c, o in zip(C, O)]), w([h - l for h, l in zip(H, L)])  # noqa: E741
    line = [sum(a[i - n + 1 : i + 1]) / sum(b[i - n + 1 : i + 1]) if i >= n + 2 else None for i in range(N)]
    return {"rvi": line, "signal": zip_with(lambda a, b, c, d: (a + 2 * b + 2 * c + d) / 6, line, back(line, 1), back(line, 2), back(line, 3))}


def batch_tsi(long=25, short=13, signal=13):
    x = zeros(CHANGE)
    twice = lambda s: ema(zeros(ema(s, long)), short)
    line = zip_with(lambda a, b: a / b * 100 if b else None, twice(x), twice([abs(y) for y in x]))
    return {"tsi": line, "signal": ema(zeros(line), signal)}


def batch_psar():
    out, sar, ep, af, up = [None], H[0], L[0], 0.02, True
    for i in range(1, N):
        sar += af * (ep - sar)
        sar = min(sar, L[i - 1], L[max(i - 2, 0)]) if up else max(sar, H[i - 1], H[max(i - 2, 0)])
        if L[i] < sar if up else H[i] > sar:
            sar, ep, af, up = ep, L[i] if up else H[i], 0.02, not up
        elif H[i] > ep if up else L[i] < ep:
            ep, af = H[i] if up else L[i], min(af + 0.02, 0.2)
        out.append(sar)
    return {"sar": out}


def batch_kama(n=10, fast=2, slow=30):
    out, y = [], None
    for i in range(N):
        if i == n - 1:
            y = C[i]
        elif i >= n:
            noise = sum(abs(C[j] - C[j - 1]) for j in range(i - n + 1, i + 1))
            er = abs(C[i] - C[i - n]) / noise if noise else 0.0
            k = (er * (2 / (fast + 1) - 2 / (slow + 1)) + 2 / (slow + 1)) ** 2
            y += k * (C[i] - y)
        out.append(y)
    return {"kama": out}


def linreg(w):
    n, mx, my = len(w), (len(w) - 1) / 2, fmean(w)
    slope = sum((i - mx) * (y - my) for i, y in enumerate(w)) / sum((i - mx) ** 2 for i in range(n))
    return slope, my - slope * mx


def nvi(sign):
    out, y = [], 1000.0
    for i in range(N):
        if i and (V[i] - V[i - 1]) * sign > 0:
            y *= C[i] / C[i - 1]
        out.append(y)
    return out


# Averages of averages and averages whose speed depends on the data, value by value.


def batch_t3(n=5, v=0.7):
    """Tillson: the filter (1 + v) * E - v * E * E, applied three times to E = EMA, multiplied out by the binomials."""
    e, levels = C, []
    for _ in range(6):
        e = ema(e if e is C else zeros(e), n)
        levels.append(e)
    # (1 + v)**3 E^3 - 3 (1 + v)**2 v E^4 + 3 (1 + v) v**2 E^5 - v**3 E^6
    weights = [(1 + v) ** 3, -3 * (1 + v) ** 2 * v, 3 * (1 + v) * v * v, -(v**3)]
    return [None if None in (row := [x[i] for x in levels[2:]]) else sum(w * y for w, y in zip(weights, row)) for i in range(N)]


def batch_alma(n=9, offset=0.85, sigma=6.0):
    gauss = [math.exp(-((k - offset * (n - 1)) ** 2) / (2 * (n / sigma) ** 2)) for k in range(n)]
    return over(lambda w: sum(g * x for g, x in zip(gauss, w)) / sum(gauss), C, n)


def batch_vidya(n=14, m=9):
    """Chande: an exponential average whose factor is scaled by the momentum of the last m changes."""
    out, y = [None] * N, None
    for i in range(m, N):
        changes = [C[j] - C[j - 1] for j in range(i - m + 1, i + 1)]
        up, down = sum(x for x in changes if x > 0), -sum(x for x in changes if x < 0)
        k = 2 / (n + 1) * (abs(up - down) / (up + down) if up + down else 0)
        y = C[i] if i == m else k * C[i] + (1 - k) * y
        out[i] = y
    return out


def batch_frama(n=16):
    """Ehlers: the factor follows the fractal dimension of the two halves of a window against the whole."""
    out, y, half = [None] * N, None, n // 2
    for i in range(n - 1, N):
        older, newer = range(i - n + 1, i - half + 1), range(i - half + 1, i + 1)
        slope = lambda r, k: (max(H[j] for j in r) - min(L[j] for j in r)) / k
        a, b, whole = slope(older, half), slope(newer, half), slope(range(i - n + 1, i + 1), n)
        dimension = math.log2((a + b) / whole) if min(a, b, whole) > 0 else 1.0
        k = min(1.0, max(0.01, math.exp(-4.6 * (dimension - 1))))
        y = C[i] if i == n - 1 else k * C[i] + (1 - k) * y
        out[i] = y
    return out


def batch_jma(n=14, phase=0.0, power=2.0):
    """Three stages: a smoothed price, its smoothed error in phase, and what is left of the way to both."""
    ratio = phase / 100 + 1.5
    beta = 0.45 * (n - 1) / (0.45 * (n - 1) + 2)
    alpha = beta**power
    out, smooth, error, left, y = [None] * N, 0.0, 0.0, 0.0, C[0]
    for i, x in enumerate(C):
        smooth = (1 - alpha) * x + alpha * smooth
        error = (1 - beta) * (x - smooth) + beta * error
        left = (smooth + ratio * error - y) * (1 - alpha) ** 2 + alpha**2 * left
        y += left
        out[i] = y if i >= n - 1 else None
    return out


BATCH = {
    "t3": {"t3": batch_t3()}, "alma": {"alma": batch_alma()}, "vidya": {"vidya": batch_vidya()}, "frama": {"frama": batch_frama()}, "jma": {"jma": batch_jma()},
    "sma": {"sma": over(fmean, C, 20)}, "wma": {"wma": wma(C, 20)}, "rma": {"rma": rma(C, 14)}, "dema": {"dema": zip_with(lambda a, b: 2 * a - b, ema(C, 21), ema(zeros(ema(C, 21)), 21))}, "atr": {"atr": rma(TR, 14)}, "tr": {"tr": TR},
    "lsma": {"lsma": over(lambda w: linreg(w)[1] + linreg(w)[0] * 24, C, 25)}, "linreg": {"slope": over(lambda w: linreg(w)[0], C, 14), "intercept": over(lambda w: linreg(w)[1], C, 14)}, "momentum": {"mom": zip_with(lambda a, b: a - b, C, back(C, 10))},
    "roc": {"roc": zip_with(lambda a, b: (a - b) / b * 100, C, back(C, 9))}, "rvi": batch_rvi(), "tsi": batch_tsi(), "chande_mo": {"cmo": zip_with(lambda a, b: a / b * 100, over(sum, CHANGE, 9), over(sum, [x if x is None else abs(x) for x in CHANGE], 9))},
    "dpo": {"dpo": zip_with(lambda a, b: a - b, C, back(over(fmean, C, 21), 11))}, "price_osc": {"po": zip_with(lambda a, b: (a - b) / b * 100, ema(C, 12), ema(C, 26))}, "bop": {"bop": over(fmean, [(c - o) / (h - l) for o, h, l, c in zip(O, H, L, C)], 14)},  # noqa: E741
    "bb_percent_b": {"percentb": zip_with(lambda c, m, s: (c - m + 2 * s) / (4 * s), C, over(fmean, C, 20), over(pstdev, C, 20))}, "bb_bandwidth": {"bandwidth": zip_with(lambda m, s: 400 * s / m, over(fmean, C, 20), over(pstdev, C, 20))},
    "adr": {"adr": over(fmean, [h - l for h, l in zip(H, L)], 14)}, "hist_vol": {"hv": [None] * 20 + over(pstdev, [0.0] + [math.log(b / a) for a, b in zip(C, C[1:])], 20)[20:]}, "donchian": {"middle": zip_with(lambda a, b: (a + b) / 2, HH(20), LL(20))},  # noqa: E741
    "choppiness": {"chop": zip_with(lambda s, h, l: 100 * math.log10(s / (h - l)) / math.log10(14), over(sum, TR, 14), HH(14), LL(14))}, "envelope": {"upper": [x if x is None else x * 1.025 for x in over(fmean, C, 20)]},  # noqa: E741
    "ulcer": {"ulcer": over(lambda w: math.sqrt(fmean(((x - max(w)) / max(w) * 100) ** 2 for x in w)), C, 14)}, "vortex": {"vi_plus": zip_with(lambda a, b: a / b, over(sum, [None] + [abs(H[i] - L[i - 1]) for i in range(1, N)], 14), over(sum, [None, *TR[1:]], 14))},
    "aroon": {"up": over(lambda w: 100 * max(k for k, x in enumerate(w) if x == max(w)) / 25, H, 26), "down": over(lambda w: 100 * max(k for k, x in enumerate(w) if x == min(w)) / 25, L, 26)}, "psar": batch_psar(), "kama": batch_kama(),
    "ad_line": {"ad": running(FLOW)}, "pvt": {"pvt": running([0.0] + [(C[i] - C[i - 1]) / C[i - 1] * V[i] for i in range(1, N)])}, "nvi": {"nvi": nvi(-1), "pvi": nvi(1)}, "elder_force": {"efi": ema([0.0] + [(C[i] - C[i - 1]) * V[i] for i in range(1, N)], 13)},
    "median": {"median": over(lambda w: sorted(w)[2], C, 5)}, "volume_delta": {"delta": [v * (2 * (c - l) / (h - l) - 1) for h, l, c, v in zip(H, L, C, V)]},  # noqa: E741
}


def same(found, expected, name):
    for key, values in expected.items():
        for i, (a, b) in enumerate(zip(found[key], values, strict=True)):
            assert a == b if isinstance(b, bool) else close(a, b) or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)), (name, key, i, a, b)


@pytest.mark.parametrize("name", WAIT)
def test_waiting_family(bars, name):
    same(got(bars, WAITING[name]), WAIT[name], name)


@pytest.mark.parametrize("name", BATCH)
def test_batch_family(bars, name):
    found, expected = got(bars, TA[name]), BATCH[name]
    if name == "hist_vol":
        expected = {"hv": [x if x is None else x * math.sqrt(252) * 100 for x in expected["hv"]]}
    same(found, expected, name)




@pytest.mark.parametrize("name", ["sma", "macd", "adx", "ichimoku", "bb", "keltner", "aroon", "stoch", "cci", "tsi", "obv", "ad_line", "chaikin_osc", "pvt", "cvd", "vwap", "bars_since_cross"])
def test_parts_of_a_symbol_give_the_same(bars, name):
    chain = Chain()
    chain.out = TA[name](chain)
    whole = sorted(chain.apply(bars).collect(), key=lambda r: r["ts"])
    assert chain.reach() is not None
    for rows, span in ((max(60, *chain.reach()), 20_000), (N, 86400)):
        parts = sorted(chain.apply_in_parts(bars, rows, span).collect(), key=lambda r: r["ts"])
        assert len(parts) == N and parts[0].asDict().keys() == whole[0].asDict().keys()
        assert all(close(a[n], b[n]) for a, b in zip(parts, whole) for n in chain.out)


def test_parts_with_long_series(spark):
    rows = [("a", datetime(2024, 1, 1) + timedelta(minutes=i), 0.0, 0.0, 0.0, 100 + math.sin(i / 9) * 5 + i % 7, 1.0) for i in range(6000)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    chain = Chain()
    chain.out = TA["ema"](chain, length=9)
    assert max(chain.reach()) < 300
    whole, parts = ({r["ts"]: r["ema"] for r in f.collect()} for f in (chain.apply(df), chain.apply_in_parts(df, 700, 50_000)))
    assert whole.keys() == parts.keys() and all(close(whole[k], parts[k]) for k in whole)


def test_reach():
    of = lambda f, **k: (lambda c: (c.out.update(f(c, **k)), c.reach())[1])(Chain())
    assert of(TA["sma"], length=20) == (19, 0) and of(TA["momentum"], length=10) == (10, 0)
    assert of(TA["ichimoku"])[1] == 25 and of(TA["hma"], length=20)[0] == 22
    assert all(of(TA[n]) is None for n in ("psar", "supertrend", "nvi", "kama"))
    # Sums over all rows go on from the spans before; their own rows' inputs are what is needed.
    assert of(TA["obv"]) == (1, 0) and of(TA["vwap"]) == (0, 0) and of(TA["chaikin_osc"]) is not None
    assert of(lambda c: {"x": f"lag({c.cum('max', 'h')}, 2) over (partition by symbol order by ts)"}) is None


def test_divergences(bars):
    r = got(bars, TA["rsi"])["rsi"]
    plain, hidden = got(bars, SIGNALS["sg_divergence"]), got(bars, SIGNALS["sg_hidden_div"])
    n, seen = 14, set()
    for i in range(N):
        expected = [False] * 4
        if i >= n:
            before = range(i - n, i)
            low, high = min(C[j] for j in before), max(C[j] for j in before)
            at = lambda x: r[max(j for j in before if C[j] == x)]  # noqa: E731, B023
            a, b = at(low), at(high)
            if a is not None:
                expected[0], expected[2] = C[i] <= low and r[i] > a, C[i] > low and r[i] < a
            if b is not None:
                expected[1], expected[3] = C[i] >= high and r[i] < b, not expected[2] and C[i] < high and r[i] > b
        assert [plain["bullish"][i], plain["bearish"][i], hidden["bullish"][i], hidden["bearish"][i]] == expected, i
        seen |= {k for k, x in enumerate(expected) if x}
    assert len(seen) >= 3


def wild(seed):
    """Bars with jumps of price and volume, so that the events occur."""
    r, out, p = random.Random(seed), [], 100.0
    for i in range(400):
        o = p
        jump = r.random() < 0.06
        p = max(5.0, p + r.uniform(-3, 3) * (3 if jump else 1) + math.sin(i / 15))
        tail = r.expovariate(0.5) * (4 if jump else 1)
        out.append((o, max(o, p) + r.random() + tail * (r.random() < 0.5), min(o, p) - r.random() - tail * (r.random() < 0.5), p, r.uniform(5, 15) * (r.uniform(1.5, 6) if jump else 1)))
    return out


def test_wyckoff_events(spark):
    """Each event from its rule; together the seeds show every kind."""
    start, rows, all_ = datetime(2024, 1, 1), [], {s: wild(s) for s in range(8)}
    for s, some in all_.items():
        rows += [(str(s), start + timedelta(hours=i), *x) for i, x in enumerate(some)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    chain = Chain()
    chain.out = {f"{k}_{n}": e for k in ("wy_spring", "wy_upthrust", "wy_climax", "wy_sos_sow") for n, e in MORE[k](chain).items()}
    found = {}
    for r in chain.apply(df).orderBy("ts").collect():
        found.setdefault(int(r["symbol"]), []).append(r)
    seen = set()
    for s, some in all_.items():
        o, h, l, c, v = zip(*some)  # noqa: E741
        for i in range(len(some)):
            e = dict.fromkeys(("spring", "upthrust", "selling", "buying", "sos", "sow"), False)
            if i >= 52:
                support, resistance = min(l[i - 49 : i - 2]), max(h[i - 49 : i - 2])
                quiet = v[i - 1] < 2 * fmean(v[i - 20 : i])
                e["spring"] = quiet and l[i - 1] < support and c[i] > support and c[i] >= o[i]
                e["upthrust"] = quiet and h[i - 1] > resistance and c[i] < resistance and c[i] < o[i]
            if i >= 21:
                spans = [a - b for a, b in zip(h[i - 21 : i - 1], l[i - 21 : i - 1])]
                big = v[i - 1] > 2 * fmean(v[i - 21 : i - 1]) and h[i - 1] - l[i - 1] > 1.5 * fmean(spans)
                body = abs(c[i - 1] - o[i - 1])
                e["selling"] = big and min(o[i - 1], c[i - 1]) - l[i - 1] > body and c[i] >= o[i]
                e["buying"] = big and h[i - 1] - max(o[i - 1], c[i - 1]) > body and c[i] < o[i]
            if i >= 49:
                loud = v[i] > 1.2 * fmean(v[i - 19 : i + 1])
                e["sos"] = loud and c[i] > max(h[i - 49 : i]) and c[i] >= o[i]
                e["sow"] = loud and c[i] < min(l[i - 49 : i]) and c[i] < o[i]
            r = found[s][i]
            assert (r["wy_spring_is_spring"], r["wy_upthrust_is_upthrust"], r["wy_climax_selling"], r["wy_climax_buying"], r["wy_sos_sow_sos"], r["wy_sos_sow_sow"]) == tuple(e.values()), (s, i)
            seen |= {k for k, x in e.items() if x}
    assert seen == {"spring", "upthrust", "selling", "buying", "sos", "sow"}
