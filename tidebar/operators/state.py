"""Indicators whose next value depends on data and on the state before it: small state machines, one step a row."""

from __future__ import annotations

import math

from tidebar.functions.windows import hl2, highest, lowest, num
from tidebar.operators.ta import Out, _atr, ta
from tidebar.plans.chain import Chain


@ta
def mcginley(c: Chain, source: str = "c", length: int = 14) -> Out:
    def step(md, p):
        if md == 0:
            return (p,)
        square = (p / md) * (p / md)
        d = length * (square * square)
        return (md + (p - md) / d if d else md,)

    q = "((t.in0 / nullif(r.md, 0e0)) * (t.in0 / nullif(r.md, 0e0)))"
    d = f"({num(length)} * ({q} * {q}))"
    sql = f"case when r.md = 0 then t.in0 when {d} = 0 then r.md else r.md + (t.in0 - r.md) / nullif({d}, 0e0) end"
    return {"mcginley": c.fold([source], ["md"], lambda p: (p,), step, ["t.in0"], [sql])[0]}


@ta
def jma(c: Chain, source: str = "c", length: int = 14, phase: float = 0.0, power: float = 2.0) -> Out:
    ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 100 + 1.5
    beta = 0.45 * (length - 1) / (0.45 * (length - 1) + 2)
    alpha = beta**power
    # The first two states do not depend on the average: one-term recurrences.
    e0 = c.scan(num(alpha), f"{num(1 - alpha)} * {source}")
    e1 = c.scan(num(beta), f"{num(1 - beta)} * ({source} - {e0})")
    goal = c.col(f"{e0} + {num(ratio)} * {e1}")

    def step(e2, out, goal, _):
        e2 = (goal - out) * (1 - alpha) ** 2 + alpha**2 * e2
        return e2, out + e2

    move = f"((t.in0 - {{out}}) * {num((1 - alpha) ** 2)} + {num(alpha**2)} * {{e2}})"
    first, then = move.format(out="t.in1", e2="0e0"), move.format(out="r.outv", e2="r.e2")
    e2, out = c.fold([goal, source], ["e2", "outv"], lambda g, p: step(0.0, p, g, p), step, [first, f"t.in1 + {first}"], [then, f"r.outv + {then}"])
    return {"jma": f"case when i >= {length - 1} then {out} end"}


@ta
def fisher(c: Chain, length: int = 9) -> Out:
    """Where the range is flat the value stays and the last fisher is repeated."""
    x = c.col(hl2)
    hi, lo = c.col(highest(x, length)), c.col(lowest(x, length))
    raw = c.col(f"case when {hi} > {lo} then 0.66e0 * greatest(-0.999e0, least(0.999e0, 2e0 * (({x} - {lo}) / nullif({hi} - {lo}, 0e0) - 0.5e0))) end")

    def step(value, fish, before, raw):
        if raw is None:
            return value, fish, fish
        value = max(-0.999, min(0.999, raw + 0.67 * value))
        return value, 0.5 * math.log((1 + value) / (1 - value)) + 0.5 * fish, fish

    value = "greatest(-0.999e0, least(0.999e0, t.in0 + 0.67e0 * {v}))"
    fish = f"0.5e0 * ln((1e0 + {value}) / (1e0 - {value})) + 0.5e0 * {{f}}"
    when = lambda a, b: f"case when t.in0 is null then {b} else {a} end"
    first = [when(value.format(v="0e0"), "0e0"), when(fish.format(v="0e0", f="0e0"), "0e0"), "0e0"]
    then = [when(value.format(v="r.value"), "r.value"), when(fish.format(v="r.value", f="r.fish"), "r.fish"), "r.fish"]
    _, f, before = c.fold([raw], ["value", "fish", "before"], lambda raw: step(0.0, 0.0, 0.0, raw), step, first, then)
    return {"fisher": f"case when i >= {length - 1} then {f} end", "trigger": f"case when i >= {length - 1} then {before} end"}


@ta
def supertrend(c: Chain, atr_period: int = 10, factor: float = 3.0) -> Out:
    """Direction -1 is bullish; before the range is ready both bands are the bar's middle."""
    a = _atr(c, atr_period)
    up, low = c.col(f"{hl2} + coalesce({num(factor)} * {a}, 0e0)"), c.col(f"{hl2} - coalesce({num(factor)} * {a}, 0e0)")
    back = c.col("coalesce(lag(c) over (partition by symbol order by ts), c)")

    def step(fu, fl, st, way, u, l, close, last):  # noqa: E741
        upper = u if u < fu or last > fu else fu
        lower = l if l > fl or last < fl else fl
        before = upper if st is None else st
        bear = not close > upper if before == fu else close < lower
        return upper, lower, upper if bear else lower, 1.0 if bear else -1.0

    fu = "(case when t.in0 < r.fu or t.in3 > r.fu then t.in0 else r.fu end)"
    fl = "(case when t.in1 > r.fl or t.in3 < r.fl then t.in1 else r.fl end)"
    bear = f"(case when coalesce(r.st, {fu}) = r.fu then not t.in2 > {fu} else t.in2 < {fl} end)"
    sql = [fu, fl, f"case when {bear} then {fu} else {fl} end", f"case when {bear} then 1e0 else -1e0 end"]
    _, _, st, way = c.fold([up, low, "c", back], ["fu", "fl", "st", "way"], lambda u, l, close, last: (u, l, None, None), step, ["t.in0", "t.in1", "null::double", "null::double"], sql)  # noqa: E741
    return {"supertrend": st, "direction": way}


@ta
def psar(c: Chain, start: float = 0.02, increment: float = 0.02, maximum: float = 0.2) -> Out:
    """Starts as an uptrend from the first bar's high, with its low as the extreme."""
    low1, high1 = c.col("coalesce(lag(l) over (partition by symbol order by ts), l)"), c.col("coalesce(lag(h) over (partition by symbol order by ts), h)")
    low2, high2 = c.col(f"least({low1}, coalesce(lag(l, 2) over (partition by symbol order by ts), {low1}))"), c.col(f"greatest({high1}, coalesce(lag(h, 2) over (partition by symbol order by ts), {high1}))")

    def step(sar, ep, af, up, high, low, floor, roof):
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

    sar = "(case when r.up = 1 then least(r.sar + r.af * (r.ep - r.sar), t.in2) else greatest(r.sar + r.af * (r.ep - r.sar), t.in3) end)"
    turn = f"(case when r.up = 1 then t.in1 < {sar} else t.in0 > {sar} end)"
    more = "(case when r.up = 1 then t.in0 > r.ep else t.in1 < r.ep end)"
    sql = [
        f"case when {turn} then r.ep else {sar} end",
        f"case when {turn} then case when r.up = 1 then t.in1 else t.in0 end when {more} then case when r.up = 1 then t.in0 else t.in1 end else r.ep end",
        f"case when {turn} then {num(start)} when {more} then least(r.af + {num(increment)}, {num(maximum)}) else r.af end",
        f"case when {turn} then 1e0 - r.up else r.up end",
    ]
    out = c.fold(["h", "l", low2, high2], ["sar", "ep", "af", "up"], lambda high, low, floor, roof: (high, low, start, 1.0), step, ["t.in0", "t.in1", num(start), "1e0"], sql)
    return {"sar": f"case when i > 0 then {out[0]} end"}


@ta
def zigzag(c: Chain, deviation: float = 5.0) -> Out:
    """Per bar the pivot that is running (price, bar, looking for a high) and, where one is confirmed, its price and bar.

    The pivots of the series are the confirmed ones and the running one of the last bar.
    """
    d = deviation / 100

    def step(price, at, seek, done, _, __, high, low, i):
        up, down = high > price * (1 + d), low < price * (1 - d)
        if seek:
            if up:
                return (high, i, 0.0, done, price, at) if done else (high, i, 0.0, done, None, None)
            return (low, i, seek, done, None, None) if down else (price, at, seek, done, None, None)
        if down:
            return low, i, 1.0, 1.0, price, at
        return (high, i, seek, done, None, None) if up else (price, at, seek, done, None, None)

    up, down = f"(t.in0 > r.price * {num(1 + d)})", f"(t.in1 < r.price * {num(1 - d)})"
    move = f"({up} or {down})"
    price = f"case when r.seek = 1 and {up} then t.in0 when r.seek = 1 and {down} then t.in1 when r.seek = 0 and {down} then t.in1 when r.seek = 0 and {up} then t.in0 else r.price end"
    turn = f"((r.seek = 1 and {up}) or (r.seek = 0 and {down}))"
    known = f"({turn} and (r.seek = 0 or r.done = 1))"
    sql = [price, f"case when {move} then t.in2 else r.at end", f"case when {turn} then 1e0 - r.seek else r.seek end", f"case when {known} then 1e0 else r.done end", f"case when {known} then r.price end", f"case when {known} then r.at end"]
    first = ["(t.in0 + t.in1) / 2e0", "0e0", "1e0", "0e0", "null::double", "null::double"]
    out = c.fold(["h", "l", "cast(i as double)"], ["price", "at", "seek", "done", "was", "wasat"], lambda high, low, i: ((high + low) / 2, 0.0, 1.0, 0.0, None, None), step, first, sql)
    return {"running": out[0], "running_bar": out[1], "seeks_high": out[2], "zigzag": out[4], "pivot_bar": out[5]}
