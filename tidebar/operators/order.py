"""Order statistics and entropies of the last rows, levels, and the Wyckoff events: rolling lists where sums don't do."""

from __future__ import annotations

import math
from collections.abc import Callable

from tidebar.functions.windows import frame, highest, hlc3, lag, lowest, mean, num
from tidebar.operators.ta import Out, ta
from tidebar.plans.chain import W_SQL, Chain

MORE: dict[str, Callable[[Chain], Out]] = {}


def rows(c: Chain, x: str, n: int) -> str:
    """The last n values as a list, oldest first; null before there are n."""
    over = f"over ({W_SQL} rows between {n - 1} preceding and current row)"
    return c.both(f"case when i >= {n - 1} then collect_list({x}) {over} end", f"case when i >= {n - 1} then list({x}) {over} end")


@ta
def percentile(c: Chain, source: str = "c", length: int = 14, percent: float = 50.0) -> Out:
    at = min(int(percent / 100 * (length - 1)), length - 1) + 1
    w = rows(c, source, length)
    return {"percentile": c.both(f"element_at(array_sort({w}), {at})", f"list_sort({w})[{at}]")}


@ta
def median(c: Chain, source: str = "c", length: int = 5) -> Out:
    w = rows(c, source, length)
    a, b = (length + 1) // 2, length // 2 + 1
    return {"median": c.both(f"(element_at(array_sort({w}), {a}) + element_at(array_sort({w}), {b})) / 2e0", f"(list_sort({w})[{a}] + list_sort({w})[{b}]) / 2e0")}


def _rci(c: Chain, source: str, n: int) -> str:
    """Of equal values the older one ranks lower."""
    w = rows(c, source, n)
    rank = "1 + size(filter({w}, (y, k) -> y < x or (y = x and k < j)))".format(w=w)
    spark = f"aggregate(transform({w}, (x, j) -> power(cast({rank} - (j + 1) as double), 2)), 0e0, (s, d) -> s + d)"
    other = f"list_sum(list_transform({w}, lambda x, j: power((1 + len(list_filter({w}, lambda y, k: y < x or (y = x and k < j))) - j)::double, 2)))"
    return c.both(f"(1e0 - 6e0 * ({spark}) / {num(n * (n * n - 1))}) * 100e0", f"(1e0 - 6e0 * ({other}) / {num(n * (n * n - 1))}) * 100e0")


@ta
def rci(c: Chain, short_length: int = 9, medium_length: int = 26, long_length: int = 52) -> Out:
    return {"rci_short": _rci(c, "c", short_length), "rci_medium": _rci(c, "c", medium_length), "rci_long": _rci(c, "c", long_length)}


def _bins(c: Chain, source: str, n: int, bins: int) -> tuple[str, str, str]:
    """The list of each value's bin, the least value and the bins' width."""
    w = rows(c, source, n)
    low, width = c.col(frame(f"min({source})", n)), c.col(f"({frame(f'max({source})', n)} - {frame(f'min({source})', n)}) / {num(bins)}")
    place = f"least(floor((x - {low}) / nullif({width}, 0e0)), {num(bins - 1)})"
    return c.both(f"transform({w}, x -> {place})", f"list_transform({w}, lambda x: {place})"), low, width


@ta
def mode(c: Chain, source: str = "c", length: int = 14, bins: int = 10) -> Out:
    """The middle of the fullest bin, of equally full ones the last."""
    w, low, width = _bins(c, source, length, bins)
    spark = f"array_max(transform(sequence(0, {bins - 1}), k -> struct(size(filter({w}, x -> x = k)) as n, k as k))).k"
    other = f"list_max(list_transform(range({bins}), lambda k: len(list_filter({w}, lambda x: x = k)) * {bins} + k)) % {bins}"
    best = c.both(spark, other)
    return {"mode": f"case when i >= {length - 1} then case when {width} = 0 then {low} else {low} + ({best} + 0.5e0) * {width} end end"}


def _entropy(c: Chain, w: str, n: int, values: range, top: float) -> str:
    """Of a list's values, over its greatest possible one."""
    share = f"cast(size(filter({w}, x -> x = k)) as double) / {num(n)}"
    spark = f"aggregate(transform(sequence({values.start}, {values.stop - 1}), k -> {share}), 0e0, (s, p) -> s - case when p > 0 then p * ln(p) else 0e0 end)"
    other = f"list_sum(list_transform(range({values.start}, {values.stop}), lambda k: case when len(list_filter({w}, lambda x: x = k)) > 0 then -(len(list_filter({w}, lambda x: x = k)) / {num(n)}) * ln(len(list_filter({w}, lambda x: x = k)) / {num(n)}) else 0e0 end))"
    return c.both(f"({spark}) / {num(top)}", f"({other}) / {num(top)}")


def shannon(c: Chain, length: int = 20, bins: int = 10) -> Out:
    w, _, width = _bins(c, "c", length, bins)
    e = _entropy(c, w, length, range(bins), math.log(bins))
    return {"entropy": f"case when i >= {length - 1} then case when {width} = 0 then 0e0 else {e} end end"}


def lempel_ziv(c: Chain, length: int = 100) -> Out:
    """Complexity of the changes of the last closes, as above or not above the closes' median, over its greatest value for that length.

    The signs are parsed into words that were not there before. What is kept meanwhile is one text: the words between
    commas, a bar, and the word that has begun.
    """
    w = rows(c, "c", length)
    a, b = (length + 1) // 2, length // 2 + 1
    middle = c.both(f"(element_at(array_sort({w}), {a}) + element_at(array_sort({w}), {b})) / 2e0", f"(list_sort({w})[{a}] + list_sort({w})[{b}]) / 2e0")
    bits = c.both(f"transform(slice({w}, 2, {length - 1}), (x, k) -> case when x - {w}[k] > {middle} then '1' else '0' end)", f"list_transform(list_zip({w}[2:], {w}[:{length - 1}]), lambda x: case when x[1] - x[2] > {middle} then '1' else '0' end)")
    words, begun = "split_part(s, '|', 1)", "split_part(s, '|', 2)"
    step = f"case when contains({words}, concat(',', {begun}, x, ',')) then concat(s, x) else concat({words}, {begun}, x, ',|') end"
    parsed = c.both(f"aggregate({bits}, ',|', (s, x) -> {step})", f"list_reduce({bits}, lambda s, x: {step}, ',|')")
    n = c.col(f"length({parsed}) - length(replace({parsed}, ',', '')) - 1 + case when {parsed} like '%|' then 0 else 1 end")
    return {"complexity": f"case when i >= {length - 1} then least(1e0, {n} / {num((length - 1) / math.log2(length - 1))}) end"}


def permutation(c: Chain, length: int = 20) -> Out:
    """Ordinal patterns of three neighbours, coded by their comparisons."""
    a, b = c.col(lag("c", 2)), c.col(lag("c", 1))
    bit = lambda cond, v: f"case when {cond} then {v} else 0 end"
    code = c.col(f"{bit(f'{a} <= {b}', 4)} + {bit(f'{b} <= c', 2)} + {bit(f'{a} <= c', 1)}")
    w = rows(c, code, length - 2)
    return {"entropy": f"case when i >= {length - 1} then {_entropy(c, w, length - 2, range(8), math.log(6))} end"}


def pivot_points(c: Chain) -> Out:
    """Levels of each bar: standard, Fibonacci, Woodie, Camarilla and DeMark."""
    p, span, w = c.col(hlc3), "(h - l)", c.col("(h + l + 2e0 * c) / 4e0")
    x = c.col("case when c < o then h + 2e0 * l + c when c > o then 2e0 * h + l + c else h + l + 2e0 * c end")
    out = {"p": p, "r1": f"2e0 * {p} - l", "r2": f"{p} + {span}", "r3": f"h + 2e0 * ({p} - l)", "s1": f"2e0 * {p} - h", "s2": f"{p} - {span}", "s3": f"l - 2e0 * (h - {p})"}
    for k, share in enumerate((0.382, 0.618, 1.0), 1):
        out |= {f"fib_r{k}": f"{p} + {num(share)} * {span}", f"fib_s{k}": f"{p} - {num(share)} * {span}"}
    for k, part in enumerate((12, 6, 4), 1):
        out |= {f"cam_r{k}": f"c + {span} * 1.1e0 / {num(part)}", f"cam_s{k}": f"c - {span} * 1.1e0 / {num(part)}"}
    step = lambda sign, names: "case " + " ".join(f"when c {sign} {out[n]} then {out[n]}" for n in names[:2]) + f" else {out[names[2]]} end"
    out |= {"nearest_support": step(">=", ("s1", "s2", "s3")), "nearest_resistance": step("<=", ("r1", "r2", "r3")), "is_above_pivot": f"coalesce(c > {p}, false)", "is_below_pivot": f"coalesce(c < {p}, false)"}
    return out | {"woodie_p": w, "woodie_r1": f"2e0 * {w} - l", "woodie_s1": f"2e0 * {w} - h", "demark_r1": f"{x} / 2e0 - l", "demark_s1": f"{x} / 2e0 - h"}


def fibonacci(c: Chain, length: int = 20, tolerance: float = 1.0) -> Out:
    """Retracements down from the highest to the lowest of the last bars, and extensions above; the level nearest to the close, and
    the same where it is within `tolerance` per cent."""
    hi, lo = c.col(highest("h", length)), c.col(lowest("l", length))
    down = {f"level_{k}": f"{hi} - ({hi} - {lo}) * {num(k / 1000)}" for k in (0, 236, 382, 500, 618, 786, 1000)}
    up = {f"extension_{k}": f"{hi} + ({hi} - {lo}) * {num(k / 1000 - 1)}" for k in (1618, 2618, 4236)}
    far = f"least({', '.join(f'abs(c - ({e}))' for e in down.values())})"
    nearest = "case " + " ".join(f"when abs(c - ({e})) = {far} then {e}" for e in down.values()) + " end"
    near = c.col(nearest)
    return down | up | {"nearest": near, "near_level": f"case when abs(c - {near}) / nullif({near}, 0e0) * 100e0 <= {num(tolerance)} then {near} end"}


def premium(c: Chain, length: int = 50) -> Out:
    return {"equilibrium": f"({highest('h', length)} + {lowest('l', length)}) / 2e0"}


LOOK, VOLUME, SPIKE = 50, 20, 2.0
UP, DOWN = "c >= o", "c < o"


def _range(agg: str, x: str, first: int, last: int) -> str:
    return f"{agg}({x}) over ({W_SQL} rows between {first} preceding and {last} preceding)"


def spring(c: Chain) -> Out:
    """The bar before fell below the lows of the bars before it on no great volume; this one recovers."""
    level = c.col(_range("min", "l", LOOK - 1, 3))
    quiet = c.col(f"{lag('v')} < {num(SPIKE)} * {_range('avg', 'v', VOLUME, 1)}")
    return {"support": level, "is_spring": f"coalesce(i >= {LOOK + 2} and {lag('l')} < {level} and c > {level} and {UP} and {quiet}, false)"}


def upthrust(c: Chain) -> Out:
    level = c.col(_range("max", "h", LOOK - 1, 3))
    quiet = c.col(f"{lag('v')} < {num(SPIKE)} * {_range('avg', 'v', VOLUME, 1)}")
    return {"resistance": level, "is_upthrust": f"coalesce(i >= {LOOK + 2} and {lag('h')} > {level} and c < {level} and {DOWN} and {quiet}, false)"}


def climax(c: Chain) -> Out:
    span, tail, top, size = c.col("h - l"), c.col("least(o, c) - l"), c.col("h - greatest(o, c)"), c.col("abs(c - o)")
    wild = f"i >= {VOLUME + 1} and {lag('v')} > 2e0 * {_range('avg', 'v', VOLUME + 1, 2)} and {lag(span)} > 1.5e0 * {_range('avg', span, VOLUME + 1, 2)}"
    return {"selling": f"coalesce({wild} and {lag(tail)} > {lag(size)} and {UP}, false)", "buying": f"coalesce({wild} and {lag(top)} > {lag(size)} and {DOWN}, false)"}


def strength(c: Chain) -> Out:
    loud = f"v > 1.2e0 * {frame('avg(v)', VOLUME)} and i >= {LOOK - 1}"
    return {"sos": f"coalesce({loud} and c > {_range('max', 'h', LOOK - 1, 1)} and {UP}, false)", "sow": f"coalesce({loud} and c < {_range('min', 'l', LOOK - 1, 1)} and {DOWN}, false)", "volume_ratio": f"v / nullif({frame('avg(v)', VOLUME)}, 0e0)"}


def phase(c: Chain) -> Out:
    """1 markup, 2 markdown, 3 accumulation, 4 distribution, 0 none, by the two halves of the last bars."""
    m, span = c.col(mean("c", LOOK)), c.col(mean(c.col("h - l"), LOOK))
    a, b = c.col(lag(m, LOOK)), c.col(f"{span} / nullif({lag(span, LOOK)}, 0e0)")
    return {"phase": f"case when {a} is null or {b} is null then 0e0 when {m} > {a} and {b} > 1 then 1e0 when {m} < {a} and {b} > 1 then 2e0 when {b} < 0.8e0 and {m} < {a} * 1.02e0 then 3e0 when {b} < 0.8e0 and {m} > {a} * 0.98e0 then 4e0 else 0e0 end"}


def event_sides(c: Chain) -> Out:
    """Means of the last bars that the events are measured by, and which events of either side a bar shows.

    Climaxes are of neither side.
    """
    s = strength(c)
    true = c.col(f"case when i = 0 then h - l else greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) end")
    side = f"case when {spring(c)['is_spring']} or {s['sos']} then 1e0 when {upthrust(c)['is_upthrust']} or {s['sow']} then -1e0 else 0e0 end"
    return {"volume": frame("avg(v)", VOLUME), "range": frame("avg(h - l)", VOLUME), "close": frame("avg(c)", LOOK), "atr": frame(f"avg({true})", 14), "event_side": side}


MORE |= {"x_wy_avg": event_sides, "sc_shannon": shannon, "sc_lempel_ziv": lempel_ziv, "sc_perm_entropy": permutation, "s_pivots": pivot_points, "s_fibonacci": fibonacci, "smc_premium": premium, "wy_spring": spring, "wy_upthrust": upthrust, "wy_climax": climax, "wy_sos_sow": strength, "wy_phase": phase}
