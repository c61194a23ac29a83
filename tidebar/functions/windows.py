"""SQL text for bounded and cumulative frames over a symbol's bars, in words that Spark SQL and ANSI engines share."""

from __future__ import annotations

from tidebar.plans.chain import W_SQL, num

__all__ = ["W_SQL", "bars_since", "body", "cumulative", "div", "filled", "frame", "fma", "highest", "hl2", "hlc3", "lag", "lagged_sum", "lead", "lowest", "mean", "num", "pstdev", "rolling", "since_true", "total", "true_range", "zero"]


def frame(agg: str, n: int, upto: str = "current row") -> str:
    return f"{agg} over ({W_SQL} rows between {n - 1} preceding and {upto})"


def rolling(agg: str, x: str, n: int) -> str:
    """An aggregate of the last n rows once all n have a value."""
    return f"case when {frame(f'count({x})', n)} = {n} then {frame(agg, n)} end"


def mean(x: str, n: int) -> str:
    return rolling(f"avg({x})", x, n)


def total(x: str, n: int) -> str:
    return rolling(f"sum({x})", x, n)


def highest(x: str, n: int) -> str:
    return rolling(f"max({x})", x, n)


def lowest(x: str, n: int) -> str:
    return rolling(f"min({x})", x, n)


def pstdev(x: str, n: int) -> str:
    return rolling(f"stddev_pop({x})", x, n)


def cumulative(agg: str) -> str:
    return f"{agg} over ({W_SQL} rows between unbounded preceding and current row)"


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) over ({W_SQL})"


def lead(x: str, n: int = 1) -> str:
    return f"lead({x}, {n}) over ({W_SQL})"


def zero(x: str) -> str:
    """Null as 0: how a chained stage of the batch library sees a stage that isn't ready."""
    return f"coalesce({x}, 0e0)"


def filled(x: str, n: int) -> str:
    """Null before row n - 1."""
    return f"case when i >= {n - 1} then {x} end"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0e0))"


def lagged_sum(x: str, weights: list[float]) -> str:
    """Weights of the newest value first; null until all are there."""
    return "(" + " + ".join(f"{num(w)} * {x if j == 0 else lag(x, j)}" for j, w in enumerate(weights)) + ")"


def fma(a: float, x: str, b: float) -> str:
    return f"({num(a)} * ({x}) + {num(b)})"


def since_true(cond: str) -> str:
    """Rows since the condition held; null before it first did."""
    return f"i - max(case when {cond} then i end) over ({W_SQL} rows between unbounded preceding and current row)"


def bars_since(x: str, n: int, best: str) -> str:
    """Rows since the extreme of the last n, the latest of equals: the first lag that equals the frame's extreme."""
    extreme = frame(f"{best}({x})", n)
    whens = " ".join(f"when {x if j == 0 else lag(x, j)} = {extreme} then {j}" for j in range(n))
    return f"case when i >= {n - 1} then case {whens} end end"


hl2 = "((h + l) / 2e0)"
hlc3 = "((h + l + c) / 3e0)"
body = "abs(c - o)"
true_range = f"case when i = 0 then h - l else greatest(h - l, abs(h - {lag('c')}), abs(l - {lag('c')})) end"
