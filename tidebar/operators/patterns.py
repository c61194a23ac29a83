"""Candlestick patterns and trading signals as expressions over a bar and the bars before it."""

from __future__ import annotations

from tidebar.functions.windows import frame, lag, mean, num
from tidebar.operators.ta import Out, macd, rsi
from tidebar.plans.chain import Chain

TINY = "0.001e0"


class Bar:
    """Expressions of a bar some rows back."""

    def __init__(self, c: Chain, back: int):
        self.o, self.h, self.l, self.c = (x if not back else c.col(lag(x, back)) for x in "ohlc")
        self.up, self.down = f"({self.c} >= {self.o})", f"({self.c} < {self.o})"
        self.body, self.span = f"abs({self.c} - {self.o})", f"({self.h} - {self.l})"
        self.upper, self.lower = f"({self.h} - greatest({self.o}, {self.c}))", f"(least({self.o}, {self.c}) - {self.l})"
        self.middle = f"(({self.o} + {self.c}) / 2e0)"

    def share(self, x: str) -> str:
        return f"({x} / nullif({self.span}, 0e0))"

    @property
    def wide(self) -> str:
        return f"({self.span} >= {TINY})"

    @property
    def doji(self) -> str:
        return f"({self.span} < {TINY} or {self.share(self.body)} < 0.1e0)"

    @property
    def marubozu(self) -> str:
        return f"({self.wide} and ({self.share(self.body)} > 0.95e0 or ({self.share(self.upper)} < 0.03e0 and {self.share(self.lower)} < 0.03e0)))"


#: name -> (direction of the signal: 1 bullish, -1 bearish, 0 neither, None by the bar; strength or None where it is computed)
STRENGTH = {
    "doji": (0, None), "hammer": (1, None), "inverted_hammer": (1, 0.6), "shooting_star": (-1, 0.7), "marubozu": (None, 0.8), "spinning_top": (0, 0.5),
    "bullish_engulfing": (1, None), "bearish_engulfing": (-1, None), "bullish_harami": (1, 0.6), "bearish_harami": (-1, 0.6), "piercing_line": (1, 0.7), "dark_cloud_cover": (-1, 0.7),
    "tweezer_top": (-1, 0.6), "tweezer_bottom": (1, 0.6), "morning_star": (1, 0.8), "evening_star": (-1, 0.8), "three_white_soldiers": (1, 0.85), "three_black_crows": (-1, 0.85),
    "three_inside_up": (1, 0.75), "three_inside_down": (-1, 0.75),
}


def patterns(c: Chain) -> dict[str, str]:
    """A condition for each pattern; null where bars before are missing."""
    third, second, first = Bar(c, 0), Bar(c, 1), Bar(c, 2)
    a, b, d = first, second, third
    # Pairs are the bar before (b) and the bar itself (d).

    def harami(x: Bar, y: Bar, bull: bool) -> str:
        inside = f"{y.o} > {x.c} and {y.c} < {x.o}" if bull else f"{y.o} < {x.c} and {y.c} > {x.o}"
        return f"({x.down if bull else x.up} and {y.up if bull else y.down} and {inside} and {y.body} < {x.body})"

    def engulf(x: Bar, y: Bar, bull: bool) -> str:
        over = f"{y.o} < {x.c} and {y.c} > {x.o}" if bull else f"{y.o} > {x.c} and {y.c} < {x.o}"
        return f"({x.down if bull else x.up} and {y.up if bull else y.down} and {over})"

    even = f"0.02e0 * greatest({b.span}, {d.span})"
    small = f"not ({b.span} > 0 and {b.share(b.body)} > 0.3e0)"
    morning = f"({a.down} and {a.body} >= {a.span} * 0.3e0 and {small} and {d.up} and {d.body} >= {d.span} * 0.3e0 and {b.h} <= {a.c} and {d.c} > {a.middle})"
    evening = f"({a.up} and {a.body} >= {a.span} * 0.3e0 and {small} and {d.down} and {d.body} >= {d.span} * 0.3e0 and {b.l} >= {a.c} and {d.c} < {a.middle})"
    full = " and ".join(f"coalesce({x.share(x.body)} >= 0.6e0, true)" for x in (a, b, d))
    ratio = f"case when {d.lower} > {TINY} then {d.upper} / nullif({d.lower}, 0e0) else 0e0 end"
    hammer = f"({d.wide} and {d.lower} > 2e0 * {d.body} and {d.upper} < 0.5e0 * {d.body} and {d.share(d.lower)} > 0.6e0)"
    inverted = f"({d.wide} and {d.upper} > 2e0 * {d.body} and {d.lower} < 0.5e0 * {d.body} and {d.share(f'(greatest({d.o}, {d.c}) - {d.l})')} < 0.4e0)"
    thin = f"({d.wide} and {d.share(d.body)} < 0.1e0)"
    return {
        "doji": d.doji,
        "hammer": hammer,
        "inverted_hammer": inverted,
        "shooting_star": inverted,
        "marubozu": d.marubozu,
        "spinning_top": f"({d.wide} and {d.share(d.body)} < 0.3e0 and {ratio} > 0.5e0 and {ratio} < 2e0)",
        "bullish_engulfing": engulf(b, d, True),
        "bearish_engulfing": engulf(b, d, False),
        "bullish_harami": harami(b, d, True),
        "bearish_harami": harami(b, d, False),
        "piercing_line": f"({b.down} and {d.up} and {d.o} < {b.c} and {d.c} > {b.middle} and {d.c} < {b.o})",
        "dark_cloud_cover": f"({b.up} and {d.down} and {d.o} > {b.c} and {d.c} < {b.middle} and {d.c} > {b.o})",
        "tweezer_top": f"({b.up} and {d.down} and abs({b.h} - {d.h}) < {even})",
        "tweezer_bottom": f"({b.down} and {d.up} and abs({b.l} - {d.l}) < {even})",
        "morning_star": morning,
        "evening_star": evening,
        "three_white_soldiers": f"({a.up} and {b.up} and {d.up} and {full} and {b.o} between {a.o} and {a.c} and {d.o} between {b.o} and {b.c} and {d.c} > {b.c} and {b.c} > {a.c})",
        "three_black_crows": f"({a.down} and {b.down} and {d.down} and {full} and {b.o} between {a.c} and {a.o} and {d.o} between {b.c} and {b.o} and {d.c} < {b.c} and {b.c} < {a.c})",
        "three_inside_up": f"({harami(a, b, True)} and {d.up} and {d.c} > {a.o})",
        "three_inside_down": f"({harami(a, b, False)} and {d.down} and {d.c} < {a.o})",
        # Not part of the detector:
        "hanging_man": hammer,
        "dragonfly_doji": f"({thin} and {d.lower} > 0.6e0 * {d.span} and {d.upper} < 0.1e0 * {d.span})",
        "gravestone_doji": f"({thin} and {d.upper} > 0.6e0 * {d.span} and {d.lower} < 0.1e0 * {d.span})",
        "long_legged_doji": f"({thin} and {d.upper} > 0.3e0 * {d.span} and {d.lower} > 0.3e0 * {d.span})",
        "bullish_kicking": f"({b.marubozu} and {d.marubozu} and {b.down} and {d.up} and {d.o} > {b.o})",
        "bearish_kicking": f"({b.marubozu} and {d.marubozu} and {b.up} and {d.down} and {d.o} < {b.o})",
        "morning_doji_star": f"({b.doji} and {morning})",
        "evening_doji_star": f"({b.doji} and {evening})",
        "three_outside_up": f"({engulf(a, b, True)} and {d.up} and {d.c} > {b.c})",
        "three_outside_down": f"({engulf(a, b, False)} and {d.down} and {d.c} < {b.c})",
        "abandoned_baby_bullish": f"({a.down} and {b.doji} and {d.up} and {b.h} < {a.l} and {d.l} > {b.h})",
        "abandoned_baby_bearish": f"({a.up} and {b.doji} and {d.down} and {b.l} > {a.h} and {d.h} < {b.l})",
    }


def strengths(c: Chain) -> dict[str, str]:
    d, b = Bar(c, 0), Bar(c, 1)
    engulfing = f"case when {b.body} < {TINY} then 0.8e0 else least({d.body} / nullif({b.body}, 0e0) / 3e0, 1e0) end"
    own = {
        "doji": f"case when {d.span} < {TINY} then 1e0 else 1e0 - least({d.share(d.body)}, 1e0) end",
        "hammer": f"case when {d.body} < {TINY} then 0.7e0 else least({d.lower} / nullif({d.body}, 0e0) / 4e0, 1e0) end",
        "bullish_engulfing": engulfing,
        "bearish_engulfing": engulfing,
    }
    return {k: own[k] if s is None else num(s) for k, (_, s) in STRENGTH.items()}


#: Registered groups of patterns.
GROUPS = {
    "pt_doji": ["doji"], "pt_hammer": ["hammer", "hanging_man"], "pt_inv_hammer": ["inverted_hammer", "shooting_star"], "pt_marubozu": ["marubozu"], "pt_spinning_top": ["spinning_top"],
    "pt_doji_kinds": ["dragonfly_doji", "gravestone_doji", "long_legged_doji"], "pt_engulfing": ["bullish_engulfing", "bearish_engulfing"], "pt_harami": ["bullish_harami", "bearish_harami"],
    "pt_piercing": ["piercing_line", "dark_cloud_cover"], "pt_tweezer": ["tweezer_top", "tweezer_bottom"], "pt_kicking": ["bullish_kicking", "bearish_kicking"],
    "pt_star": ["morning_star", "evening_star", "morning_doji_star", "evening_doji_star"], "pt_three_line": ["three_white_soldiers", "three_black_crows"],
    "pt_three_in_out": ["three_inside_up", "three_inside_down", "three_outside_up", "three_outside_down"], "pt_abandoned": ["abandoned_baby_bullish", "abandoned_baby_bearish"],
}


def group(names: list[str]):
    def make(c: Chain) -> Out:
        found = patterns(c)
        return {n: f"coalesce({found[n]}, false)" for n in names}

    return make


def counts(c: Chain) -> Out:
    """How many patterns of the detector a bar shows, by direction, and their summed strength."""
    found, strong = patterns(c), strengths(c)
    hit = {k: c.col(f"case when coalesce({found[k]}, false) then 1e0 else 0e0 end") for k in STRENGTH}
    way = {k: "case when c >= o then 1e0 else -1e0 end" if s is None else num(s) for k, (s, _) in STRENGTH.items()}
    return {"n_patterns": " + ".join(hit.values()), "net_direction": " + ".join(f"{hit[k]} * {way[k]}" for k in hit), "strength": " + ".join(f"{hit[k]} * coalesce({strong[k]}, 0e0)" for k in hit)}


# Signals


def above(c: Chain, length: int = 20, bars: int = 3) -> Out:
    m = c.col(mean("c", length))
    yes, no = c.col(f"case when c > {m} then 1e0 else 0e0 end"), c.col(f"case when c < {m} then 1e0 else 0e0 end")
    return {"is_above": f"coalesce(c > {m}, false)", "is_below": f"coalesce(c < {m}, false)", "above_for": f"coalesce({frame(f'min({yes})', bars)} = 1 and i >= {bars - 1}, false)", "below_for": f"coalesce({frame(f'min({no})', bars)} = 1 and i >= {bars - 1}, false)"}


def slope(c: Chain, n: int = 5) -> Out:
    s = c.col(f"(c - {lag('c', n)}) / {num(n)}")
    return {"slope": s, "acceleration": f"{s} - {lag(s)}", "roc": f"c - {lag('c')}"}


def _price_and_rsi(c: Chain, lookback: int) -> dict[str, str]:
    """The lowest and highest close of the bars before, and the index there (of equals at the nearest bar)."""
    r = c.col(rsi(c, exact=True)["rsi"])
    low, high = frame("min(c)", lookback + 1, "1 preceding"), frame("max(c)", lookback + 1, "1 preceding")
    at = lambda extreme: "case " + " ".join(f"when {lag('c', j)} = {extreme} then {lag(r, j)}" for j in range(1, lookback + 1)) + " end"
    return {"r": r, "low": c.col(low), "high": c.col(high), "at_low": c.col(at(low)), "at_high": c.col(at(high))}


def divergence(c: Chain, lookback: int = 14) -> Out:
    """Against the extreme of the bars before: a lower low of price with a higher index, or the reverse."""
    p = _price_and_rsi(c, lookback)
    ready = f"i >= {lookback}"
    return {"bullish": f"coalesce({ready} and c <= {p['low']} and {p['r']} > {p['at_low']}, false)", "bearish": f"coalesce({ready} and c >= {p['high']} and {p['r']} < {p['at_high']}, false)"}


def hidden_divergence(c: Chain, lookback: int = 14) -> Out:
    p = _price_and_rsi(c, lookback)
    ready = f"i >= {lookback}"
    bull = f"coalesce({ready} and c > {p['low']} and {p['r']} < {p['at_low']}, false)"
    return {"bullish": bull, "bearish": f"coalesce({ready} and not {bull} and c < {p['high']} and {p['r']} > {p['at_high']}, false)"}


def crossed(c: Chain, x: str, level: float) -> tuple[str, str]:
    x = c.col(x)
    before = c.col(lag(x))
    return f"coalesce({before} <= {num(level)} and {x} > {num(level)}, false)", f"coalesce({before} >= {num(level)} and {x} < {num(level)}, false)"


def conditions(c: Chain) -> Out:
    r = c.col(rsi(c, exact=True)["rsi"])
    up, down = crossed(c, r, 50)
    return {"is_above": f"coalesce({r} > 70e0, false)", "is_below": f"coalesce({r} < 30e0, false)", "is_between": f"coalesce({r} between 40e0 and 60e0, false)", "crossed_above": up, "crossed_below": down, "rising": f"coalesce({r} > {lag(r)}, false)", "falling": f"coalesce({r} < {lag(r)}, false)"}


def vote(c: Chain, rules: list[tuple[str, str, float]], confirmations: int = 1, every: bool = False) -> Out:
    """Rules (buy condition, sell condition, weight) -> score of either side and the side that wins (1, -1, 0)."""
    one = lambda cond: c.col(f"case when {cond} then 1e0 else 0e0 end")
    marks = [(one(b), one(s), num(w)) for b, s, w in rules]
    buys, sells = " + ".join(b for b, _, _ in marks), " + ".join(s for _, s, _ in marks)
    buy, sell = c.col(" + ".join(f"{b} * {w}" for b, _, w in marks)), c.col(" + ".join(f"{s} * {w}" for _, s, w in marks))
    n = num(len(rules) if every else confirmations)
    side = f"case when {buys} >= {n}{'' if every else f' and {buy} > {sell}'} then 1e0 when {sells} >= {n}{'' if every else f' and {sell} > {buy}'} then -1e0 else 0e0 end"
    return {"buy": buy, "sell": sell, "side": side}


def presets(c: Chain) -> dict[str, tuple[str, str, float]]:
    r = crossed(c, rsi(c, exact=True)["rsi"], 30)[0], crossed(c, rsi(c, exact=True)["rsi"], 70)[1]
    a, b = mean("c", 9), mean("c", 21)
    ma = crossed(c, f"{a} - {b}", 0)
    hist = crossed(c, macd(c)["histogram"], 0)
    trend = c.col(f"c - {mean('c', 50)}")
    return {"rsi_extremes": (*r, 1.0), "ma_crossover": (*ma, 1.0), "macd_signal": (*hist, 1.0), "trend_filter": (f"coalesce({trend} > 0, false)", f"coalesce({trend} < 0, false)", 0.5)}


def ruleset(c: Chain) -> Out:
    return vote(c, list(presets(c).values()))


def preset_sides(c: Chain) -> Out:
    return {name: vote(c, [rule])["side"] for name, rule in presets(c).items()}


def signal_strength(c: Chain) -> Out:
    """The number of rules that agree as strength 1 to 4, and reward over risk of a stop and target of 2 and 3 ranges."""
    rules = presets(c)
    n = c.col(" + ".join(f"case when {b} then 1e0 else 0e0 end" for b, _, _ in rules.values()))
    risk = c.col(f"2e0 * ({frame('avg(h - l)', 14)})")
    return {"confluences": n, "strength": f"case when {n} >= 6 then 4e0 when {n} >= 4 then 3e0 when {n} >= 2 then 2e0 else 1e0 end", "risk_reward": f"3e0 * ({frame('avg(h - l)', 14)}) / nullif({risk}, 0e0)"}


def divergence_kinds(c: Chain) -> Out:
    """1 and -1 for a regular one of either side, 2 and -2 for a hidden one, 0 for none; and what the kind is."""
    plain, hidden = divergence(c), hidden_divergence(c)
    kind = c.col(f"case when {plain['bullish']} then 1e0 when {plain['bearish']} then -1e0 when {hidden['bullish']} then 2e0 when {hidden['bearish']} then -2e0 else 0e0 end")
    return {"kind": kind, "is_bullish": f"coalesce({kind} > 0, false)", "is_bearish": f"coalesce({kind} < 0, false)", "is_hidden": f"coalesce(abs({kind}) = 2, false)"}


def signal_types(c: Chain) -> Out:
    """What the rules' vote asks for: an entry on either side (1, -1), the exit that the other side's vote means, or nothing.

    `unanimous` needs every rule to vote for the same side.
    """
    rules = list(presets(c).values())
    side, every = c.col(vote(c, rules)["side"]), c.col(vote(c, rules[:2], every=True)["side"])
    held = c.col(f"coalesce({lag(side)}, 0e0)")
    leaves = f"{held} <> 0 and {side} = -{held}"
    return {"side": side, "is_entry": f"coalesce({side} <> 0, false)", "is_exit": f"coalesce({leaves}, false)", "is_none": f"coalesce({side} = 0, false)", "unanimous": every}


SIGNALS = {"x_div_type": divergence_kinds, "x_signal_type": signal_types, "sg_above": above, "sg_slope": slope, "sg_divergence": divergence, "sg_hidden_div": hidden_divergence, "sg_condition": conditions, "sg_ruleset": ruleset, "sg_presets": preset_sides, "sg_signal": signal_strength}
