"""Regimes and trend lines against loops in Python."""

import math
import random
from datetime import datetime, timedelta

import pytest

from tidebar.operators.structure import levels, liquidity, zones
from tidebar.operators.structure_queries import _entropies, _regimes
from tidebar.operators.waves import trendlines

START = datetime(2024, 1, 1)


def frame(spark, closes):
    rows = [("s", START + timedelta(hours=i), c, c + 0.1, c - 0.1, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double").repartition(1)


def brute_lempel(w):
    if len(w) < 100:
        return None
    middle = (sorted(w)[49] + sorted(w)[50]) / 2
    bits = "".join("1" if b - a > middle else "0" for a, b in zip(w, w[1:]))
    words, word = set(), ""
    n = 0
    for bit in bits:
        word += bit
        if word not in words:
            words.add(word)
            n, word = n + 1, ""
    n += bool(word)
    return min(1.0, n / (99 / math.log2(99)))


def brute_regime(s, z, p):
    if s is z is p is None:
        return "transitioning", 0.0
    s, z, p = (0.5 if x is None else x for x in (s, z, p))
    m = (s + z + p) / 3
    sure = max(0.0, 1 - 4 * sum((x - m) ** 2 for x in (s, z, p)) / 3)
    if s < 0.4 and z < 0.4 and p < 0.4:
        return "structured", sure
    if s > 0.7 and z > 0.7 and p > 0.7:
        return "random", sure
    if p < 0.5 and 0.4 < s < 0.8:
        return "trending", sure
    return ("ranging" if s > 0.6 and z < 0.5 else "transitioning"), sure


def test_regime_by_three_entropies(spark):
    r = random.Random(1)
    closes = [r.gauss(0, 1) for _ in range(260)] + [100 + r.random() for _ in range(200)] + [100.0] * 150
    bars = frame(spark, closes)
    parts = {x["ts"]: x for x in _entropies().apply(bars).collect()}
    got = {x["ts"]: x for x in _regimes(bars).collect()}
    assert len(got) == len(closes)
    for i in range(len(closes)):
        at = START + timedelta(hours=i)
        entropies = parts[at]["shannon"], brute_lempel(closes[max(0, i - 99) : i + 1]), parts[at]["permutation"]
        name, sure = brute_regime(*entropies)
        assert got[at]["regime"] == name and got[at]["confidence"] == pytest.approx(sure, abs=1e-6)
    assert "random" in {x["regime"] for x in got.values()}


def test_levels_against_a_loop(spark):
    r = random.Random(3)
    closes = [100 + 3 * math.sin(i / 7) + r.uniform(-1, 1) for i in range(700)]
    mean, found = sum(closes) / len(closes), []
    for i in range(2, len(closes) - 2):
        around = closes[i - 2 : i] + closes[i + 1 : i + 3]
        for kind, hit, price in (("resistance", closes[i] > max(around), closes[i] + 0.1), ("support", closes[i] < min(around), closes[i] - 0.1)):
            if hit:
                for level in found:
                    if (away := abs(price - level[0]) / mean) < 0.002:
                        level[1] += 1
                        level[3] = i
                        level[5] += 1 / (1 + 100 * away)
                        break
                else:
                    found.append([price, 1, i, i, kind, 1.0])
    best = sorted((x for x in found if x[1] >= 2), key=lambda x: -x[5])[:10]
    hour = lambda t: round((t - START).total_seconds() / 3600)
    got = sorted(((x["price"], x["touches"], hour(x["first_touch"]), hour(x["last_touch"]), x["kind"], x["strength"]) for x in levels(frame(spark, closes)).collect()), key=lambda x: -x[5])
    assert len(got) == 10 and [x[1:5] for x in got] == [tuple(x[1:5]) for x in best]
    assert [x[5] for x in got] == pytest.approx([x[5] for x in best]) and [x[0] for x in got] == pytest.approx([x[0] for x in best])
    assert levels(frame(spark, closes[:9])).count() == 0


def test_zones_against_a_loop(spark):
    r = random.Random(5)
    closes = [100 + r.choice([0, 1, 2]) * 0.05 + 2 * math.sin(i / 5) for i in range(500)]
    bars = frame(spark, closes)
    single = sorted(((x["kind"], x["price"], x["ts"], x["touches"], x["strength"]) for x in liquidity(bars, reach=2).collect()))
    expected = []
    for kind, price, _, touches, strength in single:
        if expected and expected[-1][0] == kind and (price - expected[-1][1]) / expected[-1][1] < 0.002:
            last = expected[-1]
            last[2:] = [max(last[2], touches), max(last[3], strength), last[4] + 1]
        else:
            expected.append([kind, price, touches, strength, 1])
    got = sorted([x["kind"], x["level"], x["touches"], x["strength"], x["n_levels"]] for x in zones(bars, reach=2).collect())
    assert got == expected and any(x[4] > 1 for x in got)


def test_trendlines_use_all_swings(spark):
    closes = [100 + (i % 6 - 3 if i % 6 < 3 else 3 - i % 6) * 0.5 + random.Random(i).random() for i in range(420)]
    closes[40:340] = [c + 30 * math.sin(i) for i, c in enumerate(closes[40:340])]
    highs, lows = [], []
    for i in range(2, len(closes) - 2):
        around = closes[i - 2 : i] + closes[i + 1 : i + 3]
        if closes[i] >= max(around):
            highs.append((i, closes[i] + 0.1))
        if closes[i] <= min(around):
            lows.append((i, closes[i] - 0.1))
    assert min(len(highs), len(lows)) > 60
    mean, lines = sum(closes) / len(closes), []
    for kind, points in (("high", highs), ("low", lows)):
        for i, (x, y) in enumerate(points):
            for u, v in points[i + 1 :]:
                slope = (v - y) / (u - x)
                if slope < -0.01 if kind == "low" else slope > 0.01:
                    continue
                away = [0.0 if p in (x, u) else abs(q - y - slope * (p - x)) / mean for p, q in points]
                away = [d for d in away if d < 0.01]
                if len(away) >= 3:
                    lines.append((-len(away) / (1 + 10 * sum(away)), kind, x, u, len(away)))
    best = sorted(lines)[:6]
    bars = frame(spark, closes)
    for block in (256, 7):
        hour = lambda t: round((t - START).total_seconds() / 3600)
        got = sorted((-x["strength"], x["kind"], hour(x["start"]), hour(x["end"]), x["touches"]) for x in trendlines(bars, block=block).collect())
        assert [x[1:] for x in got] == [x[1:] for x in best]
        assert [x[0] for x in got] == pytest.approx([x[0] for x in best])
