"""Indicators against plain loops on small series, and against the oracle SQL on the smallest tables."""

import math
import os
import random
from datetime import datetime, timedelta

import pytest

import __spark_entry__
from tidebar.operators.ta import TA
from tidebar.operators.waiting import WAITING
from tidebar.plans.chain import Chain

SF = "/root/testdata/sf0.001"


def series(kind, n, seed=1):
    r, out, p = random.Random(seed), [], 100.0
    for i in range(n):
        o = p
        p = 50.0 if kind == "flat" else max(1.0, p + r.uniform(-3, 3))
        h, l = (50.0, 50.0) if kind == "flat" else (max(o, p) + r.random(), min(o, p) - r.random())  # noqa: E741
        out.append((50.0 if kind == "flat" else o, h, l, p, 0.0 if kind == "flat" else r.uniform(1, 9)))
    return out


def run(spark, make, data, **params):
    """data: symbol -> rows; the result by symbol in order of time."""
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(hours=i), *x) for s, xs in data.items() for i, x in enumerate(xs)]
    random.Random(0).shuffle(rows)
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    chain = Chain()
    chain.out = make(chain, **params)
    found = {s: [] for s in data}
    for r in sorted(chain.apply(bars).collect(), key=lambda r: r["ts"]):
        found[r["symbol"]].append(tuple(r[n] for n in chain.out))
    return found


def loop_ema(xs, n, k=None):
    k, out, y = k or 2 / (n + 1), [], None
    for i, x in enumerate(xs):
        y = None if i < n - 1 else sum(xs[:n]) / n if i == n - 1 else k * x + (1 - k) * y
        out.append(y)
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


DATA = {"a": series("walk", 120), "b": series("walk", 7, 2), "flat": series("flat", 40), "one": series("walk", 1)}


@pytest.mark.parametrize("length", [1, 2, 9, 21])
def test_ema_and_rma_equal_the_loop(spark, length):
    for name, k in (("ema", 2 / (length + 1)), ("rma", 1 / length)):
        got = run(spark, TA[name], DATA, length=length)
        for s, rows in DATA.items():
            assert all(close(x[0], y) for x, y in zip(got[s], loop_ema([r[3] for r in rows], length, k))), (name, s)


def test_ema_over_many_blocks(spark):
    rows = series("walk", 3000)
    got = run(spark, TA["ema"], {"a": rows}, length=2)  # a block has some 160 rows
    assert all(close(x[0], y) for x, y in zip(got["a"], loop_ema([r[3] for r in rows], 2)))


def test_rsi_families_differ_as_documented(spark):
    batch, live = run(spark, TA["rsi"], DATA, length=14), run(spark, WAITING["rsi"], DATA, length=14)
    assert batch["a"][12][0] is None and batch["a"][13][0] is not None
    assert live["a"][13][0] is None and live["a"][14][0] is not None
    assert math.isclose(batch["flat"][20][0], 100 - 100 / 101) and live["flat"][20][0] == 100.0
    assert all(x[0] is None or 0 <= x[0] <= 100 for x in batch["a"])


def test_macd_sees_zeros_before_it_is_ready(spark):
    c = [r[3] for r in DATA["a"]]
    line = [None if b is None else a - b for a, b in zip(loop_ema(c, 12), loop_ema(c, 26))]
    signal = loop_ema([x or 0.0 for x in line], 9)
    for got, m, s in zip(run(spark, TA["macd"], DATA)["a"], line, signal):
        assert close(got[0], m) and close(got[1], s)
    ready = loop_ema([x for x in line if x is not None], 9)
    live = [x[1] for x in run(spark, WAITING["macd"], DATA)["a"]]
    assert all(close(x, y) for x, y in zip(live, [None] * 25 + ready))


def test_bands_hold_and_flat_series_have_no_width(spark):
    got = run(spark, TA["bb"], DATA)
    assert all(m is None or lo <= m <= up for m, up, lo in got["a"])
    assert got["flat"][30] == (50.0, 50.0, 50.0) and got["b"][-1] == (None, None, None)


def test_supertrend_and_psar_stay_on_their_side(spark):
    live = run(spark, WAITING["supertrend"], DATA)["a"]
    assert all(t is None or t in (1.0, -1.0) for _, t, *_ in live) and {t for _, t, *_ in live} >= {1.0, -1.0}
    assert all(t is None or math.isclose(s, low if t > 0 else up) for s, t, up, low, *_ in live)


def test_every_indicator_survives_short_flat_and_empty_series(spark):
    for name, f in [*TA.items(), *WAITING.items()]:
        chain = Chain()
        chain.out = f(chain)
        assert chain.sql("select 1").startswith("with recursive"), name
    empty = spark.createDataFrame([], "symbol string, ts timestamp, o double, h double, l double, c double, v double")
    for name in ("sma", "ema", "adx", "supertrend"):
        chain = Chain()
        chain.out = TA[name](chain)
        assert chain.apply(empty).count() == 0


KEYS = "ta_sma ta_t3 ta_kama ta_psar ta_zigzag ta_aroon rsi woodies_cci s_adx s_klinger s_aroon s_mcclellan tb_resample tb_gap_detect x_cdl_ctor flt_as_of sink_upsert src_infer_tf pt_detect sg_hidden_div rk_optimal_f smc_structure bt_equity pf_max_dd".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("key", KEYS)
def test_queries_equal_their_oracle(spark, key):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("events", "orders", "customer", "nation"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = __spark_entry__.queries()[key](spark, SF)
    names = sorted(got.columns)
    found = con.execute(f"select {', '.join(names)} from ({__spark_entry__.oracle_sql()[key]})").fetchall()
    plain = lambda row: repr(tuple(float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in row))
    assert sorted(map(plain, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(plain, found))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
