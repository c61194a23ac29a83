import math
import random
from datetime import datetime, timedelta

import pytest

from tidebar.operators import backtest, reports
from tidebar.operators.research import sma_cross_trades


@pytest.fixture(scope="module")
def bars(spark):
    r, rows = random.Random(8), []
    for s in "ab":
        p = 100.0
        for i in range(300):
            o, p = p, max(1.0, p + r.uniform(-4, 4))
            rows.append((s, datetime(2024, 1, 1) + timedelta(hours=i), o, max(o, p) + 1, min(o, p) - 1, p, 50.0))
    return spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double")


def loop(bars, fast, slow, capital=10_000.0):
    """The run as a loop over bars: decide at a close, hand the order on at the next bar, fill at the open after that."""
    closes, trades, curve, held, ordered, filling, before = [], [], [], None, [], [], None
    realised = 0.0
    for i, x in enumerate(bars):
        for side in filling:
            if side > 0 and held is None:
                held = (x["ts"], x["o"])
            elif side < 0 and held is not None:
                trades.append((*held, x["ts"], x["o"], x["o"] - held[1]))
                realised += trades[-1][-1]
                held = None
        filling, ordered = ordered, []
        closes.append(x["c"])
        side = None
        if len(closes) >= slow:
            side = sum(closes[-fast:]) / fast - sum(closes[-slow:]) / slow
            if before is not None and side > 0 >= before:
                ordered.append(1)
            elif before is not None and side < 0 <= before:
                ordered.append(-1)
            before = side
        curve.append((x["ts"], capital + realised + (x["c"] - held[1] if held else 0.0)))
    if held:
        trades.append((*held, bars[-1]["ts"], bars[-1]["c"], bars[-1]["c"] - held[1]))
    return trades, curve


def test_run_and_metrics_against_a_loop(spark, bars):
    trades = sma_cross_trades(bars, 5, 12)
    curve = reports.equity_curve(bars, trades)
    found = {r["symbol"]: r for r in reports.performance(curve, trades, rate=0.0, commission=0.001).collect()}
    for s in "ab":
        rows = bars.where(f"symbol = '{s}'").orderBy("ts").collect()
        expected, equity = loop(rows, 5, 12)
        got = [(r["entry_at"], r["entry"], r["exit_at"], r["exit"]) for r in trades.where(f"symbol = '{s}'").orderBy("entry_at").collect()]
        assert got == [x[:4] for x in expected] and len(got) > 5
        line = [r["equity"] for r in curve.where(f"symbol = '{s}'").orderBy("ts").collect()]
        assert line == pytest.approx([x for _, x in equity])
        m, pnl = found[s], [x[4] for x in expected]
        peak, worst, start, longest = 10_000.0, (0.0, 0.0), None, 0
        for ts, x in equity:
            if x > peak:
                peak, start, longest = x, None, max(longest, (ts - start).total_seconds() if start else 0)
            else:
                worst = max(worst, (peak - x, (peak - x) / peak * 100), key=lambda w: w[0])
                start = start or ts
        assert (m["max_drawdown"], m["max_drawdown_pct"], m["max_drawdown_s"]) == (pytest.approx(worst[0]), pytest.approx(worst[1]), longest)
        rets = [b / a - 1 for a, b in zip(line, line[1:])]
        mean = sum(rets) / len(rets)
        assert m["volatility"] == pytest.approx(math.sqrt(sum((r - mean) ** 2 for r in rets) / len(rets) * 252))
        down = [r * r for r in rets if r < 0]
        yearly = (line[-1] / 10_000) ** (365 / (299 / 24)) - 1
        assert m["annual_pct"] == pytest.approx(yearly * 100) and m["sharpe"] == pytest.approx(yearly / m["volatility"])
        assert m["sortino"] == pytest.approx(yearly / math.sqrt(sum(down) / len(down) * 252)) and m["calmar"] == pytest.approx(yearly * 100 / worst[1])
        assert (m["n_trades"], m["n_won"], m["n_lost"]) == (len(pnl), sum(x > 0 for x in pnl), sum(x < 0 for x in pnl))
        assert m["profit_factor"] == pytest.approx(sum(x for x in pnl if x > 0) / -sum(x for x in pnl if x < 0))
        assert m["time_in_market_pct"] == pytest.approx(sum((x[2] - x[0]).total_seconds() for x in expected) / (299 * 3600) * 100)
        runs = "".join("w" if x > 0 else "l" for x in pnl)
        assert m["longest_wins"] == max(map(len, runs.split("l"))) and m["longest_losses"] == max(map(len, runs.split("w")))


def test_metrics_without_trades(spark, bars):
    none = sma_cross_trades(bars, 5, 12).where("false")
    rows = reports.performance(reports.equity_curve(bars, none), none).collect()
    assert len(rows) == 2 and all(r["n_trades"] == 0 and r["max_drawdown"] == 0 and r["sharpe"] == 0 and r["final_equity"] == 10_000 for r in rows)


def test_fill_models(spark, bars):
    rows = [(r["symbol"], r["ts"], r["c"]) for r in bars.where("symbol = 'a'").orderBy("ts").limit(40).collect()]
    orders = spark.createDataFrame([(s, t, k % 2 == 0, backtest.KINDS[k % 5], c - 1.0, c + 1.0, 20.0) for k, (s, t, c) in enumerate(rows)], "symbol string, ts timestamp, buy boolean, kind string, limit double, stop double, quantity double")
    b = {r["ts"]: r for r in bars.where("symbol = 'a'").collect()}
    hour = timedelta(hours=1)
    for model in backtest.MODELS:
        for r in backtest.fills(orders, bars, model).collect():
            bar, after = b[r["ts"] + hour], b[r["ts"] + 2 * hour]
            if model == "next_open":
                assert r["price"] == after["o"] and r["filled_at"] == after["ts"]
            elif model == "close":
                assert r["price"] == bar["c"]
            elif model == "instant" and r["kind"] == "take_profit":
                assert r["price"] == r["limit"] and (bar["l"] <= r["limit"] if r["buy"] else bar["h"] >= r["limit"])
            elif model == "realistic":
                assert r["filled"] == 5.0 and r["commission"] > 0
    assert backtest.fills(orders, bars, "next_open").count() == 40


def test_targets_against_a_walk_over_bars(spark):
    """Long, short, doubled and flat positions, costs, targets at the last bars and for bars that aren't there."""
    import random
    from datetime import datetime, timedelta

    from pyspark.sql import functions as F

    from tidebar.operators.reports import target_curve

    r = random.Random(21)
    start = datetime(2024, 1, 1)
    bars, wanted, expected = [], [], {}
    for symbol, n in (("A", 60), ("B", 3), ("C", 1)):
        rows = [(symbol, start + timedelta(hours=k), 50 + 10 * r.random(), 50 + 10 * r.random()) for k in range(n)]
        targets = {k: r.choice([2.0, -1.0, 0.0, 5.0, None]) for k in range(n) if r.random() < 0.4}
        bars += rows
        wanted += [(symbol, rows[k][1], t) for k, t in targets.items()] + [(symbol, start - timedelta(days=1), 9.0)]
        position, cash, queue = 0.0, 10_000.0, []
        want = 0.0
        for k, (_, ts, o, c) in enumerate(rows):
            now = queue[k - 2] if k >= 2 else 0.0
            traded = now - position
            cash -= traded * o + 0.01 * abs(traded) * o
            position = now
            want = want if targets.get(k) is None else targets[k]
            queue.append(want)
            expected[symbol, ts] = (position, traded, cash, cash + position * c)
    df = spark.createDataFrame(bars, "symbol string, ts timestamp, o double, c double")
    got = target_curve(df, spark.createDataFrame(wanted, "symbol string, ts timestamp, target double"), commission=0.01)
    found = {(x["symbol"], x["ts"]): (x["position"], x["traded"], x["cash"], x["equity"]) for x in got.collect()}
    assert found.keys() == expected.keys() and all(abs(a - b) < 1e-8 for k in found for a, b in zip(found[k], expected[k]))
    assert got.where(F.col("position") < 0).count() and got.where(F.col("position") == 5).count()


def test_a_thousand_pairs_in_one_plan(spark):
    """The sweep equals the rule run pair by pair, and exchanges bars once however many pairs there are."""
    import random
    from datetime import datetime, timedelta

    from tidebar.operators.research import sma_cross_trades, sweep, trade_metrics

    r, price, rows = random.Random(31), 100.0, []
    for k in range(400):
        o, price = price, price + r.choice([-1.0, 1.0, 0.5, -0.5])
        rows.append(("AB"[k % 2], datetime(2024, 1, 1) + timedelta(hours=k // 2), o, max(o, price), min(o, price), price, 1.0, 1))
    bars = spark.createDataFrame(rows, "symbol string, ts timestamp, o double, h double, l double, c double, v double, n long")
    pairs = tuple((a, z) for a in range(3, 28) for z in range(28, 68))
    found = {(x["symbol"], x["fast"], x["slow"]): x for x in sweep(bars, pairs).collect()}
    assert len(pairs) == 1000 and {k[1:] for k in found} <= set(pairs)
    for a, z in ((3, 28), (9, 41), (27, 67)):
        for x in trade_metrics(sma_cross_trades(bars, a, z)).collect():
            assert all(abs(x[n] - found[x["symbol"], a, z][n]) < 1e-9 for n in x.asDict() if n != "symbol")
        assert {k[0] for k in found if k[1:] == (a, z)} == {x["symbol"] for x in sma_cross_trades(bars, a, z).select("symbol").distinct().collect()}
    plan = sweep(bars, pairs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") <= 3
