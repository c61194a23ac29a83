"""What goes on where it stopped: chains, stored values, indicators over streams, feeds of tables; rollups and windows of trades."""

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidebar.operators.rollup import rolled_up, summaries, with_estimates
from tidebar.operators.ta import TA
from tidebar.operators.waiting import WAITING
from tidebar.plans.chain import Chain, distances
from tidebar.sources import tables
from tidebar.streaming import incremental
from tidebar.streaming.bars import session_bars, sliding_bars, stream_bars

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, o double, h double, l double, c double, v double, n long"


def some_bars(seed=3, lengths=(("A", 160), ("B", 90), ("C", 7))):
    r, rows = random.Random(seed), []
    for symbol, n in lengths:
        price = 100.0
        for k in range(n):
            o = price
            price = c = o + r.choice([-1, 1, 0.5, -0.5, 0, 2])
            h, low = (o, o) if r.random() < 0.05 else (max(o, c) + r.random(), min(o, c) - r.random())
            rows.append((symbol, START + dt.timedelta(hours=k), o, h, low, c, float(r.randrange(0, 50)), 1))
    return rows


def chain_of(*names):
    """Several indicators as one chain: names of the batch family, or of the streaming family after `s_`."""
    chain = Chain()
    for name in names:
        made = WAITING[name[2:]](chain) if name.startswith("s_") else TA[name](chain)
        chain.out |= {f"{name}_{k}": e for k, e in made.items()}
    return chain


def near(a, b):
    if a is None or b is None or isinstance(a, (bool, str)):
        return a == b
    return a == b or abs(a - b) <= 1e-8 * max(1, abs(a), abs(b))


def same(got, expected, chain):
    got, expected = ({(r["symbol"], r["ts"]): r for r in x.collect()} for x in (got, expected))
    assert got.keys() == expected.keys()
    wrong = [(k, o, got[k][o], expected[k][o]) for k in got for o in chain.out if not near(got[k][o], expected[k][o])]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("names", [("sma", "tsi", "obv", "vwap", "bars_since_cross"), ("psar", "nvi", "s_fisher", "jma"), ("s_macd", "s_adx", "s_aroon", "s_supertrend")])
def test_resumed_chain_equals_one_run(spark, names):
    chain, rows = chain_of(*names), some_bars()
    bars = spark.createDataFrame(rows, SCHEMA)
    cuts = {"A": [0, 30, 31, 160], "B": [0, 0, 60, 90], "C": [0, 3, 7, 7]}
    number, seen = {}, defaultdict(int)
    for r in rows:
        number[r[:2]] = seen[r[0]]
        seen[r[0]] += 1
    last, parts = [], []
    for j in range(3):
        some = [r for r in rows if cuts[r[0]][j] <= number[r[:2]] < cuts[r[0]][j + 1]]
        before = spark.createDataFrame(last, schema) if last else None  # noqa: F821
        out = chain.resume(before, spark.createDataFrame(some, SCHEMA))
        schema = out.drop(*chain.out).schema
        found = out.collect()
        parts += [r.asDict() for r in found]
        by_symbol = defaultdict(list)
        for r in last + [tuple(r[c] for c in schema.names) for r in found]:
            by_symbol[r[0]].append(r)
        last = [r for mine in by_symbol.values() for r in sorted(mine, key=lambda r: r[1])[-chain.tail() :]]
    expected = {(r["symbol"], r["ts"]): r for r in chain.apply(bars).collect()}
    assert len(parts) == len(expected)
    wrong = [(o, p["ts"], p[o], expected[p["symbol"], p["ts"]][o]) for p in parts for o in chain.out if not near(p[o], expected[p["symbol"], p["ts"]][o])]
    assert not wrong, wrong[:3]


def test_what_cannot_go_on_says_so(spark):
    assert distances("lag", "lag(abs(c - (o)), 5) over (w) + lag(x) over (w) - lag(coalesce(a, 3)) over (w)") == [5, 1, 1]
    for name in ("s_klinger",):
        with pytest.raises(ValueError):
            chain_of(name).tail()
    chain = Chain()
    chain.out = {"next": "lead(c, 2) over (partition by symbol order by ts)"}
    with pytest.raises(ValueError):
        chain.resume(None, spark.createDataFrame(some_bars(), SCHEMA))
    assert chain_of("sma").tail() == 19 and chain_of("ema").tail() == 21


def test_kept_up_values_through_ten_appends(spark, tmp_path):
    """Late bars, corrected ones, new symbols, a version that runs again; what is read follows what is new."""
    chain, bars, path = chain_of("ema", "s_rsi", "obv"), str(tmp_path / "bars"), str(tmp_path / "values")
    rows, r = some_bars(5, (("A", 80), ("B", 60))), random.Random(2)
    late = [x for x in rows if r.random() < 0.1]
    kept = [x for x in rows if x not in late]
    appends = [[x for x in kept if x[1].day == d + 1 and x[0] == "A"] for d in range(4)] + [[x for x in kept if x[0] == "B"]]
    appends += [late[: len(late) // 2], late[len(late) // 2 :], [(*rows[40][:5], rows[40][5] + 3.0, *rows[40][6:])], [(*rows[0][:5], rows[0][5] - 2.0, *rows[0][6:])], [("N", START, 1.0, 2.0, 0.5, 1.5, 3.0, 1)]]
    for version, some in enumerate(appends, 1):
        tables.append(spark.createDataFrame(some, SCHEMA), bars, version)
        assert incremental.keep_up(spark, chain, bars, path) == version == incremental.keep_up(spark, chain, bars, path)
    same(incremental.values(spark, path, chain), chain.apply(tables.current(spark, bars)), chain)
    # A bar at the end takes one row: only it is written, and only its own version of the bars is read.
    tables.append(spark.createDataFrame([("A", START + dt.timedelta(days=30), 1.0, 2.0, 0.5, 1.5, 3.0, 1)], SCHEMA), bars, 11)
    assert all("/version=11/" in f for f in tables.changes(spark, bars, 10).inputFiles())
    incremental.keep_up(spark, chain, bars, path)
    assert spark.read.parquet(f"{path}/values/version=11").count() == 1
    # The last correction went back to the first bar of one symbol and left the other alone.
    assert {x["symbol"] for x in spark.read.parquet(f"{path}/values/version=9").select("symbol").distinct().collect()} == {"A"}
    incremental.advance(chain, spark.createDataFrame([], SCHEMA), path, 12)
    assert not (tmp_path / "values" / "heads" / "version=12").exists()
    with pytest.raises(ValueError):
        incremental.advance(chain, spark.createDataFrame([rows[3]], SCHEMA), path, 13)


def test_batches_that_run_again_and_gaps(spark, tmp_path):
    chain, bars, path = chain_of("s_ema"), str(tmp_path / "bars"), str(tmp_path / "values")
    rows = some_bars(7, (("A", 60), ("B", 40)))
    holes = {("A", 20), ("A", 21), ("A", 35), ("B", 10), ("A", 40)}
    hour = lambda x: int((x[1] - START).total_seconds() // 3600)
    history = [(*x[:5], x[5], *x[6:]) for x in rows if (x[0], hour(x)) != ("A", 40)]  # one bar is lost for good
    live = [x for x in rows if (x[0], hour(x)) not in holes]
    sink = incremental.indicator_sink(chain, bars, path, incremental.from_history(spark.createDataFrame(history, SCHEMA), span=86400))
    for epoch, (a, b) in enumerate([(0, 15), (15, 38), (38, 60)]):
        batch = spark.createDataFrame([x for x in live if a <= hour(x) < b], SCHEMA)
        sink(batch, epoch)
        sink(batch, epoch)
    expected = spark.createDataFrame(history, SCHEMA)
    same(incremental.values(spark, path, chain), chain.apply(expected), chain)
    # The stream's own bar, when it comes late, counts over the one that was filled in.
    own = (*rows[20][:5], rows[20][5] + 1.0, *rows[20][6:])
    sink(spark.createDataFrame([own], SCHEMA), 3)
    changed = [own if (x[0], x[1]) == own[:2] else x for x in history]
    same(incremental.values(spark, path, chain), chain.apply(spark.createDataFrame(changed, SCHEMA)), chain)


def test_streamed_indicator_over_late_trades(spark, tmp_path):
    r = random.Random(9)
    trades = [("A", START + dt.timedelta(seconds=r.randrange(60 * 3600)), k, 50 + r.random(), 1.0) for k in range(700)]
    schema = "symbol string, ts timestamp, id long, price double, size double"
    folder = str(tmp_path / "trades")
    for part in range(3):
        mine = [t for t in trades if min(2, (t[1] - START).days + (t[2] % 5 == 0)) == part]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(folder)
    chain, path = chain_of("s_macd", "s_obv"), str(tmp_path / "values")
    stream = stream_bars(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), late="30 days")
    stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).foreachBatch(incremental.indicator_sink(chain, str(tmp_path / "bars"), path)).start().awaitTermination()
    from tidebar.sources.candles import bars

    same(incremental.values(spark, path, chain), chain.apply(bars(spark.createDataFrame(trades, schema), volume="size")), chain)


def test_snapshot_and_feed_equal_the_table_after_each_append(spark, tmp_path):
    path, r = str(tmp_path / "t"), random.Random(4)
    rows = some_bars(6, (("A", 40), ("B", 40)))
    tables.append(spark.createDataFrame(rows[:30], SCHEMA), path, 0)
    had, seen = tables.current(spark, path).collect(), 0
    for version in range(1, 11):
        some = r.sample(rows, 12)
        tables.append(spark.createDataFrame([(*x[:5], x[5] + version, *x[6:]) for x in some], SCHEMA), path, version)
        if version in (4, 8):
            assert tables.compact(spark, path) == version
        if version == 9:
            assert tables.vacuum(spark, path) and not (tmp_path / "t" / "version=3").exists()
        feed = tables.changes(spark, path, seen)
        assert feed.count() <= 12 * (version - seen)
        now = tables.current(spark, path)
        merged = tables.merged(spark.createDataFrame(had, now.schema), feed)
        as_set = lambda df: {tuple(x[c] for c in now.columns) for x in df.collect()}
        assert as_set(merged) == as_set(now)
        if version % 2:
            had, seen = merged.collect(), version
    assert tables.latest_version(spark, path) == 10 and tables.latest_version(spark, str(tmp_path / "none")) is None
    assert tables.changes(spark, path, 10).count() == 0
    with pytest.raises(ValueError):
        tables.current(spark, str(tmp_path / "none"))


def test_rollup_sketches_are_within_their_error(spark):
    r = random.Random(12)
    trades = [(r.choice("XY"), START + dt.timedelta(seconds=r.randrange(40 * 86400)), k, r.gauss(100, 15), 1.0, int(3000 * r.random() ** 2)) for k in range(30000)]
    df = spark.createDataFrame(trades, "symbol string, ts timestamp, id long, price double, size double, who long")
    found = {(x["symbol"], x["level"], x["ts"]): x for x in with_estimates(rolled_up(summaries(df))).where("level in ('month', 'day')").collect()}
    exact = defaultdict(list)
    for t in trades:
        day = t[1].replace(hour=0, minute=0, second=0)
        exact[t[0], "day", day].append(t)
        exact[t[0], "month", day.replace(day=1)].append(t)
    assert found.keys() == exact.keys()
    for key, mine in exact.items():
        prices, x = sorted(t[3] for t in mine), found[key]
        assert (x["n"], x["h"], x["l"]) == (len(mine), prices[-1], prices[0])
        assert x["c"] == max(mine, key=lambda t: (t[1], t[2]))[3] and x["o"] == min(mine, key=lambda t: (t[1], t[2]))[3]
        for share, name in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95")):
            rank = sum(p <= x[name] for p in prices) / len(prices)
            assert abs(rank - share) < 0.03 + 1 / len(prices)
        who = len({t[5] for t in mine})
        assert abs(x["n_traders"] - who) <= max(2, 0.06 * who)


def test_sessions_and_sliding_windows(spark, tmp_path):
    r = random.Random(13)
    trades = [(r.choice("XY"), START + dt.timedelta(seconds=r.randrange(3 * 86400)), k, float(r.randrange(90, 110)), 1.0) for k in range(400)]
    schema = "symbol string, ts timestamp, id long, price double, size double"
    df = spark.createDataFrame(trades, schema)
    expected = set()
    for s in "XY":
        mine, burst = sorted((t for t in trades if t[0] == s), key=lambda t: (t[1], t[2])), []
        for t in [*mine, None]:
            if burst and (t is None or t[1] - burst[-1][1] >= dt.timedelta(minutes=20)):
                p = [x[3] for x in burst]
                expected.add((s, burst[0][1], burst[-1][1] + dt.timedelta(minutes=20), p[0], max(p), min(p), p[-1], float(len(p)), len(p)))
                burst = []
            burst.append(t)
    assert {tuple(x) for x in session_bars(df).collect()} == expected
    slides = defaultdict(list)
    for t in trades:
        first = dt.datetime(t[1].year, t[1].month, t[1].day, t[1].hour) + dt.timedelta(minutes=t[1].minute // 15 * 15)
        for k in range(4):
            slides[t[0], first - k * dt.timedelta(minutes=15)].append(t)
    got = {(x["symbol"], x["ts"]): x for x in sliding_bars(df).collect()}
    assert got.keys() == slides.keys()
    assert all(got[k]["n"] == len(v) and got[k]["h"] == max(t[3] for t in v) and got[k]["c"] == max(v, key=lambda t: (t[1], t[2]))[3] for k, v in slides.items())
    # As a stream, a last trade far ahead closes all sessions.
    path = str(tmp_path / "s")
    spark.createDataFrame([*trades], schema).coalesce(1).write.parquet(path)
    spark.createDataFrame([("Z", START + dt.timedelta(days=9), 999, 1.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = session_bars(stream, late="4 days").writeStream.format("memory").queryName("closed").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(x) for x in spark.table("closed").where("symbol <> 'Z'").collect()} == expected
