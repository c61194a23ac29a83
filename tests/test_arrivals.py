"""Arriving parts as several files each: a batch takes a part, no task more than a file's share, and the values stay."""

import datetime as dt
from collections import defaultdict

from tidebar.streaming import queries
from tidebar.streaming.bars import sliding_bars

START = dt.datetime(2024, 1, 1)


def test_parts_of_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries, "ROWS", 100)
    rows = [("AB"[k % 2], START + dt.timedelta(seconds=60 * (k // 3)), k, float(k * 7 % 31), 1.0) for k in range(900)]
    trades = spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double, size double").coalesce(1)
    path, files = queries._arriving(spark, str(tmp_path), trades, "id")
    assert files == 3
    written = spark.read.parquet(path)
    assert len(written.inputFiles()) == 9 and written.count() == 900
    seen = []
    queries._run(queries._arrivals(spark, path, files), lambda batch, epoch: seen.append(sorted(r["id"] for r in batch.collect())), str(tmp_path / "run"))
    part = {k: min(k // 3 // 100 + (k % 5 == 0), 2) for k in range(900)}
    assert seen == [[k for k in range(900) if part[k] == p] for p in range(3)]


def test_ties_of_time_go_by_id_and_nothing_is_sorted(spark):
    rows = [("A", START, k, float(v), 1.0) for k, v in ((-5, 1), (9, 2), (None, 3), (1 << 62, 4), (0, 5))] + [("A", START - dt.timedelta(microseconds=1), 1 << 62, 6.0, 1.0)]
    out = sliding_bars(spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double, size double"))
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    ends = defaultdict(set)
    for r in out.collect():
        ends[r["n"]].add((r["o"], r["c"]))
    assert ends == {5: {(3.0, 4.0)}, 6: {(6.0, 4.0)}, 1: {(6.0, 6.0)}}
