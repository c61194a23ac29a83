"""Stored bars: files follow months and rows rather than days, and a stream's batch is computed once."""

import datetime as dt

from pyspark.sql import functions as F

from tidebar.plans.chain import Chain
from tidebar.sources import tables
from tidebar.streaming import incremental
from tidebar.streaming.bars import upsert_sink

START = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, ts timestamp, o double, h double, l double, c double, v double, n long"


def some_bars(days, symbols="AB", step=3):
    return [(s, START + dt.timedelta(hours=k), 1.0, 2.0, 0.5, k % 7 + 0.25, 3.0, 1) for s in symbols for k in range(0, 24 * days, step)]


def rows_of(df):
    return sorted(tuple(r) for r in df.select("symbol", "ts", "o", "h", "l", "c", "v", "n").collect())


def test_files_follow_months(spark, tmp_path):
    path, rows = str(tmp_path / "t"), some_bars(150)
    tables.append(spark.createDataFrame(rows, SCHEMA), path, 1)
    stored = tables.current(spark, path)
    assert rows_of(stored) == sorted(rows)
    # January to May, in at most four tasks.
    assert len(stored.inputFiles()) <= 5 + 4
    assert tables.compact(spark, path) == 1
    assert len(tables.current(spark, path).inputFiles()) <= 5 + 4 and rows_of(tables.current(spark, path)) == sorted(rows)


def test_scan_of_folders_by_day_and_by_month(spark, tmp_path):
    """Versions that were written with a folder a day are read beside those with a folder a month."""
    path, rows = str(tmp_path / "t"), some_bars(100)
    spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date("ts")).coalesce(1).write.partitionBy("day").parquet(f"{path}/version=1")
    newer = [(*r[:5], r[5] + 100, *r[6:]) for r in rows if r[1].day % 2]
    tables.append(spark.createDataFrame(newer, SCHEMA), path, 2)
    expected = {r[:2]: r for r in rows} | {r[:2]: r for r in newer}
    for start, end in ((dt.datetime(2024, 1, 31, 6), dt.datetime(2024, 2, 1, 3)), (dt.datetime(2024, 2, 10), dt.datetime(2024, 2, 10)), (START, START + dt.timedelta(days=200))):
        found = tables.scan(spark, path, "B", F.lit(start), F.lit(end))
        assert rows_of(found) == sorted(r for k, r in expected.items() if k[0] == "B" and start <= k[1] <= end)


def test_a_batch_is_computed_once(spark, tmp_path, monkeypatch):
    rows = some_bars(70)
    monkeypatch.setattr(tables, "ROWS", 300, raising=False)
    chain = Chain()
    chain.out = {"sum": chain.cum("sum", "c")}
    for name, sink in (("bars", upsert_sink(str(tmp_path / "bars"))), ("stored", incremental.indicator_sink(chain, str(tmp_path / "stored"), str(tmp_path / "values")))):
        seen = spark.sparkContext.accumulator(0)

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        sink(spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA), 0)
        assert seen.value == len(rows)
        stored = tables.current(spark, str(tmp_path / name))
        # Three months; 1,120 rows are four tasks' worth.
        assert rows_of(stored) == sorted(rows) and 4 <= len(stored.inputFiles()) <= 3 + 4
        sink(spark.createDataFrame([], SCHEMA), 1)
        assert rows_of(tables.current(spark, str(tmp_path / name))) == sorted(rows)
    values = {(r["symbol"], r["ts"]): r["sum"] for r in incremental.values(spark, str(tmp_path / "values"), chain).collect()}
    assert len(values) == len(rows) and values["A", rows[9][1]] == sum(r[5] for r in rows[:10])
