import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidebar.operators.ta import TA
from tidebar.plans.chain import Chain
from tidebar.sources import candles, exchange, files, tables
from tidebar.streaming import bars as streaming


def test_csv_skips_what_does_not_parse(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text("timestamp,open,high,low,close,volume\n1704067200000,1,2,0.5,1.5,10\n1704070800,1,2,0.5,1.5\n2024-01-01T02:00:00Z,1,2,0.5,1.5,3\n2024-01-01 03:00:00,1,2,0.5,1.5,3\n2024/01/02,1,2,0.5,1.5,3\nbad,1,2,3,4,5\n1704067200,x,2,3,4,5\n\n")
    rows = files.read_csv(spark, str(path), "S").orderBy("ts").collect()
    assert [r["ts"].strftime("%d %H") for r in rows] == ["01 00", "01 01", "01 02", "01 03", "02 00"]
    assert rows[1]["v"] == 0.0 and rows[0]["c"] == 1.5
    files.write_csv(files.read_csv(spark, str(path), "S"), str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out"), "S").count() == 5


def test_klines(spark):
    lines = spark.createDataFrame([('[[1704067200000,"1","2","0.5","1.5","10",1],[1,"2"]]',), ("nonsense",)], "value string")
    rows = files.parse_klines(lines, F.lit("S")).collect()
    assert len(rows) == 1 and rows[0]["h"] == 2.0 and rows[0]["v"] == 10.0


def test_synthetic_bars_are_valid(spark):
    for kind in ("trending", "ranging", "volatile"):
        assert files.synthetic(spark, 50, kind).where("h >= o and h >= c and l <= o and l <= c and v >= 0").count() == 50


def trades(spark):
    start = datetime(2024, 1, 1)
    rows = [(s, start + timedelta(minutes=17 * i), i, 10 + math.sin(i) + (s == "b"), 1.0) for i in range(200) for s in "ab" if not 60 < i < 80]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, id long, price double, size double")


def start(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    return q


def test_streamed_bars_are_the_batch_bars(spark, tmp_path):
    path = str(tmp_path / "t")
    trades(spark).repartition(1).sortWithinPartitions("ts").write.parquet(path)
    stream = lambda: spark.readStream.schema(trades(spark).schema).parquet(path)
    batch = {(r["symbol"], r["ts"]): r for r in candles.bars(trades(spark), volume="size").collect()}
    q = start(streaming.stream_bars(stream()), "whole", "complete")
    whole = {(r["symbol"], r["ts"]): r for r in spark.table("whole").collect()}
    q.stop()
    assert whole.keys() == batch.keys() and all(whole[k]["c"] == batch[k]["c"] and whole[k]["n"] == batch[k]["n"] for k in batch)
    q = start(streaming.stream_bars(streaming.unique(stream()), late=None), "final")
    final = spark.table("final").collect()
    q.stop()
    assert len(batch) - 4 <= len(final) < len(batch) and all(batch[r["symbol"], r["ts"]]["o"] == r["o"] for r in final)


def test_streamed_ema_is_the_batch_ema(spark, tmp_path):
    path = str(tmp_path / "b")
    b = candles.bars(trades(spark), volume="size")
    b.repartition(1).sortWithinPartitions("ts").write.parquet(path)
    q = start(streaming.stream_ema(spark.readStream.schema(b.schema).parquet(path), 5), "ema5")
    got = {(r["symbol"], r["ts"]): r["ema"] for r in spark.table("ema5").collect()}
    q.stop()
    chain = Chain()
    chain.out = TA["ema"](chain, length=5)
    for r in chain.apply(b).collect():
        x, y = got[r["symbol"], r["ts"]], r["ema"]
        assert (x is None or math.isnan(x)) == (y is None) and (y is None or math.isclose(x, y, rel_tol=1e-9))


def test_a_late_bar_stops_the_streamed_ema(spark, tmp_path):
    path, b = str(tmp_path / "late"), candles.bars(trades(spark), volume="size").where("symbol = 'a'")
    first, last = b.agg(F.min("ts"), F.max("ts")).first()
    b.where(F.col("ts") == last).coalesce(1).write.parquet(path)
    stream = streaming.stream_ema(spark.readStream.schema(b.schema).parquet(path), 5)
    q = stream.writeStream.format("memory").queryName("late").outputMode("append").start()
    q.processAllAvailable()
    b.where(F.col("ts") == first).coalesce(1).write.mode("append").parquet(path)
    with pytest.raises(Exception, match="came late"):
        q.processAllAvailable()
    q.stop()


def test_streamed_gaps_and_upsert(spark, tmp_path):
    path = str(tmp_path / "g")
    b = candles.bars(trades(spark), volume="size")
    b.repartition(1).write.parquet(path)
    q = start(streaming.stream_gaps(spark.readStream.schema(b.schema).parquet(path)), "gaps")
    assert {r["symbol"] for r in spark.table("gaps").collect()} == {"a", "b"}
    q.stop()
    store = str(tmp_path / "store")
    tables.append(b, store, 0)
    batch = b.where("symbol = 'a'").withColumn("c", F.lit(-1.0))
    for _ in range(2):  # a batch that runs again changes nothing
        streaming.upsert_sink(store)(batch, 1)
    now = tables.current(spark, store)
    assert now.where("c = -1").count() == batch.count() and now.count() == b.count() and sorted(now.columns) == sorted(b.columns)
    day = lambda d: F.lit(d).cast("timestamp")
    some = tables.scan(spark, store, "a", day("2024-01-02"), day("2024-01-02 05:00:00"))
    assert {r["c"] for r in some.collect()} == {-1.0} and some.count() == b.where("symbol = 'a' and ts between '2024-01-02' and '2024-01-02 05:00:00'").count()
    plan = some._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(symbol,a)" in plan
    tables.compacted(spark, store, str(tmp_path / "small"))
    assert tables.current(spark, str(tmp_path / "small")).count() == b.count()


def test_messages_that_do_not_parse_go(spark):
    good = '{"epic": "A", "snapshotTime": "2024-01-01T00:01:00", "openPrice": {"bid": 1, "ask": 3}, "highPrice": {"bid": 3, "ask": 5}, "lowPrice": {"bid": 0, "ask": 2}, "closePrice": {"bid": 2, "ask": 4}}'
    bad = ["nonsense", "", None, '{"ping": 1}', good[:50], good.replace("2024-01-01T00:01:00", "yesterday"), good.replace('"ask": 3', '"asked": 3'), good.replace("epic", "epoch")]
    rows = exchange.running_candles(spark.createDataFrame([(k, x) for k, x in enumerate([*bad, good])], "k int, value string")).collect()
    assert [(r["k"], r["symbol"], r["o"], r["h"], r["l"], r["c"], r["v"], r["is_final"]) for r in rows] == [(8, "A", 2.0, 4.0, 1.0, 3.0, 0.0, False)]


def test_exchange_answers(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    listed = text('{"symbols": [{"symbol": "A", "status": "TRADING"}, {"symbol": "B", "status": "BREAK"}, {"symbol": "C", "status": "TRADING", "more": 1}]}', "no json", None)
    assert sorted(r["symbol"] for r in exchange.trading_symbols(listed).collect()) == ["A", "C"]
    found = exchange.tickers(text('{"symbol": "A", "priceChange": "-1.5", "lastPrice": "x", "volume": "7"}', "no json")).collect()
    assert len(found) == 1 and found[0]["price_change"] == -1.5 and found[0]["last_price"] is None and found[0]["volume"] == 7.0


def test_csv_without_rows_and_with_another_symbol(spark, tmp_path):
    (tmp_path / "e.csv").write_text("date,open,high,low,close\nbad,1,2,3,4\n1,2,3\n")
    assert files.read_csv(spark, str(tmp_path / "e.csv"), "S").count() == 0
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "e.csv"), "S", required=True)
    (tmp_path / "g.csv").write_text("".join(f"{1704067200 + 60 * i},1,2,0.5,1.5,1\n" for i in range(5)))
    assert files.csv_bars(spark, str(tmp_path / "g.csv"), "S", "1m", "S", "1m").count() == 5
    for asked in (("T", "1m"), ("S", "5m")):
        with pytest.raises(ValueError):
            files.csv_bars(spark, str(tmp_path / "g.csv"), "S", "1m", *asked)
