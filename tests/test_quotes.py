"""Registered quotes against plain division, a price of 0 too."""

import datetime as dt
import math

import __spark_entry__
from tidebar.operators.market import quotes


def test_quote_without_price(spark, tmp_path):
    rows = [(k, dt.datetime(2024, 1, 1, 0, k), "view", v) for k, v in enumerate((0.0, 12.5))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    free, paid = (r["spread_bps"] for r in __spark_entry__.queries()["evt_quote"](spark, str(tmp_path)).orderBy("ts").collect())
    assert math.isnan(free) and paid == 20.0
    # The operator's own answer stays 0.
    bid = spark.createDataFrame([("A", rows[0][1], 0.0, 0.0, 1.0, 1.0)], "symbol string, ts timestamp, bid double, ask double, bid_size double, ask_size double")
    assert quotes(bid).first()["spread_bps"] == 0.0
