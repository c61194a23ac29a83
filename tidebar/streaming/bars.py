"""Bars and indicators over streams. The batch definitions hold: a watermarked aggregation gives the same final bars."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidebar.sources.tables import append_once


def _moment() -> Column:
    """ts and then id as one number, in the order of both; a null id comes first. Its width is fixed, so bars add up in a hash table without sorting trades."""
    id = F.coalesce(F.col("id").cast("long"), F.lit(-(1 << 63)))
    return F.unix_micros("ts").cast("decimal(17,0)") * F.lit(Decimal(1 << 64)) + id.cast("decimal(20,0)")


def stream_bars(trades: DataFrame, seconds: int = 3600, late: str | None = "10 minutes") -> DataFrame:
    """A stream of symbol, ts, id, price, size -> bars; in append mode each once when it is final, in update mode as it grows.

    State is one row a symbol and open bucket; trades later than the watermark are dropped. late is None if the stream has
    a watermark already.
    """
    at = _moment()
    out = (trades.withWatermark("ts", late) if late else trades).groupBy("symbol", F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v"), F.count("*").alias("n")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "o", "h", "l", "c", "v", "n")


def _windowed(trades: DataFrame, window: Column, late: str | None) -> DataFrame:
    at = _moment()
    out = (trades.withWatermark("ts", late) if late else trades).groupBy("symbol", window.alias("w")).agg(
        F.min_by("price", at).alias("o"), F.max("price").alias("h"), F.min("price").alias("l"), F.max_by("price", at).alias("c"), F.sum("size").alias("v"), F.count("*").alias("n")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "o", "h", "l", "c", "v", "n")


def sliding_bars(trades: DataFrame, size: str = "1 hour", slide: str = "15 minutes", late: str | None = None) -> DataFrame:
    """Bars of overlapping windows (ts to until) that begin every `slide`; of a batch, or with `late` of a stream.

    A trade is in size / slide windows; partial bars are merged before the shuffle. State of a stream: a row a symbol and open window.
    """
    return _windowed(trades, F.window("ts", size, slide), late)


def session_bars(trades: DataFrame, gap: str = "20 minutes", late: str | None = None) -> DataFrame:
    """Bars of bursts: a symbol's trades with less than `gap` between neighbours, until the last one and `gap`.

    Of a batch, or with `late` of a stream in append mode (an open session can still merge with its neighbour, so it is not
    shown before it is final). State of a stream: a row a symbol and open session.
    """
    return _windowed(trades, F.session_window("ts", gap), late)


def stream_candles(candles: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of running candles (symbol, ts, id, o, h, l, c, v) -> the last message of each candle, in update mode.

    State is one row a symbol and candle until the watermark passes it.
    """
    last = F.max_by(F.struct("o", "h", "l", "c", "v"), "id")
    return candles.withWatermark("ts", late).groupBy("symbol", "ts").agg(last.alias("x")).select("symbol", "ts", "x.*")


def unique(trades: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Trades without repeats of an id within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark(["symbol", "id"])


def stream_ema(bars: DataFrame, length: int = 21) -> DataFrame:
    """EMA over a stream of final bars: the state of a symbol is four numbers. Equal to the batch `ema` on the same bars.

    A bar that comes in a later batch than a newer one stops the stream, as its place has gone by; `indicator_sink` takes such bars.
    """
    k = 2 / (length + 1)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, y, last = state.get if state.exists else (0, 0.0, 0.0, None)
        out = []
        for row in pd.concat(list(parts)).sort_values("ts").itertuples():
            if last is not None and row.ts <= pd.Timestamp(last):
                raise ValueError(f"a bar of {key[0]} came late: {row.ts} after {last}")
            last = row.ts
            seen += 1
            total += row.c if seen <= length else 0.0
            y = total / length if seen == length else k * row.c + (1 - k) * y if seen > length else 0.0
            out.append((key[0], row.ts, row.c, y if seen >= length else None))
        state.update((seen, total, y, last))
        yield pd.DataFrame(out, columns=["symbol", "ts", "c", "ema"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, c double, ema double", "seen long, total double, y double, last timestamp", "append", GroupStateTimeout.NoTimeout)


def stream_gaps(bars: DataFrame, seconds: int = 3600) -> DataFrame:
    """Gaps of more than two buckets in a stream of final bars: what must be fetched again."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for ts in pd.concat(list(parts))["ts"].sort_values():
            if last is not None and (ts - last).total_seconds() > 2 * seconds:
                out.append((key[0], last, ts))
            last = ts if last is None or ts > last else last
        state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "after", "before"])

    return bars.groupBy("symbol").applyInPandasWithState(step, "symbol string, after timestamp, before timestamp", "last timestamp", "append", GroupStateTimeout.NoTimeout)


def upsert_sink(path: str):
    """For foreachBatch: a batch's rows (symbol, ts, ...) become a version of the table; sources.tables.current reads it.

    Only what arrived is written. A batch that runs again appends the same rows under the same version.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        append_once(batch, path, epoch)

    return write
