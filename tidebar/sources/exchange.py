"""What exchanges send as JSON: lists of symbols, tickers, and messages with the running candle. No network: text columns in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The names in the exchanges' JSON.
SYMBOLS = "symbols array<struct<symbol: string, status: string>>"
TICKER = "symbol string, priceChange string, priceChangePercent string, lastPrice string, highPrice string, lowPrice string, volume string, quoteVolume string"
PRICES = {"o": "openPrice", "h": "highPrice", "l": "lowPrice", "c": "closePrice"}
MESSAGE = "epic string, snapshotTime string, lastTradedVolume double, " + ", ".join(f"{x} struct<bid: double, ask: double>" for x in PRICES.values())


def trading_symbols(answers: DataFrame) -> DataFrame:
    """value (exchange information as JSON) -> (symbol) of those that are trading; text that doesn't parse gives none."""
    one = answers.select(F.explode(F.from_json("value", SYMBOLS)["symbols"]).alias("s"))
    return one.where("s.status = 'TRADING'").select("s.symbol")


def tickers(answers: DataFrame) -> DataFrame:
    """value (a 24-hour ticker as JSON, numbers as text) -> its fields as doubles; text that doesn't parse is left out."""
    rows = answers.select(F.from_json("value", TICKER).alias("t")).where("t.symbol is not null")
    names = {"price_change": "priceChange", "price_change_percent": "priceChangePercent", "last_price": "lastPrice", "high_price": "highPrice", "low_price": "lowPrice", "volume": "volume", "quote_volume": "quoteVolume"}
    return rows.select("t.symbol", *(F.col(f"t.{x}").try_cast("double").alias(n) for n, x in names.items()))


def running_candles(messages: DataFrame) -> DataFrame:
    """value (a message as JSON) and any other columns -> those, symbol, ts, o, h, l, c (middle prices), v and is_final (false).

    Messages that don't parse, are no candle, or lack a price or a time go.
    """
    others = [F.col(x) for x in messages.columns if x != "value"]
    rows = messages.withColumn("m", F.from_json("value", MESSAGE)).withColumn("ts", F.try_to_timestamp("m.snapshotTime", F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    prices = [((F.col(f"m.{x}.bid") + F.col(f"m.{x}.ask")) / 2).alias(n) for n, x in PRICES.items()]
    out = rows.select(*others, F.col("m.epic").alias("symbol"), "ts", *prices, F.coalesce("m.lastTradedVolume", F.lit(0.0)).alias("v"), F.lit(False).alias("is_final"))
    return out.where(" and ".join(f"{x} is not null" for x in ("symbol", "ts", *PRICES)))
