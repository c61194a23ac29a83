"""Bars from and to files: CSV with a header of any usual names, and exchange klines as JSON arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats of dates that are tried in order.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "yyyy-MM-dd")
KLINES = "array<array<string>>"


def moment(text: Column) -> Column:
    """A number above 1e12 as milliseconds, any other as seconds, a time with zone, or one of the formats; else null."""
    number = text.try_cast("bigint")
    from_number = F.when(number > 10**12, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    zoned = F.when(text.rlike(r"T.*(Z|[+-]\d\d:?\d\d)$"), text.try_cast("timestamp"))
    return F.coalesce(F.when(number.isNotNull(), from_number), zoned, *(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))


def read_csv(spark: SparkSession, path: str, symbol: str, required: bool = False) -> DataFrame:
    """timestamp, o, h, l, c and, where given, volume by place; lines that don't parse are left out, and a header is one of them.

    Nothing is inferred, so one pass over the file is enough; order is up to those who need it. With `required` a file
    without any good line is an error.
    """
    raw = spark.read.schema("t string, o string, h string, l string, c string, v string").option("mode", "PERMISSIVE").csv(path)
    number = lambda x: F.col(x).try_cast("double")
    rows = raw.select(F.lit(symbol).alias("symbol"), moment(F.trim("t")).alias("ts"), *(number(x).alias(x) for x in "ohlc"), F.coalesce(number("v"), F.lit(0.0)).alias("v"))
    rows = rows.where(" and ".join(f"{x} is not null" for x in ("ts", *"ohlc")))
    if required and rows.isEmpty():
        raise ValueError(f"{path} has no bars")
    return rows


def csv_bars(spark: SparkSession, path: str, symbol: str, timeframe: str, asked_symbol: str, asked_timeframe: str) -> DataFrame:
    """The file's bars for a request; one for another symbol or timeframe than the file's is an error (nothing is converted)."""
    if asked_symbol != symbol:
        raise ValueError(f"no symbol {asked_symbol} in {path}")
    if asked_timeframe != timeframe:
        raise ValueError(f"no timeframe {asked_timeframe} in {path}")
    return read_csv(spark, path, symbol, required=True)


def write_csv(bars: DataFrame, path: str) -> None:
    bars.select(F.unix_millis("ts").alias("timestamp"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume")).write.csv(path, header=True)


def write_csvs(bars: DataFrame, path: str) -> None:
    """All symbols' bars: a folder of CSV files for each, `symbol=...`."""
    columns = {"timestamp": F.unix_millis("ts"), "open": F.col("o"), "high": F.col("h"), "low": F.col("l"), "close": F.col("c"), "volume": F.col("v")}
    bars.select("symbol", *(x.alias(n) for n, x in columns.items())).write.partitionBy("symbol").csv(path, header=True)


def read_csvs(spark: SparkSession, path: str) -> DataFrame:
    """The bars of a folder of `write_csvs`, by the rules of read_csv; filters on symbol choose folders."""
    raw = spark.read.schema("t string, o string, h string, l string, c string, v string, symbol string").option("mode", "PERMISSIVE").csv(path)
    number = lambda x: F.col(x).try_cast("double")
    rows = raw.select("symbol", moment(F.trim("t")).alias("ts"), *(number(x).alias(x) for x in "ohlc"), F.coalesce(number("v"), F.lit(0.0)).alias("v"))
    return rows.where(" and ".join(f"{x} is not null" for x in ("ts", *"ohlc")))


def requested(spark: SparkSession, path: str, timeframe: str, requests: DataFrame) -> DataFrame:
    """The bars that requests (symbol, timeframe) ask of such a folder, whose bars are of one timeframe.

    A request for another timeframe, or for a symbol without bars, is an error (nothing is converted).
    """
    rows = read_csvs(spark, path)
    wrong = requests.where(F.col("timeframe") != timeframe).select("symbol", "timeframe").unionByName(requests.select("symbol", "timeframe").join(rows.select("symbol").distinct(), "symbol", "left_anti")).first()
    if wrong is not None:
        raise ValueError(f"no bars of {wrong['symbol']} at {wrong['timeframe']} in {path}")
    return rows.join(requests.select("symbol").distinct(), "symbol", "left_semi")


def parse_klines(lines: DataFrame, symbol: Column) -> DataFrame:
    """value (a JSON array of arrays: open time, o, h, l, c, v as text, ...) -> bars; rows of fewer than six fields go."""
    rows = lines.select(symbol.alias("symbol"), F.explode(F.from_json("value", KLINES)).alias("k")).where(F.size("k") >= 6)
    return rows.select("symbol", F.timestamp_millis(F.col("k")[0].cast("long")).alias("ts"), *(F.col("k")[i].try_cast("double").alias(x) for i, x in enumerate("ohlcv", 1)))


def synthetic(spark: SparkSession, n: int, kind: str = "trending", seconds: int = 60) -> DataFrame:
    """A deterministic series of n bars (trending, ranging or volatile) without a random generator: closed forms of the row."""
    i = F.col("id").cast("double")
    noise = {"trending": 0.5, "ranging": 0.5, "volatile": 4.0}[kind] * (F.sin(i * 0.5) + F.cos(i * 1.3))
    drift = {"trending": i * 0.1, "ranging": 5 * F.sin(i * 0.05), "volatile": F.sin(i * 0.01) * 10}[kind]
    close = 100 + drift + noise
    rows = spark.range(n).select(F.lit("MOCK").alias("symbol"), F.timestamp_seconds(F.col("id") * seconds).alias("ts"), (100 + drift).alias("o"), close.alias("c"), (1000 + F.abs(F.sin(i * 0.1)) * 500).alias("v"))
    return rows.select("symbol", "ts", "o", (F.greatest("o", "c") + 0.5).alias("h"), (F.least("o", "c") - 0.5).alias("l"), "c", "v")
