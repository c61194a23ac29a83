"""Projections, predicates, time buckets and lookups over ticks, quotes and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.sources.candles import bucket_start

def by_time():
    return W.partitionBy("symbol").orderBy("ts")


#: Seconds of the timeframes by name; a month has 30 days.
TIMEFRAMES = {"1s": 1, "5s": 5, "15s": 15, "30s": 30, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400, "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800, "1mo": 2592000}

# Bars row by row


def shape(bars: DataFrame) -> DataFrame:
    body, span = F.abs(F.col("c") - F.col("o")), F.col("h") - F.col("l")
    return bars.select(
        "symbol", "ts", body.alias("body"), span.alias("span"), (F.col("h") - F.greatest("o", "c")).alias("upper_shadow"), (F.least("o", "c") - F.col("l")).alias("lower_shadow"),
        F.when(span > 0, body / span).otherwise(0.0).alias("body_ratio"), (F.col("c") >= F.col("o")).alias("is_bullish"), (F.col("c") < F.col("o")).alias("is_bearish"),
    )


def prices(bars: DataFrame) -> DataFrame:
    """The price sources that an indicator can be asked to use."""
    h, l, c, o = (F.col(x) for x in "hlco")  # noqa: E741
    return bars.select("symbol", "ts", ((h + l) / 2).alias("hl2"), ((h + l + c) / 3).alias("hlc3"), ((o + h + l + c) / 4).alias("ohlc4"), ((h + l + c + c) / 4).alias("hlcc4"))


def valid(bars: DataFrame) -> DataFrame:
    return bars.where("h >= l and h >= o and h >= c and l <= o and l <= c and v >= 0")


def quotes(events: DataFrame) -> DataFrame:
    """Bid, ask and their sizes -> mid, spread, spread_bps (0 if mid is 0), imbalance (0 without size)."""
    mid, spread, size = (F.col("bid") + F.col("ask")) / 2, F.col("ask") - F.col("bid"), F.col("bid_size") + F.col("ask_size")
    return events.select("symbol", "ts", mid.alias("mid"), spread.alias("spread"), F.when(mid != 0, spread / F.nullif(mid, F.lit(0.0)) * 10000).otherwise(0.0).alias("spread_bps"), F.when(size > 0, (F.col("bid_size") - F.col("ask_size")) / size).otherwise(0.0).alias("imbalance"))


def round_price(price: Column, tick: float) -> Column:
    return F.round(price / tick) * tick


def floor_quantity(quantity: Column, lot: float) -> Column:
    return F.floor(quantity / lot) * lot


# Ranges and lookups


def in_range(bars: DataFrame, start: Column, end: Column, limit: int | None = None) -> DataFrame:
    """Bars of the closed range; with a limit the last so many of each symbol."""
    out = bars.where(F.col("ts").between(start, end))
    if limit is None:
        return out
    return out.withColumn("__n", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("__n") <= limit).drop("__n")


def nearest(bars: DataFrame, at: Column) -> DataFrame:
    """Of each symbol the bar whose time is nearest to `at`, of equally near ones the earlier: one aggregation."""
    away = F.struct(F.abs(F.unix_micros("ts") - F.unix_micros(at)), "ts")
    return bars.groupBy("symbol").agg(F.min_by("ts", away).alias("ts"), F.min_by("c", away).alias("c"))


def as_of(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """left with right's last `value` at or before its ts: a union and a window, so that nothing is compared pairwise."""
    both = left.select("symbol", "ts", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__left")).unionByName(right.select("symbol", "ts", F.col(value).alias("__v"), F.lit(0).alias("__left")))
    last = F.last("__v", ignorenulls=True).over(W.partitionBy("symbol").orderBy("ts", "__left").rowsBetween(W.unboundedPreceding, 0))
    return both.withColumn(value, last).where("__left = 1").select("symbol", "ts", value)


def latest(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(F.max("ts").alias("ts"), F.max_by("c", "ts").alias("c"), F.max_by("v", "ts").alias("v"))


def last_bars(bars: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    """The symbol's last min(limit or 500, 2000) bars in order of time; top-k, no full sort."""
    return bars.where(F.col("symbol") == symbol).orderBy(F.desc("ts")).limit(min(limit or 500, 2000)).orderBy("ts")


def since(bars: DataFrame, symbol: str, start: Column) -> DataFrame:
    return bars.where((F.col("symbol") == symbol) & (F.col("ts") > start)).orderBy("ts").limit(2000)


# Buckets


def bucket_facts(ticks: DataFrame, seconds: int) -> DataFrame:
    start = bucket_start(F.col("ts"), seconds)
    into = F.unix_seconds("ts") - F.unix_seconds(start)
    return ticks.select("symbol", "id", start.alias("start"), (into / seconds).alias("progress"), (seconds - into).alias("remaining"), (F.unix_seconds(start) / seconds).cast("long").alias("bucket"))


def spine(bars: DataFrame, seconds: int) -> DataFrame:
    """All bucket starts between a symbol's first and last bar."""
    ends = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    return ends.select("symbol", F.explode(F.sequence("a", "b", F.expr(f"interval {seconds} seconds"))).alias("ts"))


def filled(bars: DataFrame, seconds: int) -> DataFrame:
    """Missing buckets as flat bars at the last close with no volume."""
    out = spine(bars, seconds).join(bars, ["symbol", "ts"], "left")
    last = F.last("c", ignorenulls=True).over(by_time().rowsBetween(W.unboundedPreceding, 0))
    out = out.withColumn("__c", last)
    return out.select("symbol", "ts", *(F.coalesce(x, "__c").alias(x) for x in "ohlc"), F.coalesce("v", F.lit(0.0)).alias("v"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """Places where more than two buckets lie between neighbours: what a backfill must ask for."""
    before = F.lag("ts").over(by_time())
    out = bars.select("symbol", before.alias("after"), F.col("ts").alias("before"), (F.unix_seconds("ts") - F.unix_seconds(before)).alias("seconds"))
    return out.where(F.col("seconds") > 2 * seconds)


def infer_timeframe(bars: DataFrame) -> DataFrame:
    """The mean gap of neighbours, as a whole number of seconds, and the least timeframe that is not below it."""
    gap = F.unix_seconds("ts") - F.unix_seconds(F.lag("ts").over(by_time()))
    mean = bars.select("symbol", gap.alias("gap")).groupBy("symbol").agg(F.floor(F.sum("gap") / F.count("gap")).cast("long").alias("mean_gap"))
    ladder = F.lit("1w")
    for name, limit in reversed((("1m", 60), ("5m", 300), ("15m", 900), ("30m", 1800), ("1h", 3600), ("4h", 14400), ("1d", 86400))):
        ladder = F.when(F.col("mean_gap") <= limit, name).otherwise(ladder)
    return mean.withColumn("timeframe", ladder)


def upsert(stored: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """Last writer wins on the key: one window over the union."""
    order = W.partitionBy(*key).orderBy(F.desc(version))
    return stored.unionByName(new).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def merge_backfill(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """Stored bars stay; fetched ones fill in the times that are missing."""
    return stored.unionByName(fetched.join(stored.select("symbol", "ts"), ["symbol", "ts"], "left_anti"))


# Sessions (fixed UTC hours, no daylight saving)

DAY = 86400
#: Start and end in seconds of the day, by standard time; after-hours end past midnight and are not wrapped.
SESSIONS = {"always": (0, 86400), "tokyo": (0, 21600), "london": (28800, 59400), "new_york": (52200, 75600), "pre_market": (32400, 52200), "after_hours": (75600, 90000)}
#: Sunday is 0.
WEEKDAYS = (1, 2, 3, 4, 5)


def is_open(ts: Column, name: str) -> Column:
    """On weekdays (24/7: on all days) in [start, end), over midnight where start >= end."""
    start, end = SESSIONS[name]
    seconds = F.unix_seconds(ts)
    of_day = F.pmod(seconds, F.lit(DAY))
    inside = (of_day >= start) & (of_day < end) if start < end else (of_day >= start) | (of_day < end)
    return inside if name == "always" else inside & F.pmod(F.floor(seconds / DAY) + 4, F.lit(7)).isin(*WEEKDAYS)


def seconds_to(ts: Column, name: str) -> tuple[Column, Column]:
    """Until it opens (0 if it is open; closed days aren't skipped) and until it closes (0 if it isn't)."""
    (start, end), now = SESSIONS[name], is_open(ts, name)
    of_day = F.pmod(F.unix_seconds(ts), F.lit(DAY))
    until = F.when(now, 0).when(of_day < start, start - of_day).otherwise(DAY - of_day + start)
    left = end - of_day if start < end else F.when(of_day >= start, DAY - of_day + end).otherwise(end - of_day)
    return until.cast("long"), F.when(now, left).otherwise(0).cast("long")


def session_state(ticks: DataFrame, days: DataFrame, name: str = "new_york") -> DataFrame:
    """ticks with `state`: open, before, after or closed, by a small table (day, closes) of holidays (null) and early closes.

    After an early close the regular hours that are left are closed; what follows them is as on other days.
    """
    special = days.select(F.col("day").alias("__day"), F.col("closes").alias("__closes"), F.lit(True).alias("__special"))
    rows = ticks.join(F.broadcast(special), F.to_date("ts") == F.col("__day"), "left")
    ts, of_day = F.col("ts"), F.pmod(F.unix_seconds("ts"), F.lit(DAY))
    holiday = F.coalesce("__special", F.lit(False)) & F.col("__closes").isNull()
    regular = F.when(F.col("__closes").isNotNull() & (of_day >= F.col("__closes")), "closed").otherwise("open")
    state = F.when(holiday, "closed").when(is_open(ts, name), regular).when(is_open(ts, "pre_market"), "before").when(is_open(ts, "after_hours"), "after").otherwise("closed")
    return rows.select(*ticks.columns, state.alias("state"))


# Timeframes and ranges

#: The next larger timeframe.
LARGER = {"1s": "5s", "5s": "15s", "15s": "30s", "30s": "1m", "1m": "5m", "3m": "5m", "5m": "15m", "15m": "30m", "30m": "1h", "1h": "4h", "2h": "4h", "4h": "1d", "6h": "12h", "8h": "1d", "12h": "1d", "1d": "1w", "3d": "1w", "1w": "1mo", "1mo": None}


def timeframe_names() -> dict[str, str]:
    """Lower-case spellings -> timeframe: 5m, m5, 5min, and a few others. A month can only be spelt out."""
    out = {}
    for name in TIMEFRAMES:
        n, unit = name.rstrip("smhdwo"), name.lstrip("0123456789")
        if unit != "mo":
            out |= {name: name, unit + n: name} | ({f"{n}min": name} if unit == "m" else {})
    return out | {"60m": "1h", "60min": "1h", "120m": "2h", "240m": "4h", "d": "1d", "daily": "1d", "w": "1w", "weekly": "1w", "monthly": "1mo"}


def parse_timeframe(text: Column) -> Column:
    """The timeframe that a text names, without regard to case and white space around it (monthly: lower case only); else null."""
    names = F.create_map(*(F.lit(x) for pair in timeframe_names().items() for x in pair))
    plain = F.btrim(text)
    return F.when((F.lower(plain) != "monthly") | (plain == "monthly"), F.element_at(names, F.lower(plain)))


def bars_between(seconds: Column, start: Column, end: Column) -> Column:
    return F.floor((F.unix_seconds(end) - F.unix_seconds(start)) / seconds).cast("long")


#: Ranges that end now: what they are named and where they start.
RANGES = ("last_6_hours", "last_3_days", "today", "this_week", "this_month", "this_year")


def range_start(name: str, now: Column) -> Column:
    """A week has 7 days, a month 30, a year 365."""
    if name == "today":
        return F.date_trunc("day", now)
    days = {"this_week": 7, "this_month": 30, "this_year": 365}
    if name in days:
        return F.timestamp_seconds(F.unix_seconds(now) - days[name] * DAY)
    _, n, unit = name.split("_")
    return F.timestamp_seconds(F.unix_seconds(now) - int(n) * {"hours": 3600, "days": DAY}[unit])


def missing(bars: DataFrame, wanted: DataFrame, now: Column, seconds: int, least: int = 300, otherwise: int = 4 * 3600) -> DataFrame:
    """wanted (symbol) -> (symbol, ts): the buckets to fetch, those not stored since the last bar if that is over `least` seconds ago.

    A symbol without bars gets the last `otherwise` seconds.
    """
    last = wanted.join(latest(bars).select("symbol", F.col("ts").alias("__last")), "symbol", "left")
    since = F.coalesce("__last", F.timestamp_seconds(F.unix_seconds(now) - otherwise))
    last = last.withColumn("__from", since).where(F.unix_seconds(now) - F.unix_seconds("__from") > least)
    first = bucket_start(F.col("__from"), seconds)
    starts = last.select("symbol", F.explode(F.sequence(first, bucket_start(now, seconds), F.expr(f"interval {seconds} seconds"))).alias("ts"))
    return starts.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


# Symbols

#: Classes of assets, and whether they are leveraged, crypto, or traded round the clock.
CLASSES = {"crypto": (False, True, True), "crypto_perpetual": (True, True, True), "crypto_futures": (True, True, True), "forex": (False, False, True), "stock": (False, False, False), "cfd": (True, False, False), "futures": (True, False, False), "option": (True, False, False), "index": (False, False, False), "commodity": (False, False, False), "bond": (False, False, False)}


def breadth(bars: DataFrame) -> DataFrame:
    """Per time over all symbols: advances and declines, their volume, new highs and lows of 20 bars."""
    change = F.col("c") - F.lag("c").over(by_time())
    near = by_time().rowsBetween(-19, 0)
    out = bars.withColumn("d", change).withColumn("top", F.max("h").over(near)).withColumn("bottom", F.min("l").over(near))
    count = lambda cond: F.sum(F.when(cond, 1.0).otherwise(0.0))
    return out.groupBy("ts").agg(
        count(F.col("d") > 0).alias("adv"), count(F.col("d") < 0).alias("dec"), F.sum(F.when(F.col("d") > 0, F.col("v")).otherwise(0.0)).alias("adv_v"), F.sum(F.when(F.col("d") < 0, F.col("v")).otherwise(0.0)).alias("dec_v"),
        count(F.col("h") == F.col("top")).alias("nh"), count(F.col("l") == F.col("bottom")).alias("nl"),
    ).withColumn("symbol", F.lit("all"))


def pair(bars: DataFrame, a: str, b: str) -> DataFrame:
    """Two symbols' closes joined on time; the second as v."""
    x = bars.where(F.col("symbol") == a).select("ts", F.col("c"))
    y = bars.where(F.col("symbol") == b).select("ts", F.col("c").alias("v"))
    return x.join(y, "ts").withColumn("symbol", F.lit(f"{a}/{b}"))
