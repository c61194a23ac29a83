"""Registered queries of sessions, timeframes, ranges, symbols, and of what comes from and goes to files and tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators import market as m
from tidebar.operators import queries as indicators
from tidebar.operators.market_queries import TS, B, add, at, over_bars, over_ticks, r
from tidebar.operators.structure import with_definitions
from tidebar.sources import exchange, files, tables
from tidebar.sources.candles import bars, hourly, table, ticks, wall

# Sessions

_S, _D = "floor(epoch(ts))::bigint % 86400", "(floor(epoch(ts))::bigint // 86400 + 4) % 7 in (1, 2, 3, 4, 5)"


def _open_sql(name: str) -> str:
    start, end = m.SESSIONS[name]
    return f"({_S} >= {start} and {_S} < {end}{'' if name == 'always' else f' and {_D}'})"


def _until_sql(name: str) -> str:
    start, end = m.SESSIONS[name]
    return f"case when {_open_sql(name)} then 0 when {_S} < {start} then {start} - {_S} else 86400 - {_S} + {start} end as to_open, case when {_open_sql(name)} then {end} - {_S} else 0 end as to_close"


for _name in ("tokyo", "london", "new_york"):
    add(f"ses_{_name}", over_ticks(lambda t, n=_name: t.select("id", m.is_open(F.col("ts"), n).alias("is_open"), *(x.alias(a) for x, a in zip(m.seconds_to(F.col("ts"), n), ("to_open", "to_close"))))), f"select event_id as id, {_open_sql(_name)} as is_open, {_until_sql(_name)} from events")
add("ses_is_open", over_ticks(lambda t: t.select("id", *(m.is_open(F.col("ts"), n).alias(n) for n in m.SESSIONS))), f"select event_id as id, {', '.join(f'{_open_sql(n)} as {n}' for n in m.SESSIONS)} from events")
add("ses_until", over_ticks(lambda t: t.select("id", F.explode(F.array(*(F.struct(F.lit(n).alias("session"), m.seconds_to(F.col("ts"), n)[0].alias("to_open"), m.seconds_to(F.col("ts"), n)[1].alias("to_close")) for n in m.SESSIONS))).alias("x")).select("id", "x.*")), " union all ".join(f"select event_id as id, '{n}' as session, {_until_sql(n)} from events" for n in m.SESSIONS))
add("x_ses_presets", over_ticks(lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("start_s"), F.lit(b).alias("end_s"), m.is_open(F.col("ts"), n).alias("is_open")) for n, (a, b) in m.SESSIONS.items()))).alias("x")).select("x.*").groupBy("name", "start_s", "end_s").agg(F.count_if("is_open").alias("n_open"))), " union all ".join(f"select '{n}' as name, {a} as start_s, {b} as end_s, count(*) filter ({_open_sql(n)}) as n_open from events" for n, (a, b) in m.SESSIONS.items()))

#: Holidays (null) and early closes in seconds of the day.
SPECIAL = [("2024-01-01", None), ("2024-01-15", None), ("2024-01-24", 64800)]


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = spark.createDataFrame(SPECIAL, "day string, closes int").withColumn("day", F.col("day").cast("date"))
    return m.session_state(ticks(spark, sf_dir), days).select("id", "state")


add("ses_state", _states, f"with d(day, closes) as (values (date '2024-01-01', null), (date '2024-01-15', null), (date '2024-01-24', 64800)) select event_id as id, case when d.day is not null and closes is null then 'closed' when {_open_sql('new_york')} then case when {_S} >= closes then 'closed' else 'open' end when {_open_sql('pre_market')} then 'before' when {_open_sql('after_hours')} then 'after' else 'closed' end as state from events left join d on d.day = ts::date")

# Timeframes and ranges

_FRAMES = ", ".join(f"('{k}', {v}, {'null' if m.LARGER[k] is None else repr(m.LARGER[k])})" for k, v in m.TIMEFRAMES.items())


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each timeframe and symbol: the whole bars between its first and last tick, and the next larger timeframe."""
    frames = spark.createDataFrame([(k, v, m.LARGER[k]) for k, v in m.TIMEFRAMES.items()], "timeframe string, seconds long, larger string")
    ends = ticks(spark, sf_dir).groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    rows = ends.withColumn("timeframe", F.explode(F.array(*map(F.lit, m.TIMEFRAMES)))).join(F.broadcast(frames), "timeframe")
    return rows.select("symbol", "timeframe", m.bars_between(F.col("seconds"), F.col("a"), F.col("z")).alias("n_bars"), "larger", (86400 % F.col("seconds") == 0).alias("divides_day"))


add("tb_bars_between", _frames, f"with f(timeframe, seconds, larger) as (values {_FRAMES}), e as (select event_type as symbol, floor(epoch(min(ts)))::bigint as a, floor(epoch(max(ts)))::bigint as z from events group by 1) select symbol, timeframe, ((z - a) // seconds)::bigint as n_bars, larger, 86400 % seconds = 0 as divides_day from e, f")
#: Spellings to try, with what they name.
SPELT = {" 5M ": "5m", "1M": "1m", "m1": "1m", "15min": "15m", "H4": "4h", "60m": "1h", "240m": "4h", "Daily": "1d", "w": "1w", "monthly": "1mo", "Monthly": None, "7m": None, "": None}
add("tb_parse_timeframe", lambda spark, sf_dir: spark.createDataFrame([(x,) for x in SPELT], "text string").select("text", m.parse_timeframe(F.col("text")).alias("timeframe")), "select * from (values " + ", ".join(f"('{k}', {'null' if v is None else repr(v)})" for k, v in SPELT.items()) + ") t(text, timeframe)")
NOW = "2024-01-20 13:30:00"
_STARTS = {"last_6_hours": "interval 6 hour", "last_3_days": "interval 3 day", "this_week": "interval 7 day", "this_month": "interval 30 day", "this_year": "interval 365 day"}


def _ranges(b: DataFrame) -> DataFrame:
    names = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), m.range_start(n, at(NOW)).alias("a")) for n in m.RANGES))).alias("x")
    rows = b.select("symbol", "ts", "c", names).select("symbol", "ts", "c", "x.*").where(F.col("ts").between(F.col("a"), at(NOW)))
    return rows.groupBy("name", "symbol").agg(F.count("*").alias("n"), wall(F.min("ts")).alias("first"), F.max_by("c", "ts").alias("last_close"))


add("x_range_rel", over_bars(_ranges), f"{B}, x(name, a) as (values " + ", ".join(f"('{n}', {f'date_trunc(' + repr('day') + f', timestamp {NOW!r})' if n == 'today' else f'timestamp {NOW!r} - {_STARTS[n]}'})" for n in m.RANGES) + f") select name, symbol, count(*) as n, min(ts) as first, arg_max(c, ts) as last_close from b, x where ts between a and timestamp '{NOW}' group by 1, 2")

# Symbols


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes with what they are, and the tick, lot and precisions that symbols of the class have."""
    rows = [(k, *v, 1e-5 if k == "forex" else 0.01, 1000.0 if k == "forex" else 1.0 if k == "stock" else 0.001, 5 if k == "forex" else 2, 0 if k == "stock" else 3) for k, v in m.CLASSES.items()]
    return spark.createDataFrame(rows, "class string, is_leveraged boolean, is_crypto boolean, is_24_7 boolean, tick double, lot double, price_digits int, quantity_digits int")


add("x_sym_presets", _symbols, "select class, class in ('crypto_perpetual', 'crypto_futures', 'cfd', 'futures', 'option') as is_leveraged, class like 'crypto%' as is_crypto, class like 'crypto%' or class = 'forex' as is_24_7, case class when 'forex' then 0.00001::double else 0.01::double end as tick, case class when 'forex' then 1000.0::double when 'stock' then 1.0::double else 0.001::double end as lot, case class when 'forex' then 5 else 2 end as price_digits, case class when 'stock' then 0 else 3 end as quantity_digits from (select unnest(['crypto', 'crypto_perpetual', 'crypto_futures', 'forex', 'stock', 'cfd', 'futures', 'option', 'index', 'commodity', 'bond']) as class)")
add("src_symbols", lambda spark, d: exchange.trading_symbols(table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("p_partkey").cast("string").alias("symbol"), F.when(F.col("p_size") > 25, "TRADING").otherwise("BREAK").alias("status"))).alias("symbols"))).alias("value"))), "select p_partkey::varchar as symbol from part where p_size > 25")


def _tickers(b: DataFrame) -> DataFrame:
    """Each symbol's whole series as the 24-hour ticker that an exchange would send, read again."""
    c = F.col
    rows = b.groupBy("symbol").agg(F.min_by("o", "ts").alias("o"), F.max_by("c", "ts").alias("c"), F.max("h").alias("h"), F.min("l").alias("l"), F.sum("n").alias("n"))
    text = lambda x, name: x.cast("string").alias(name)
    value = F.to_json(F.struct("symbol", text(c("c") - c("o"), "priceChange"), text((c("c") / c("o") - 1) * 100, "priceChangePercent"), text(c("c"), "lastPrice"), text(c("h"), "highPrice"), text(c("l"), "lowPrice"), text(c("n"), "volume"), text(c("n") * 2, "quoteVolume")))
    return exchange.tickers(rows.select(value.alias("value")))


add("src_ticker", over_bars(lambda b: _tickers(b).select("symbol", *(r(x) for x in ("price_change", "price_change_percent", "last_price", "high_price", "low_price", "volume", "quote_volume")))), f"{B}, q as (select symbol, arg_min(o, ts) as o, arg_max(c, ts) as c, max(h) as h, min(l) as l, sum(n)::double as n from b group by 1) select symbol, round(c - o, 6) as price_change, round((c / o - 1) * 100, 6) as price_change_percent, round(c, 6) as last_price, round(h, 6) as high_price, round(l, 6) as low_price, n as volume, n * 2 as quote_volume from q")

# Files and tables


def _path(spark: SparkSession, name: str) -> str:
    return f"{tables.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _csv(spark: SparkSession, sf_dir: str) -> str:
    path = _path(spark, "csv")
    files.write_csvs(hourly(spark, sf_dir), path)
    return path


def _written_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files as any reader of CSV with a header and folders of symbols sees them."""
    return spark.read.csv(_csv(spark, sf_dir), header=True).select("symbol", *(F.col(x).cast("double").alias(x) for x in ("timestamp", "open", "high", "low", "close")), F.round(F.col("volume").cast("double"), 6).alias("volume"))


def _requested_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the symbols that begin with p or later letters, asked for at the files' timeframe."""
    asked = hourly(spark, sf_dir).select("symbol").distinct().where("symbol >= 'p'").withColumn("timeframe", F.lit("1h"))
    return files.requested(spark, _csv(spark, sf_dir), "1h", asked).select("symbol", TS(), "c")


add("src_csv", lambda spark, d: files.read_csvs(spark, _csv(spark, d)).select("symbol", TS(), "o", "h", "l", "c", r("v")), f"{B} select symbol, ts, o, h, l, c, round(v, 6) as v from b")
add("sink_csv", _written_csv, f"{B} select symbol, epoch_ms(ts)::double as timestamp, o as open, h as high, l as low, c as close, round(v, 6) as volume from b")
add("x_csv_provider", _requested_csv, f"{B} select symbol, ts, c from b where symbol >= 'p'")


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """All bars, and then one symbol's again with other closes."""
    path, b = _path(spark, "bars"), hourly(spark, sf_dir)
    tables.append(b, path, 1)
    tables.append(b.where("symbol = 'click'").withColumn("c", F.col("c") * 2), path, 2)
    return path


def _stored_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An indicator's values, upserted twice under their own key."""
    path = _path(spark, "values")
    values = indicators.QUERIES["ta_sma"](spark, sf_dir).where("sma is not null").withColumn("name", F.lit("sma"))
    tables.append(values, path, 1)
    tables.append(values.where("symbol <> 'click'").withColumn("sma", F.col("sma") + 1), path, 2)
    return tables.current(spark, path, ("name", "symbol", "ts"))


add("sink_upsert", lambda spark, d: tables.current(spark, _stored(spark, d)).select("symbol", TS(), r("c")), f"{B} select symbol, ts, round(case when symbol = 'click' then 2 * c else c end, 6) as c from b")
add("src_db_table", lambda spark, d: tables.scan(spark, _stored(spark, d), "click", at("2024-01-05"), at("2024-01-09 12:00:00")).select("symbol", TS(), "o", r("c")), f"{B} select symbol, ts, o, round(2 * c, 6) as c from b where symbol = 'click' and ts between timestamp '2024-01-05' and timestamp '2024-01-09 12:00:00'")
add("sink_values", lambda spark, d: _stored_values(spark, d).select("name", "symbol", TS(), r("sma", "value")), f"select 'sma' as name, symbol, ts, round(case when symbol = 'click' then sma else sma + 1 end, 6) as value from ({indicators.ORACLE_SQL['ta_sma']}) where sma is not null")
add("x_ta_optional", lambda spark, d: indicators.QUERIES["ta_sma"](spark, d).dropna(subset=["sma"]), f"select * from ({indicators.ORACLE_SQL['ta_sma']}) where sma is not null")
add("tb_instances", lambda spark, d: with_definitions(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("definition_id")), table(spark, d, "part").select(F.col("p_partkey").alias("definition_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("version"))).select("instance_id", "line", "name", "version"), "select l_orderkey as instance_id, l_linenumber as line, p_name as name, p_brand as version from lineitem join part on l_partkey = p_partkey")
AHEAD = "2024-01-31 02:20:00"


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bars(ticks(spark, sf_dir), 60)
    wanted = b.select("symbol").distinct().unionByName(spark.createDataFrame([("unknown",)], "symbol string"))
    return m.missing(b, wanted, at(AHEAD), 60).select("symbol", TS())


add("src_rest_backfill", _missing, f"with b as (select distinct event_type as symbol, date_trunc('minute', ts) as ts from events), w as (select symbol, max(ts) as a from b group by 1 union all select 'unknown', timestamp '{AHEAD}' - interval 4 hour), s as (select symbol, unnest(generate_series(date_trunc('minute', a), date_trunc('minute', timestamp '{AHEAD}'), interval 1 minute)) as ts from w where epoch(timestamp '{AHEAD}' - a) > 300) select symbol, ts from s anti join b using (symbol, ts)")
