"""Elliott counts over the larger swings, and trend lines through swings. Both look ahead by the swings' reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.functions.windows import W_SQL, num
from tidebar.operators.market_queries import TS, add, over_bars, r
from tidebar.operators.queries import HOURLY_SQL
from tidebar.operators.research import swings
from tidebar.operators.research_queries import _SW
from tidebar.plans.chain import Chain
from tidebar.sources.candles import wall

REACH, LEAST_MOVE = 5, 0.01


def wave_swings() -> Chain:
    """Bars whose high (or else low) none within reach exceeds, and of these in turn those that move far enough from the last kept one."""
    c = Chain()
    side = lambda agg, x, a, b: f"{agg}({x}) over ({W_SQL} rows between {a} and {b})"
    before, after = (f"{REACH} preceding", "1 preceding"), ("1 following", f"{REACH} following")
    whole = c.col(f"count(h) over ({W_SQL} rows between {REACH} preceding and {REACH} following)")
    ready = f"{whole} = {2 * REACH + 1}"
    high = c.col(f"case when {ready} and h >= {side('max', 'h', *before)} and h >= {side('max', 'h', *after)} then 1 else 0 end")
    low = c.col(f"case when {ready} and l <= {side('min', 'l', *before)} and l <= {side('min', 'l', *after)} then 1 else 0 end")
    price = c.col(f"case when {high} = 1 and {low} = 0 then h when {low} = 1 and {high} = 0 then l end")
    move = c.col(f"{num(LEAST_MOVE)} * avg(c) over (partition by symbol)")

    def step(last, kept, price, move):
        if price is None:
            return last, 0.0
        return (price, 1.0) if last is None or abs(price - last) >= move else (last, 0.0)

    take = "t.in0 is not null and (r.last is null or abs(t.in0 - r.last) >= t.in1)"
    _, kept = c.fold([price, move], ["last", "kept"], lambda p, m: step(None, 0.0, p, m), step, ["t.in0", "case when t.in0 is not null then 1e0 else 0e0 end"], [f"case when {take} then t.in0 else r.last end", f"case when {take} then 1e0 else 0e0 end"])
    c.out = {"price": price, "is_high": f"{high} = 1", "kept": kept}
    return c


def _waves(bars: DataFrame, n: int) -> DataFrame:
    w = W.partitionBy("symbol").orderBy("ts")
    rows = wave_swings().apply(bars).where("kept = 1")
    return rows.select("symbol", "ts", F.col("price").alias("p0"), *(F.lead("price", k).over(w).alias(f"p{k}") for k in range(1, n)), F.lead("ts", 1).over(w).alias("ts1"), F.lead("ts", n - 1).over(w).alias("end_at")).where("end_at is not null")


def _first(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.groupBy("symbol").agg(F.min("ts").alias("ts"), *(F.min_by(c, "ts").alias(c) for c in columns))


def _length(a: int) -> str:
    return f"abs(p{a + 1} - p{a})"


#: Wave 2 is shorter than 1, wave 3 not the shortest of 1, 3 and 5, wave 4 stays out of wave 1; and the extensions.
IMPULSE = f"{_length(1)} < {_length(0)} and not ({_length(2)} < {_length(0)} and {_length(2)} < {_length(4)}) and case when p5 > p0 then least(p3, p4) >= p1 else greatest(p3, p4) <= p1 end"
PATTERN = f"case when {_length(2)} > {_length(0)} * 1.618e0 and {_length(2)} > {_length(4)} * 1.618e0 then 'extended 3' when {_length(4)} > {_length(0)} * 1.618e0 and {_length(4)} > {_length(2)} then 'extended 5' else 'standard' end"
ABC = f"{_length(1)} < {_length(0)}"
#: What is known of these rules at wave 2, and at wave 4.
TWO = f"{_length(1)} < {_length(0)}"
FOUR = f"{TWO} and case when p1 > p0 then least(p3, p4) >= p1 else greatest(p3, p4) <= p1 end"


def impulses(bars: DataFrame) -> DataFrame:
    """The first five waves of each symbol that keep the rules."""
    rows = _waves(bars, 6).where(F.expr(IMPULSE)).withColumn("pattern", F.expr(PATTERN)).withColumn("is_up", F.expr("p1 > p0"))
    return _first(rows, "p0", "p1", "p2", "p3", "p4", "p5", "pattern", "is_up", "end_at")


def corrections(bars: DataFrame) -> DataFrame:
    """The first three waves of which B is shorter than A."""
    return _first(_waves(bars, 4).where(F.expr(ABC)).withColumn("trend_up", F.expr("p1 <= p0")), "p0", "p1", "p2", "p3", "trend_up", "end_at")


#: The ratios that waves are compared with, and those of wave 3's targets.
RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786, 0.886, 1.0, 1.272, 1.618, 2.0, 2.618, 3.618, 4.236)
THIRD = (1.0, 1.272, 1.618, 2.0, 2.618)


def near_ratio(value: str, tolerance: float) -> str:
    """The first of the ratios that the value is nearer to than the tolerance."""
    return "case " + " ".join(f"when abs({value} - {num(x)}) < {num(tolerance)} then {num(x)}" for x in RATIOS) + " end"


def fib_ratios(bars: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Each wave's size over that of the wave before (0 without size), and the ratio that it is near to."""
    rows = _waves(bars, 3).withColumn("ratio", F.coalesce(F.expr(f"{_length(1)} / nullif({_length(0)}, 0e0)"), F.lit(0.0)))
    return rows.select("symbol", F.col("ts1").alias("ts"), "ratio", F.expr(near_ratio("ratio", tolerance)).alias("fib"))


def wave_shapes(bars: DataFrame) -> DataFrame:
    """Each wave's size, direction and hours, and the share of the wave before that it takes back."""
    rows = _waves(bars, 3)
    hours = (F.unix_seconds("end_at") - F.unix_seconds("ts1")) / 3600.0
    share = F.coalesce(F.expr(f"{_length(1)} / nullif({_length(0)}, 0e0)"), F.lit(0.0))
    return rows.select("symbol", F.col("ts1").alias("ts"), "end_at", F.expr(_length(1)).alias("size"), F.expr("p2 > p1").alias("is_up"), hours.alias("hours"), share.alias("retracement"))


def counts(bars: DataFrame) -> DataFrame:
    """A symbol's count: its first impulse, or else its first correction; nothing with under 20 bars or 5 swings."""
    enough = bars.groupBy("symbol").agg(F.count("*").alias("n")).where("n >= 20").join(wave_swings().apply(bars).where("kept = 1").groupBy("symbol").agg(F.count("*").alias("k")).where("k >= 5"), "symbol")
    five = impulses(bars).select("symbol", F.col("p5").alias("end"), F.col("pattern").alias("kind"), "is_up")
    three = corrections(bars).select("symbol", F.col("p3").alias("end"), F.lit("correction").alias("kind"), F.col("trend_up").alias("is_up"))
    both = enough.select("symbol").join(five.select("symbol", F.struct("kind", "end", "is_up").alias("a")), "symbol", "left").join(three.select("symbol", F.struct("kind", "end", "is_up").alias("b")), "symbol", "left")
    return both.select("symbol", F.coalesce("a", "b").alias("x")).where("x is not null").select("symbol", "x.*")


def targets(bars: DataFrame) -> DataFrame:
    """Where the next wave may end: wave 3 after a symbol's first two waves that keep the rules, wave 5 after its first four.

    Later waves need not be there: a count that stands at wave 2 has targets for wave 3.
    """
    way = "case when p1 > p0 then 1e0 else -1e0 end"
    third = [(f"W3 {100 * k:.1f}%", f"p2 + {num(k)} * abs(p1 - p0) * {way}") for k in THIRD]
    fifth = [("W5 = W1", f"p4 + abs(p1 - p0) * {way}"), ("W5 61.8%", f"p4 + abs(p3 - p0) * 0.618e0 * {way}")]
    out = None
    for n, rule, prices in ((3, TWO, third), (5, FOUR, fifth)):
        first = _first(_waves(bars, n).where(F.expr(rule)), *(f"p{k}" for k in range(n)))
        part = first.select("symbol", F.explode(F.array(*(F.struct(F.lit(name).alias("target"), F.expr(e).alias("price")) for name, e in prices))).alias("x")).select("symbol", "x.*")
        out = part if out is None else out.unionByName(part)
    return out


def trendlines(bars: DataFrame, tolerance: float = 0.01, least: int = 3, most: int = 6, block: int = 256) -> DataFrame:
    """Lines through two of a symbol's swings of a kind (rising or flat through lows, falling or flat through highs).

    A line's touches are the swings near it; the `most` strongest lines of a symbol are returned. Touches are counted by
    blocks of swings and the counts added up, so no row holds more than a block.
    """
    keys = ["symbol", "kind"]
    points = swings(bars, 2).join(bars.groupBy("symbol").agg(F.avg("c").alias("mean")), "symbol").withColumn("x", F.unix_seconds("ts") / 3600.0)
    a, b = (points.select(*keys, *more, F.struct("x", "price").alias(name)) for name, more in (("a", ["mean"]), ("b", [])))
    slope = (F.col("b.price") - F.col("a.price")) / (F.col("b.x") - F.col("a.x"))
    lines = a.join(b, keys).where("a.x < b.x").withColumn("slope", slope)
    lines = lines.where(F.when(F.col("kind") == "low", F.col("slope") >= -tolerance).otherwise(F.col("slope") <= tolerance))
    number = F.row_number().over(W.partitionBy(*keys).orderBy("ts"))
    blocks = points.withColumn("block", F.floor(number / block)).groupBy(*keys, "block").agg(F.sort_array(F.collect_list(F.struct("x", "price"))).alias("ps"))
    away = F.transform("ps", lambda p: F.when((p["x"] == F.col("a.x")) | (p["x"] == F.col("b.x")), 0.0).otherwise(F.abs(p["price"] - F.col("a.price") - F.col("slope") * (p["x"] - F.col("a.x"))) / F.col("mean")))
    near = lines.join(blocks, keys).withColumn("near", F.filter(away, lambda d: d < tolerance)).where(F.size("near") > 0)
    sums = near.groupBy(*keys, "a", "b", "slope").agg(F.sum(F.size("near")).alias("touches"), F.sum(F.aggregate("near", F.lit(0.0), lambda s, d: s + d)).alias("away"))
    found = sums.where(F.col("touches") >= least).withColumn("strength", F.col("touches") / (1 + 10 * F.col("away")))
    order = W.partitionBy("symbol").orderBy(F.desc("strength"), "kind", "a.x", "b.x")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("symbol", "kind", F.timestamp_seconds(F.col("a.x") * 3600).alias("start"), F.timestamp_seconds(F.col("b.x") * 3600).alias("end"), "slope", "touches", "strength")


_S = f"with s as (select * from ({wave_swings().sql(HOURLY_SQL)}) where kept = 1)"


def _leads(n: int) -> str:
    return f"{_S}, w as (select symbol, ts, price as p0, {', '.join(f'lead(price, {k}) over w as p{k}' for k in range(1, n))}, lead(ts, 1) over w as ts1, lead(ts, {n - 1}) over w as end_at from s window w as (partition by symbol order by ts))"


add("el_swings", over_bars(lambda b: wave_swings().apply(b).where("kept = 1").select("symbol", TS(), "price", "is_high")), f"{_S} select symbol, ts, price, is_high from s")
add("el_impulse", over_bars(lambda b: impulses(b).select("symbol", TS(), *(f"p{k}" for k in range(6)), "pattern", "is_up", wall("end_at").alias("end_at"))), f"{_leads(6)}, v as (select * from w where end_at is not null and {IMPULSE} qualify row_number() over (partition by symbol order by ts) = 1) select symbol, ts, p0, p1, p2, p3, p4, p5, {PATTERN} as pattern, p1 > p0 as is_up, end_at from v")
add("el_abc", over_bars(lambda b: corrections(b).select("symbol", TS(), "p0", "p1", "p2", "p3", "trend_up", wall("end_at").alias("end_at"))), f"{_leads(4)} select symbol, ts, p0, p1, p2, p3, p1 <= p0 as trend_up, end_at from w where end_at is not null and {ABC} qualify row_number() over (partition by symbol order by ts) = 1")
_FIRST = f"{_leads(6)}, v as (select * from w where end_at is not null and {IMPULSE} qualify row_number() over (partition by symbol order by ts) = 1)"
_WAY = "abs(p1 - p0) * (case when p1 > p0 then 1 else -1 end)"
_AT = lambda n, rule: f"w{n} as (select symbol, ts, price as p0, {', '.join(f'lead(price, {k}) over w as p{k}' for k in range(1, n))} from s window w as (partition by symbol order by ts)), v{n} as (select * from w{n} where p{n - 1} is not null and {rule} qualify row_number() over (partition by symbol order by ts) = 1)"
add("el_targets", over_bars(lambda b: targets(b).select("symbol", "target", r("price"))), f"{_S}, {_AT(3, TWO)}, {_AT(5, FOUR)} " + " union all ".join([f"select symbol, 'W3 {k * 100:.1f}%' as target, round(p2 + {k}::double * {_WAY}, 6) as price from v3" for k in THIRD] + [f"select symbol, 'W5 = W1', round(p4 + {_WAY}, 6) from v5", "select symbol, 'W5 61.8%', round(p4 + 0.618::double * abs(p3 - p0) * (case when p1 > p0 then 1 else -1 end), 6) from v5"]))
_RATIO = "coalesce(abs(p2 - p1) / nullif(abs(p1 - p0), 0), 0)"
add("el_fib", over_bars(lambda b: fib_ratios(b).select("symbol", TS(), r("ratio"), "fib")), f"{_leads(3)}, q as (select symbol, ts1 as ts, {_RATIO} as ratio from w where end_at is not null), f as (select unnest([{', '.join(map(repr, RATIOS))}])::double as fib) select symbol, ts, round(ratio, 6) as ratio, (select min(fib) from f where abs(ratio - fib) < 0.05::double) as fib from q")
add("x_el_wave", over_bars(lambda b: wave_shapes(b).select("symbol", TS(), wall("end_at").alias("end_at"), r("size"), "is_up", r("hours"), r("retracement"))), f"{_leads(3)} select symbol, ts1 as ts, end_at, round(abs(p2 - p1), 6) as size, p2 > p1 as is_up, round(epoch(end_at - ts1) / 3600.0::double, 6) as hours, round({_RATIO}, 6) as retracement from w where end_at is not null")
_THREE = _leads(4).replace(f"{_S}, w as", "w4 as")
add(
    "el_count",
    over_bars(lambda b: counts(b).select("symbol", "kind", "end", "is_up")),
    f"""{_FIRST}, {_THREE}, y as (select * from w4 where end_at is not null and {ABC} qualify row_number() over (partition by symbol order by ts) = 1),
    a as (select symbol, {PATTERN} as kind, p5 as last, p1 > p0 as up from v), z as (select symbol, 'correction' as kind, p3 as last, p1 <= p0 as up from y),
    k as (select symbol from s group by symbol having count(*) >= 5)
    select symbol, kind, last as "end", up as is_up from (select * from a union all select * from z where symbol not in (select symbol from a)) where symbol in (select symbol from k)""",
)
_SW2 = _SW.replace("5 preceding", "2 preceding").replace("5 following", "2 following").replace("i > 5 and i <= z - 5", "i > 2 and i <= z - 2")
add(
    "ch_trendlines",
    over_bars(lambda b: trendlines(b).select("symbol", "kind", wall("start").alias("start"), wall("end").alias("end"), r("slope"), F.col("touches").cast("long").alias("touches"), r("strength"))),
    f"""{_SW2}, m as (select symbol, avg(c) as mean from b group by symbol), p as (select *, epoch(ts) / 3600.0::double as x from s),
    q as (select a.symbol, a.kind, mean, a.x as ax, d.x as bx, a.price as ap, (d.price - a.price) / (d.x - a.x) as slope from p a join p d on a.symbol = d.symbol and a.kind = d.kind and a.x < d.x join m on m.symbol = a.symbol),
    t as (select q.symbol, q.kind, ax, bx, slope, case when p.x = ax or p.x = bx then 0::double else abs(p.price - ap - slope * (p.x - ax)) / mean end as away from q join p on p.symbol = q.symbol and p.kind = q.kind where case when q.kind = 'low' then slope >= -0.01::double else slope <= 0.01::double end),
    g as (select symbol, kind, ax, bx, slope, count(*) as touches, count(*) / (1 + 10 * sum(away)) as strength from t where away < 0.01::double group by 1, 2, 3, 4, 5 having count(*) >= 3)
    select symbol, kind, make_timestamp((ax * 3600000000)::bigint) as start, make_timestamp((bx * 3600000000)::bigint) as "end", round(slope, 6) + 0 as slope, touches, round(strength, 6) as strength from g qualify row_number() over (partition by symbol order by strength desc, kind, ax, bx) <= 6""",
)
