"""Registered queries of operators/structure.py and of the file formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidebar.operators import structure as s
from tidebar.operators.market_queries import ORACLE_SQL, QUERIES, TS, B, add, over_bars, over_ticks, r
from tidebar.operators.order import lempel_ziv, permutation, shannon
from tidebar.operators.queries import HOURLY_SQL
from tidebar.operators.research_queries import _SW
from tidebar.plans.chain import Chain
from tidebar.sources import files
from tidebar.sources.candles import table, wall

_LAST = "z as (select symbol, arg_max(h, ts) as last_h, arg_max(l, ts) as last_l, arg_max(c, ts) as last_c from b group by symbol)"
add(
    "smc_order_blocks",
    over_bars(lambda b: s.order_blocks(b).select("symbol", TS(), "top", "bottom", "is_bullish", r("strength"), "mitigated")),
    f"""{B}, {_LAST}, q as (select *, lead(o) over w as o1, lead(c) over w as c1, lead(o, 2) over w as o2, lead(c, 2) over w as c2, lead(c, 3) over w as c3, case when h > l then abs(c - o) / (h - l) else 0 end as ratio from b window w as (partition by symbol order by ts)),
    k as (select *, c < o as up, 30 + case when ratio > 0.7::double then 30 when ratio > 0.5::double then 20 else 0 end + coalesce(least(abs(c3 - c) / c * 1000, 40), 0) as strength from q where (c < o and c1 >= o1 and c2 >= o2 and c2 > h) or (c >= o and c1 < o1 and c2 < o2 and c2 < l))
    select k.symbol, ts, h as top, l as bottom, up as is_bullish, round(least(strength, 100)::double, 6) as strength, case when up then last_l < l else last_h > h end as mitigated from k join z using (symbol)""",
)
_LEVELS = f"{_SW}, lv as (select a.symbol, a.kind, a.ts, a.price, count(*) + 1 as touches, least(100, (count(*) + 1) * 20.0)::double as strength from s a join s d on a.symbol = d.symbol and a.kind = d.kind and d.ts > a.ts and abs(d.price - a.price) / a.price < 0.001::double group by 1, 2, 3, 4)"
_MERGED = s.merged(0.001).sql(f"{_LEVELS} select symbol || '|' || kind as symbol, make_timestamp(1000000 * row_number() over (partition by symbol, kind order by price, ts)) as ts, price from lv")
add("smc_liquidity", over_bars(lambda b: s.zones(b).select("symbol", "kind", "level", "touches", r("strength"), "n_levels")), f"with z as ({_MERGED}), y as (select lv.*, row_number() over (partition by symbol, kind order by price, ts) as k from ({_LEVELS} select * from lv) lv) select y.symbol, y.kind, z.level, max(touches) as touches, round(max(strength), 6) as strength, count(*) as n_levels from y join z on z.symbol = y.symbol || '|' || y.kind and z.ts = make_timestamp(1000000 * y.k) group by 1, 2, 3")
add("x_smc_geom", over_bars(lambda b: s.block_geometry(b).select("symbol", TS(), "is_bullish", r("height"), "contains", r("distance"))), ORACLE_SQL["smc_order_blocks"].replace("select k.symbol, ts, h as top, l as bottom, up as is_bullish, round(least(strength, 100)::double, 6) as strength, case when up then last_l < l else last_h > h end as mitigated from", "select k.symbol, ts, up as is_bullish, round(h - l, 6) as height, last_c between l and h as contains, round(case when up then last_c - h else l - last_c end, 6) as distance from"))
add("x_smc_gap", over_bars(lambda b: s.gap_geometry(b).select("symbol", TS(), "kind", r("size"), r("middle"), "contains")), f"with g as ({ORACLE_SQL['smc_fvg']}), {_LAST.replace('from b ', f'from ({HOURLY_SQL}) ')} select symbol, ts, kind, round(top - bottom, 6) as size, round((top + bottom) / 2, 6) as middle, last_c between bottom and top as contains from g join z using (symbol)")
add("smc_bos", over_bars(lambda b: s.breaks(b).select("symbol", TS(), "kind", "price", "is_choch")), f"{_SW}, {_LAST}, n as (select *, row_number() over (partition by symbol order by ts desc, kind desc) as n from s), k as (select n.symbol, ts, kind, price from n join z using (symbol) where n <= 5 and ((kind = 'high' and last_h > price) or (kind = 'low' and last_l < price))) select *, coalesce(lag(kind) over (partition by symbol order by ts, kind) <> kind, false) as is_choch from k")
QUERIES["ch_sr_levels"] = over_bars(lambda b: s.levels(b).select("symbol", r("price"), "touches", wall("first_touch").alias("first_touch"), wall("last_touch").alias("last_touch"), "kind", r("strength")))


def _entropies() -> Chain:
    c = Chain()
    c.out = {"shannon": shannon(c)["entropy"], "complexity": lempel_ziv(c)["complexity"], "permutation": permutation(c)["entropy"]}
    return c


def _regimes(b):
    name, sure = s.regime(F.col("shannon"), F.col("complexity"), F.col("permutation"))
    return _entropies().apply(b).select("symbol", TS(), name.alias("regime"), r(sure, "confidence"))


add(
    "sc_regime",
    over_bars(_regimes),
    f"""select symbol, ts, case when shannon is null and complexity is null and permutation is null then 'transitioning' when s < 0.4::double and z < 0.4::double and p < 0.4::double then 'structured' when s > 0.7::double and z > 0.7::double and p > 0.7::double then 'random' when p < 0.5::double and s > 0.4::double and s < 0.8::double then 'trending' when s > 0.6::double and z < 0.5::double then 'ranging' else 'transitioning' end as regime,
    case when shannon is null and complexity is null and permutation is null then 0 else round(greatest(0, 1 - 4 * ((s - m) * (s - m) + (z - m) * (z - m) + (p - m) * (p - m)) / 3), 6) end as confidence
    from (select *, coalesce(shannon, 0.5::double) as s, coalesce(complexity, 0.5::double) as z, coalesce(permutation, 0.5::double) as p, (s + z + p) / 3 as m from ({_entropies().sql(HOURLY_SQL)}))""",
)
add(
    "rk_corr_exposure",
    over_bars(lambda b: s.correlated_exposure(b).select(r("exposure"), "n_pairs")),
    f"{B}, {_LAST}, r as (select symbol, ts, (c - lag(c) over w) / nullif(lag(c) over w, 0) as r from b window w as (partition by symbol order by ts)), k as (select x.symbol as a, y.symbol as b, corr(x.r, y.r) as p from r x join r y on x.ts = y.ts and x.symbol < y.symbol where x.r is not null and y.r is not null group by 1, 2) select round(coalesce(sum(least(u.last_c, w.last_c) * abs(p)), 0), 6) as exposure, count(*) as n_pairs from k join z u on u.symbol = k.a join z w on w.symbol = k.b where abs(p) >= 0.05::double",
)
add("tb_defs_latest", lambda spark, d: s.latest_versions(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.col("p_partkey").alias("version"))), "select p_brand as name, max(p_partkey) as version from part group by 1")
add("tb_list_values", over_bars(lambda b: b.where("symbol = 'click'").orderBy(F.desc("ts")).limit(100).orderBy("ts").select(TS(), F.col("c").alias("value"))), f"{B} select ts, value from (select ts, c as value from b where symbol = 'click' order by ts desc limit 100) order by ts")
add("src_csv_ts", over_ticks(lambda t: t.select("id", wall(files.moment(F.when(F.col("id") % 3 == 0, F.unix_millis("ts").cast("string")).when(F.col("id") % 3 == 1, F.unix_seconds("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))).alias("ts"))), "select event_id as id, case when event_id % 3 = 0 then date_trunc('millisecond', ts) else date_trunc('second', ts) end as ts from events")
add("src_kline_json", over_bars(lambda b: files.parse_klines(b.select("symbol", F.to_json(F.array(F.array(F.unix_millis("ts").cast("string"), *(F.col(x).cast("string") for x in "ohlcv")))).alias("value")), F.col("symbol")).select("symbol", TS(), "o", "h", "l", "c")), f"{B} select symbol, ts, o, h, l, c from b")


def _mock(spark, sf_dir):
    """The three kinds of series, one after the other."""
    parts = [files.synthetic(spark, 500, kind).withColumn("kind", F.lit(kind)) for kind in ("trending", "ranging", "volatile")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "symbol", TS(), r("o"), r("h"), r("l"), r("c"), r("v"))


_DRIFTS = {"trending": ("i * 0.1::double", 0.5), "ranging": ("5 * sin(i * 0.05::double)", 0.5), "volatile": ("sin(i * 0.01::double) * 10", 4.0)}
_SERIES = " union all ".join(f"select '{k}' as kind, i, 100 + {d} as o, 100 + {d} + {n}::double * (sin(i * 0.5::double) + cos(i * 1.3::double)) as c from range(500) t(i)" for k, (d, n) in _DRIFTS.items())
add("src_mock", _mock, f"select kind, 'MOCK' as symbol, make_timestamp(i * 60000000) as ts, round(o, 6) as o, round(greatest(o, c) + 0.5::double, 6) as h, round(least(o, c) - 0.5::double, 6) as l, round(c, 6) as c, round(1000 + abs(sin(i * 0.1::double)) * 500, 6) as v from ({_SERIES})")
