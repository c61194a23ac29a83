"""Indicator values that are kept up: a run reads newer bars and the state that the run before it left, nothing else.

Beside the values a folder holds, for each symbol that a run touched, the last rows with the chain's inner columns (`states`) and
from when to when the run wrote (`heads`). A bar that comes late or is corrected takes its symbol back to the last state
before it; from there the symbol's stored bars are gone through again. Each run is a version: one that is repeated replaces itself,
and its heads, written last, make it count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.plans.chain import Chain
from tidebar.sources import tables

BARS = ["symbol", "ts", "o", "h", "l", "c", "v", "n"]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _heads(spark: SparkSession, path: str, before: int) -> DataFrame | None:
    """symbol, version, since, upto of each run that still counts: no later run wrote at or before its end.

    One row a symbol and run that touched it.
    """
    found = [v for v in tables._folders(spark, f"{path}/heads")["version"] if v < before]
    if not found:
        return None
    heads = spark.read.parquet(*(f"{path}/heads/version={v}" for v in found))
    later = W.partitionBy("symbol").orderBy("version").rowsBetween(1, W.unboundedFollowing)
    return heads.withColumn("__next", F.min("since").over(later)).where("__next is null or __next > upto").drop("__next")


def advance(chain: Chain, fresh: DataFrame, path: str, version: int, history: Callable[[], DataFrame] | None = None) -> None:
    """The values of fresh bars (symbol, ts, o, h, l, c, v, n; new, late and corrected ones) as a version of the folder.

    history gives all stored bars as they are now, fresh ones too; it is read for symbols only that have to go back, from
    the state on that they go back to. Versions must grow. No fresh bars: nothing is written.
    """
    spark = fresh.sparkSession
    if _exists(spark, f"{path}/heads/version={version}/_SUCCESS"):
        return
    fresh = fresh.select(*BARS)
    first = fresh.groupBy("symbol").agg(F.min("ts").alias("__first"))
    if first.isEmpty():
        return
    heads, last, todo = _heads(spark, path, version), None, fresh
    if heads is not None:
        known = heads.join(first, "symbol")
        ends = known.groupBy("symbol", "__first").agg(F.max("upto").alias("__end"), F.max(F.when(F.col("upto") < F.col("__first"), F.struct("version", "upto"))).alias("__from"))
        ends = ends.select("symbol", (F.col("__end") >= F.col("__first")).alias("__back"), "__from.version", F.col("__from.upto").alias("__upto"))
        versions = [r["version"] for r in ends.select("version").distinct().collect() if r["version"] is not None]
        if versions:
            states = spark.read.parquet(*(f"{path}/states/version={v}" for v in sorted(versions)))
            last = states.join(ends.select("symbol", "version"), ["symbol", "version"], "left_semi").drop("version")
        back = ends.where("__back").select("symbol", "__upto")
        if not back.isEmpty():
            if history is None:
                raise ValueError("bars came late or were corrected, so the stored bars are needed")
            again = history().select(*BARS).join(back, "symbol").where("__upto is null or ts > __upto").select(*BARS)
            todo = fresh.join(back, "symbol", "left_anti").unionByName(again)
    rows = chain.resume(last, todo).withColumn("version", F.lit(version).cast("long"))
    rows.write.mode("overwrite").parquet(f"{path}/values/version={version}")
    made = spark.read.schema(rows.schema).parquet(f"{path}/values/version={version}")
    every = made if last is None else last.withColumn("version", F.lit(version).cast("long")).unionByName(made.select(*last.columns, "version"))
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("ts")))
    state = every.select(*BARS, "i", *chain.names(), "version", place.alias("__n")).where(F.col("__n") <= chain.tail()).drop("__n")
    state.write.mode("overwrite").parquet(f"{path}/states/version={version}")
    made.groupBy("symbol", "version").agg(F.min("ts").alias("since"), F.max("ts").alias("upto")).write.mode("overwrite").parquet(f"{path}/heads/version={version}")


def values(spark: SparkSession, path: str, chain: Chain) -> DataFrame:
    """symbol, ts and the chain's outputs as the last run left them."""
    found = tables._folders(spark, f"{path}/heads")["version"]
    rows = spark.read.parquet(*(f"{path}/values/version={v}" for v in found)).select("symbol", "ts", *chain.out, "version")
    return tables._latest(rows, ("symbol", "ts")).drop("version")


def keep_up(spark: SparkSession, chain: Chain, bars: str, path: str) -> int | None:
    """Brings the values at `path` up to a table of bars (sources.tables): reads its versions since the last run only.

    Returns the version that the values now stand at.
    """
    done = max(tables._folders(spark, f"{path}/heads")["version"], default=None)
    upto = tables.latest_version(spark, bars)
    if upto is None or upto == done:
        return done
    fresh = tables.current(spark, bars, upto=upto) if done is None else tables.changes(spark, bars, done, upto)
    advance(chain, fresh, path, upto, lambda: tables.current(spark, bars, upto=upto))
    return upto


def indicator_sink(chain: Chain, bars: str, path: str, fill: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch over a stream of bars: each batch's bars are stored, and the indicator goes on from its state.

    Bars may come in any order, late ones too: a bar behind what was computed takes its symbol back. fill gives, for gaps
    (symbol, after, before: the bars around it), the bars that were missed; they are stored with the batch, and where
    the stream has a bar itself, now or later, that one counts. A batch that runs again leaves the same.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # Two versions a batch: over what was filled, what the stream brought.
        upto = 2 * epoch + 1
        batch = tables.append_once(batch.select(*BARS), bars, upto)
        if batch.isEmpty():
            return
        if fill is not None:
            filled = fill(gaps(batch, tables.current(spark, bars, upto=2 * epoch - 1) if _before(spark, bars, 2 * epoch) else None))
            tables.append_once(filled.select(*BARS), bars, 2 * epoch, "filled")
        done = max((v for v in tables._folders(spark, f"{path}/heads")["version"] if v < 2 * epoch), default=None)
        fresh = tables.current(spark, bars, upto=upto) if done is None else tables.changes(spark, bars, done, upto)
        advance(chain, fresh, path, upto, lambda: tables.current(spark, bars, upto=upto))

    return write


def _before(spark: SparkSession, bars: str, version: int) -> bool:
    found = tables._folders(spark, bars)
    return any(v < version for v in [*found["version"], *found["base"]])


def gaps(batch: DataFrame, stored: DataFrame | None, seconds: int = 3600) -> DataFrame:
    """Holes in front of and inside a batch of bars: symbol, after, before, the starts of the bars around each.

    Of the stored bars only each symbol's last one before the batch counts; one row a symbol is joined.
    """
    rows = batch.select("symbol", "ts")
    if stored is not None:
        first = rows.groupBy("symbol").agg(F.min("ts").alias("__first"))
        rows = rows.unionByName(stored.join(first, "symbol").where("ts < __first").groupBy("symbol").agg(F.max("ts").alias("ts")))
    after = F.lag("ts").over(W.partitionBy("symbol").orderBy("ts"))
    return rows.select("symbol", after.alias("after"), F.col("ts").alias("before")).where(F.unix_seconds("before") - F.unix_seconds("after") > seconds)


def from_history(history: DataFrame, seconds: int = 3600, span: int = 7 * 86400) -> Callable[[DataFrame], DataFrame]:
    """A `fill` from a table of bars: joined by symbol and spans of time, of which a gap has as many as it is long."""
    at = lambda x: F.floor(F.unix_seconds(x) / span)

    def fill(holes: DataFrame) -> DataFrame:
        wanted = holes.withColumn("__span", F.explode(F.sequence(at(F.col("after")), at(F.col("before")))))
        found = history.withColumn("__span", at(F.col("ts"))).join(wanted, ["symbol", "__span"]).where("ts > after and ts < before")
        return found.select(*BARS).dropDuplicates(["symbol", "ts"])

    return fill
