"""Stored tables that only grow by appended versions, of which a reader takes the latest row of each key.

An upsert appends its rows under a version (a folder of its own, by month inside, sorted by symbol); nothing that is there is
rewritten, so a batch that runs again, or fails half-way, does no harm. Readers of changes keep the number of the version they
have seen and read later folders only. `compact` writes the latest rows up to a version into one base, with the version that each
came from, so feeds stay whole across it; older folders can then be deleted by `vacuum`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that a task is worth where their number is known.
ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """Where driver and executors both write: spark.checkpoint.dir, in local mode the warehouse if it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (given or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def _folders(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The committed versions and bases of a table that have any rows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"version": [], "base": []}
    for status in system.listStatus(root) if system.exists(root) else []:
        kind, _, number = status.getPath().getName().partition("=")
        if kind not in found:
            continue
        names = [x.getPath().getName() for x in system.listStatus(status.getPath())]
        if "_SUCCESS" in names and any(x[0] not in "_." for x in names):
            found[kind].append(int(number))
    return found


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The largest version, None of an empty table."""
    found = _folders(spark, path)
    return max([*found["version"], *found["base"]], default=None)


def _written(rows: DataFrame, path: str, tasks: int | None = None) -> None:
    """By month (`day` is its first), symbol and time: as many files as tasks and months, so that filters on month and symbol skip files or row groups.

    Folders by day would make more files than bars are worth: of hourly bars a day has 24 rows a symbol.
    """
    keys = ("day", "symbol", "ts")
    dealt = rows.withColumn("day", F.trunc("ts", "month"))
    dealt = dealt.repartitionByRange(tasks, *keys) if tasks else dealt.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode("overwrite").partitionBy("day").parquet(path)


def append(rows: DataFrame, path: str, version: int) -> None:
    """rows (symbol, ts, ...) as a version of the table; larger versions win. A version written again replaces itself."""
    _written(rows, f"{path}/version={version}")


def append_once(rows: DataFrame, path: str, version: int, name: str = "batch") -> DataFrame:
    """As append, for rows whose plan should run once, as a stream's batch (its state runs again with each use); gives the rows as read back.

    An append by ranges runs a plan twice, and in a stream's session small partitions aren't merged. So rows are written beside the
    versions first (the next call with that name replaces them) and appended from there by as many tasks as they are worth.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}/{name}")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/{name}")
    _written(rows, f"{path}/version={version}", -(-rows.count() // ROWS) or 1)
    return rows


def _rows(spark: SparkSession, path: str, since: int | None = None, upto: int | None = None) -> DataFrame:
    """All rows of versions after since (None: all) up to upto: of the newest base that helps, and of folders after it.

    Which folders are read is settled here, by their names; of a base, row groups of old versions are skipped by their statistics.
    """
    found = _folders(spark, path)
    base = max((b for b in found["base"] if upto is None or b <= upto), default=None)
    if base is not None and since is not None and since >= base:
        base = None
    after = max(x for x in (base, since, -(1 << 62)) if x is not None)
    some = [v for v in found["version"] if v > after and (upto is None or v <= upto)]
    versions = lambda some: spark.read.option("basePath", path).parquet(*(f"{path}/version={v}" for v in some)).withColumn("version", F.col("version").cast("long"))
    parts = ([spark.read.parquet(f"{path}/base={base}")] if base is not None else []) + ([versions(sorted(some))] if some else [])
    if not parts:
        if not found["version"] and not found["base"]:
            raise ValueError(f"no table at {path}")
        return (versions(found["version"][:1]) if found["version"] else spark.read.parquet(f"{path}/base={found['base'][0]}")).limit(0)
    out = parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) > 1 else parts[0]
    return out if since is None else out.where(F.col("version") > since)


def _latest(rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    order = W.partitionBy(*key).orderBy(F.desc("version"))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def current(spark: SparkSession, path: str, key: tuple[str, ...] = ("symbol", "ts"), upto: int | None = None) -> DataFrame:
    """The latest row of each key, as of a version if one is given. Filters on day and the key reach the files."""
    return _latest(_rows(spark, path, upto=upto), key).drop("version", "day")


def changes(spark: SparkSession, path: str, since: int, upto: int | None = None, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """What a reader who has seen version `since` lacks: the latest row of each key that later versions wrote, with its version."""
    return _latest(_rows(spark, path, since, upto), key).drop("day")


def merged(had: DataFrame, feed: DataFrame, key: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """A snapshot with a feed of changes: the feed's rows replace those of the same key."""
    return had.join(feed.select(*key), list(key), "left_anti").unionByName(feed.select(*had.columns))


def scan(spark: SparkSession, path: str, symbol: str, start: Column, end: Column) -> DataFrame:
    """A symbol's rows of a closed range of time: only folders of those months and row groups of the symbol are read.

    Tables of earlier releases have a folder a day; their days lie between the same bounds.
    """
    rows = _rows(spark, path).where((F.col("symbol") == symbol) & F.col("day").between(F.trunc(start, "month"), F.to_date(end)) & F.col("ts").between(start, end))
    return _latest(rows, ("symbol", "ts")).drop("version", "day")


def compact(spark: SparkSession, path: str, key: tuple[str, ...] = ("symbol", "ts")) -> int:
    """The latest row of each key as a base at the largest version, which it returns; readers use it from then on."""
    version = latest_version(spark, path)
    if version is None:
        raise ValueError(f"no table at {path}")
    if version not in _folders(spark, path)["base"]:
        _written(_latest(_rows(spark, path, upto=version), key).drop("day"), f"{path}/base={version}")
    return version


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Deletes folders that the newest base stands for; run it when no reader has begun before that base."""
    found = _folders(spark, path)
    base = max(found["base"], default=None)
    gone = [] if base is None else [f"base={b}" for b in found["base"] if b < base] + [f"version={v}" for v in found["version"] if v <= base]
    for name in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def compacted(spark: SparkSession, path: str, to: str, key: tuple[str, ...] = ("symbol", "ts")) -> None:
    """The latest rows as version 0 of another table."""
    append(current(spark, path, key), to, 0)
