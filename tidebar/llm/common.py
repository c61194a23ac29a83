"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of all word rules here: space and the control characters 9 to 13.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"

#: A key is hot if it has more rows than a small part of what a task has: an eighth, or a thousandth of all rows if that is less.
HOT_PART, HOT_KEYS = 8, 1000
SALTS = 1024


def hot_limit(df: DataFrame, total: int) -> float:
    """Rows of a key that is still dealt out whole; so at most HOT_PART keys a shuffle partition, or HOT_KEYS, have more."""
    return max(total / max(HOT_KEYS, HOT_PART * parallelism(df)), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one where it is unset in local mode only."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        given = spark.sparkContext.getCheckpointDir()
    if given is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        given = f"file://{tempfile.mkdtemp(prefix='tidebar-')}"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(given)
    return given


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: What `kept` has written and `release` hasn't deleted.
KEPT: list[str] = []


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read back: later uses neither recompute it nor depend on an executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    KEPT.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Deletes all that `kept` has written. For when results that read it are written themselves."""
    while KEPT:
        path = spark._jvm.org.apache.hadoop.fs.Path(KEPT.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def part(col: Column, modulus: int = 5) -> Column:
    """crc32 of the value as text, modulo; a null value counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def join_skewed(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join with right, which is unique on keys (not null) and has in `count` how many left rows a key has at most.

    Keys with more rows than hot_limit, whose number is bounded by that of the partitions, are broadcast; their left rows
    are spread over SALTS values in the shuffle join of the rest. `count` is not returned.
    """
    values = [c for c in right.columns if c not in [*keys, count]]
    limit = hot_limit(left, total)
    hot = right.where(F.col(count) > limit).select(*keys, *(F.col(c).alias(f"__hot_{c}") for c in values), F.lit(True).alias("__hot"))
    cold = right.where(F.col(count) <= limit).select(*keys, *values, F.lit(0).alias("__salt"))
    # By the row's own values, so that a task that runs again after a loss deals its rows as before.
    own = F.xxhash64(*(F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind))
    salt = F.when(F.col("__hot"), 1 + F.pmod(own, F.lit(SALTS))).otherwise(0).cast("int")
    out = left.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).join(cold, [*keys, "__salt"], "left")
    merged = [F.when(F.col("__hot"), F.col(f"__hot_{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return out.select(*(F.col(f"`{c}`") for c in left.columns), *merged)
