"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Each document has a 60-bit hash of its id and text. Tokens are summed by source and the hash's leading bits; the running
sum shows the bucket in which a source's budget ends; only that bucket is split by the next bits, and the few documents
of the last bucket decide the threshold exactly. A document is then taken by comparing its hash with its source's
threshold, so nothing is sorted and smaller budgets give subsets of larger ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import WORD, join_skewed, kept

#: Bits of each level of the histogram, and the 60 bits of the hash.
LEVEL_BITS, LEVELS, HASH_BITS = 12, 2, 60
#: With no more sources than this their thresholds are broadcast; else they are joined by a shuffle.
BROADCAST_SOURCES = 10_000


def unit_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the MD5 of the id, a line feed and the text's MD5 (null: empty)."""
    as_text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(as_text, F.lit("\n"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> with `target`: `share` of all sizes dealt by weight, no source above `cap` times its size.

    Dealing the excess again and again ends where every source below its cap has the same target per weight. In order
    of cap per weight, the capped sources come first, so running sums give that level at once. The table has one row a
    source; its windows without partitions see nothing else.
    """
    n = len(weights)
    by_point = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by_ratio = W.orderBy("__ratio", "__rank").rowsBetween(W.unboundedPreceding, -1)
    ranked = sizes.withColumn("__rank", F.row_number().over(by_point) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__rank") % n + 1).cast("int"))
    ranked = ranked.withColumn("__w", weight).withColumn("__ratio", cap * F.col("source_size") / F.col("__w"))
    every = W.partitionBy()
    ranked = ranked.withColumn("__left", share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(by_ratio), F.lit(0.0)))
    ranked = ranked.withColumn("__weights", F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(by_ratio), F.lit(0)))
    # The first source in this order that isn't capped fixes the level.
    uncapped = F.when(F.col("__ratio") * F.col("__weights") > F.col("__left"), F.struct("__ratio", "__rank", (F.col("__left") / F.col("__weights")).alias("level")))
    ranked = ranked.withColumn("__level", F.min(uncapped).over(every)["level"])
    target = F.when(F.col("__level").isNull(), cap * F.col("source_size")).otherwise(F.least(cap * F.col("source_size"), F.col("__level") * F.col("__w")))
    return ranked.select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, __h, size) rows and (source, source_size, target) -> goals with `base` (whole copies) and `limit`.

    A document is taken once more than `base` if its hash is at most `limit` (-1: none). The document at the threshold
    counts in if that brings the sum nearer to the target. Documents of one hash go together; those of size 0 don't count.
    """
    docs = docs.where("size > 0")
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = goals.withColumn("base", base).withColumn("__budget", F.col("target") - F.col("base") * F.col("source_size"))
    key = F.col("source").eqNullSafe(F.col("__source"))
    open_rows, done, budgets = docs, F.lit(0), goals.select("source", "__budget", F.lit(-1).cast("long").alias("limit"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        bucketed = open_rows.withColumn("__b", F.shiftright("__h", shift))
        sums = bucketed.groupBy("source", "__b").agg(F.sum("size").alias("__size"))
        running = W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = sums.join(budgets.select(F.col("source").alias("__source"), "__budget"), key).withColumn("__upto", F.sum("__size").over(running))
        edge = sums.where((F.col("__upto") > F.col("__budget")) & (F.col("__upto") - F.col("__size") <= F.col("__budget")))
        edge = edge.select("source", "__b", (F.col("__budget") - F.col("__upto") + F.col("__size")).alias("__rest"))
        # All of the buckets below the edge are in; a source whose budget ends at no bucket takes all that was open.
        budgets = kept(edge.select("source", F.col("__rest").alias("__budget"), (F.shiftleft("__b", shift) - 1).alias("limit"), "__b"), "mix-edge")
        # Joined on source and bucket, which splits a large source into thousands of keys.
        open_rows = bucketed.join(budgets.select(F.col("source").alias("__source"), F.col("__b").alias("__edge")), key & (F.col("__b") == F.col("__edge"))).select("source", "__h", "size")
    exact = open_rows.groupBy("source", "__h").agg(F.sum("size").alias("__size"))
    running = W.partitionBy("source").orderBy("__h").rowsBetween(W.unboundedPreceding, W.currentRow)
    exact = exact.join(budgets.select(F.col("source").alias("__source"), "__budget"), key).withColumn("__upto", F.sum("__size").over(running))
    inside = (F.col("__upto") <= F.col("__budget")) | (F.col("__upto") - F.col("__budget") < F.col("__budget") - F.col("__upto") + F.col("__size"))
    last = exact.where(inside).groupBy(F.col("source").alias("__source")).agg(F.max("__h").alias("__last"))
    found = budgets.join(last, key, "left").select(F.col("source").alias("__source"), F.greatest("limit", "__last").alias("__limit"))
    limit = F.when(F.col("__budget") > 0, F.coalesce("__limit", F.lit(-1))).otherwise(F.lit(-1))
    return goals.join(found, key, "left").select("source", "source_size", "target", "base", limit.alias("limit"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """documents -> all their columns and size, source_size, target, copies, taken (words taken, repeats counted).

    A null text has size 0 and gets its source's whole copies, a null source is a source of its own (the last), rows that
    repeat id and text are taken or left together, as are ties of the hash; a text of any length has one size. No document
    has more than `cap` copies. An empty table gives no rows. Columns of these names in the input are replaced, others stay.
    """
    new = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*new)
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select("source", unit_hash(F.col("doc_id"), F.col("text")).alias("__h"), size.alias("size"))
    rows = kept(rows, "mix-sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__n"))
    sources = kept(sources, "mix-sources")
    limits = kept(thresholds(rows, targets(sources.drop("__n"), weights, share, cap)), "mix-limits")
    # Null and '' are different sources; the key tells them apart where joins ignore null.
    source_key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    sized = docs.withColumn("__key", source_key).withColumn("size", size).withColumn("__h", unit_hash(F.col("doc_id"), F.col("text")))
    right = limits.join(sources.select(F.col("source").alias("__source"), "__n"), F.col("source").eqNullSafe(F.col("__source")))
    right = right.select(source_key.alias("__key"), "source_size", "target", "base", "limit", "__n")
    if limits.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = sized.join(F.broadcast(right.drop("__n")), "__key", "left")
    else:
        joined = join_skewed(sized, right, ["__key"], "__n", rows.count())
    joined = joined.withColumn("copies", F.col("base") + (F.col("__h") <= F.col("limit")).cast("long"))
    return joined.withColumn("taken", F.col("copies") * F.col("size")).drop("__key", "__h", "base", "limit")
