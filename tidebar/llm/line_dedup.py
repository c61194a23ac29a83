"""Line dedup by range-partitioned hashes, sorted by document and position within a hash (DataFrame functions only).

Lines become rows of a 96-bit key hash, document and position. A range partitioning by hash with a secondary sort lets a
window see each key's documents in order, so that the occurrence that stays streams out first. Keys with more rows than
`hot_limit` allows a task are summed before any shuffle instead. Texts stay where they are; what returns to a document is
the list of runs of kept lines, a run-length compressed bitmap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import SPACES, ascii_lower, hot_limit, kept, parallelism


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def _row_key() -> Column:
    """With the id, tells rows apart that share it; rows that repeat id and text are alike."""
    return F.xxhash64(F.col("doc_id"), F.coalesce("text", F.lit("")))


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """documents -> (__id, __row, __drop): for each row that loses lines, their positions in order."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    cut = docs.select("doc_id", _row_key().alias("__row"), F.posexplode(lines).alias("__pos", "__line")).withColumn("__line", line_key(F.col("__line")))
    cut = cut.where(F.char_length("__line") >= min_chars)
    hashed = kept(cut.select(F.xxhash64("__line").alias("__h"), F.hash("__line").alias("__h2"), "doc_id", "__row", "__pos"), "lines")
    total = hashed.count()
    key = ["__h", "__h2"]
    hot_keys = hashed.groupBy(*key).count().where(F.col("count") > max(hot_limit(docs, total), min_docs)).select(*key)
    hot_keys = kept(hot_keys, "hot-lines")
    hot = hashed.join(F.broadcast(hot_keys), key)
    # A document's repeats of a key go first, each in its own task; what is left are sums a key.
    hot = hot.groupBy(*key, "doc_id").agg(F.count("*").alias("n")).groupBy(*key).agg(F.count("*").alias("__docs"), F.max("doc_id").alias("__stays"))
    hot_rows = hashed.join(F.broadcast(hot), key).select("__row", "__pos", "doc_id", "__docs", "__stays")
    cold = hashed.join(F.broadcast(hot_keys), key, "left_anti").repartitionByRange(parallelism(docs), "__h")
    in_order = W.partitionBy("__h", "__h2").orderBy(F.desc_nulls_last("doc_id"), "__row", "__pos")
    of_key = W.partitionBy("__h", "__h2").orderBy(F.desc_nulls_last("doc_id"), "__row", "__pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = in_order.rowsBetween(W.unboundedPreceding, W.currentRow)
    before = F.lag(F.struct("doc_id")).over(in_order)  # of the first line null, of a null id a struct that holds null
    new_doc = F.when(before.isNotNull() & before["doc_id"].eqNullSafe(F.col("doc_id")), 0).otherwise(1)
    streamed = cold.withColumn("__stays", F.first("doc_id").over(first)).withColumn("__new", new_doc).withColumn("__docs", F.sum("__new").over(of_key))
    rows = hot_rows.unionByName(streamed.select("__row", "__pos", "doc_id", "__docs", "__stays"))
    gone = rows.where((F.col("__docs") >= min_docs) & ~F.col("doc_id").eqNullSafe(F.col("__stays")))
    return gone.groupBy(F.col("doc_id").alias("__id"), "__row").agg(F.array_sort(F.collect_set("__pos")).alias("__drop"))


def keep_runs(n_lines: Column, drop: Column) -> Column:
    """Kept lines as runs (first, length): the gaps between dropped positions."""
    edges = F.concat(F.array(F.lit(-1)), drop, F.array(n_lines))
    gaps = F.zip_with(F.slice(edges, 1, F.size(edges) - 1), F.slice(edges, 2, F.size(edges) - 1), lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).alias("length")))
    return F.filter(gaps, lambda run: run["length"] > 0)


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """documents -> their columns and n_lines, n_dropped, keep (runs of kept lines), kept_text.

    A key (a line stripped of white space at its ends, A-Z lower-cased) of at least `min_chars` code points that at least
    `min_docs` documents hold loses all its lines but those in the largest doc_id that holds it. A null or empty text is
    one empty line. Rows of one doc_id are one document when holders are counted, and all of the largest keep their
    lines, those that a row repeats too. A null doc_id counts as one document and is smaller than all others. Ties cannot be: ids
    are compared, not rows. Very long texts are exploded into lines and never gathered but by the positions that
    they lose. An empty table gives no rows. Columns of the names above are replaced, all others stay as they are.
    """
    docs = docs.drop("n_lines", "n_dropped", "keep", "kept_text")
    drops = dropped_lines(docs, min_chars, min_docs)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    out = docs.withColumn("__row", _row_key()).join(drops.withColumnRenamed("__row", "__its"), (F.col("__row") == F.col("__its")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    n_lines = F.size(lines)
    drop = F.coalesce("__drop", F.array().cast("array<int>"))
    out = out.withColumn("n_lines", n_lines.cast("long")).withColumn("n_dropped", F.size(drop).cast("long")).withColumn("keep", keep_runs(n_lines, drop))
    kept_lines = F.flatten(F.transform("keep", lambda run: F.slice(lines, run["first"] + 1, run["length"])))
    kept_text = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept_lines, "\n"))
    return out.withColumn("kept_text", kept_text).drop("__row", "__its", "__id", "__drop")
