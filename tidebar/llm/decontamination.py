"""Benchmark decontamination by size-partitioned MinHash containment search.

Jaccard-based MinHash fails where a short item lies in a long document. Here only the item is sketched: its bottom-k
MinHash values are looked up among the document's shingles, and the share that is found estimates the containment whatever
the document's size. Items are partitioned by size (powers of two); each partition's k is one more than the number of
shingles that an item of that size may miss at the wanted containment, so an item that is contained always has a sketch
value in the document. Candidates are verified by exact containment of the shingles' texts.

The number of sketch values that a document has must be what the wanted containment leaves of them at least, so the
estimate rejects most others before any text is compared, and never a contained item.

A filter over all items' shingles leaves few of a document's shingles to be shuffled. It grows with the items up to a
fixed size; with more items it fills up and lets more pass; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import join_skewed, kept

SHINGLE, CONTAINMENT = 5, 0.8
#: Bits of the filter for each shingle, and of all of it at least and at most (16 MB): a bound of what is sent to each task.
SHINGLE_BITS, LEAST_BITS, MOST_BITS = 256, 1 << 23, 1 << 27
#: Up to so many sketch values are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters, marks and digits; punctuation only separates."""
    import regex

    global _WORDS
    _WORDS = globals().get("_WORDS") or regex.compile(r"[\p{L}\p{M}\p{N}]+")
    return _WORDS.findall((text or "").lower())


def shingles_of(words: list[str], width: int) -> Iterator[str]:
    return map(" ".join, zip(*(words[i:] for i in range(width))))


def item_shingles(items: DataFrame, width: int = SHINGLE) -> DataFrame:
    """items -> (item_id, width int, shingles array<string>), without repeats; items without words are left out.

    An item of fewer than `width` words is one shingle of all its words.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, widths, found = [], [], []
            for key, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                if words := words_of(text):
                    ids.append(key)
                    widths.append(min(width, len(words)))
                    found.append(sorted(set(shingles_of(words, widths[-1]))))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("item_id").type), pa.array(widths, pa.int32()), pa.array(found, pa.list_(pa.string()))], ["item_id", "width", "shingles"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(each, f"item_id {kind}, width int, shingles array<string>")


def _filter_of(shingles: DataFrame) -> bytes:
    """A bit for each shingle's hash; a power of two of bits, at most MOST_BITS / 64 rows come to the driver."""
    import numpy as np

    n = shingles.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (SHINGLE_BITS * n).bit_length()))
    bit = F.pmod(F.xxhash64("shingle"), F.lit(size))
    rows = shingles.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(shingle), {size}) % 64 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.int64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return words.view(np.uint8).tobytes()


def found_shingles(docs: DataFrame, bits: bytes, widths: list[int]) -> DataFrame:
    """documents -> (doc_id, row, shingles): those of its shingles, without repeats, that the filter lets pass."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        table, digest = np.frombuffer(sent.value, np.uint8), xxhash.xxh64_intdigest
        mask = 8 * len(table) - 1
        for b in batches:
            ids, rows, found = [], [], []
            for key, row, text in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                words, passed = words_of(text), set()
                for width in widths:
                    for at in range(0, max(0, len(words) - width + 1), 1 << 15):
                        some = list(shingles_of(words[at : at + (1 << 15) + width - 1], width))
                        h = np.fromiter((digest(x, 42) for x in some), np.uint64, len(some)) & np.uint64(mask)
                        passed.update(some[i] for i in np.flatnonzero(table[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1))
                if passed:
                    ids.append(key)
                    rows.append(row)
                    found.append(sorted(passed))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field("doc_id").type), pa.array(rows, pa.int64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "row", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(each, f"doc_id {kind}, row long, shingles array<string>")


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def find_leaks(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, width: int = SHINGLE) -> DataFrame:
    """-> (doc_id, row, item_id, item_ids, n_shingles, n_found, containment) for each document and contained item.

    Items with the same shingles are one: item_id is the smallest (null if all are), item_ids has all that aren't null. An
    item without an id is searched like others. Null or empty texts contain nothing and are contained nowhere. Rows that
    repeat an id are searched each, rows that repeat all too; ties of the sketch's hashes are broken by the text. A very
    long document is read whole, in pieces of shingles. An empty table on either side gives no rows; other columns are
    not looked at.
    """
    items = item_shingles(items, width).groupBy("shingles", "width").agg(F.min("item_id").alias("item_id"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    # An item's key: 128 bits of its shingles.
    items = kept(items.withColumn("n", F.size("shingles")).withColumn("item", F.md5(F.array_join("shingles", "\n").cast("binary"))), "items")
    widths = sorted(r["width"] for r in items.select("width").distinct().collect())
    one = items.select("item", F.explode("shingles").alias("shingle"))
    hits = kept(found_shingles(docs, _filter_of(one), widths), "hits")

    # Sketches: in each size partition as many smallest hashes as can't all be missing; `least` of them are found.
    top = F.pow(F.lit(2), F.floor(F.log2("n")) + 1) - 1
    size_k = F.floor(top * (1 - containment) + 1e-9).cast("int") + 1
    least = F.least(size_k, "n") - F.floor(F.col("n") * (1 - containment) + 1e-9).cast("int")
    in_order = F.array_sort(F.transform("shingles", lambda s: F.struct(F.xxhash64(s).alias("h"), s.alias("shingle"))))
    sketch = items.select("item", least.alias("least"), F.explode(F.slice(in_order, F.lit(1), F.least(size_k, "n"))).alias("s"))
    sketch = kept(sketch.groupBy(F.col("s.shingle").alias("shingle")).agg(F.collect_list(F.struct("item", "least")).alias("of")), "sketch")
    keyed = hits.select("doc_id", "row", F.explode("shingles").alias("shingle"))
    if sketch.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        keyed = keyed.join(F.broadcast(sketch), "shingle")
    else:
        uses = kept(keyed.groupBy("shingle").agg(F.count("*").alias("uses")).join(sketch, "shingle"), "uses")
        keyed = join_skewed(keyed, uses, ["shingle"], "uses", hits.agg(F.sum(F.size("shingles"))).first()[0] or 0).where(F.col("of").isNotNull())
    keyed = keyed.select("doc_id", "row", F.explode("of").alias("s")).select("doc_id", "row", "s.*")
    found = keyed.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("its"), "item", "least").agg(F.count("*").alias("n_sketch"))
    candidates = kept(found.where(F.col("n_sketch") >= F.col("least")).select("id", "its", "item"), "leak-candidates")
    wanted = kept(candidates.groupBy("item").agg(F.count("*").alias("uses")).join(items.withColumnRenamed("shingles", "wanted"), "item"), "wanted")
    # Items that very many documents may hold are broadcast, by join_skewed, so that none of them is one task's.
    pairs = join_skewed(candidates, wanted, ["item"], "uses", candidates.count())
    verified = pairs.join(hits, (F.col("row") == F.col("its")) & F.col("doc_id").eqNullSafe(F.col("id")))
    n_found = F.size(F.array_intersect("shingles", "wanted"))
    verified = verified.select("doc_id", "row", "item_id", "item_ids", F.col("n").cast("long").alias("n_shingles"), n_found.cast("long").alias("n_found"), (n_found / F.col("n")).alias("containment"))
    return verified.where(F.col("containment") >= containment - 1e-9)


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """documents -> those without any contained item, columns as given; odd rows as for find_leaks, and null or empty texts stay."""
    leaks = find_leaks(docs, items, containment).select(F.col("row").alias("__its"), F.col("doc_id").alias("__id")).distinct()
    leaked = (F.col("__row") == F.col("__its")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    return docs.withColumn("__row", row_hash()).join(leaks, leaked, "left_anti").drop("__row")
