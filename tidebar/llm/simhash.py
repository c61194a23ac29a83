"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints of 64 bits that differ in at most 3 bits have a half of 32 bits that differs in at most 1: half the
radius. So every distinct fingerprint emits, for each half, all variants of that half within one flipped bit; fingerprints
that meet on a variant are compared in full.

Halves that many fingerprints share (large groups of near copies) would give all pairs of a group. There the other half
is hashed too: a fingerprint emits its balls of radius 1 and 2 (of two flips, only those within one of the half's two
quarters: of three differing bits two lie in the same one). Who meets there is near enough by the triangle inequality, so a
star of links to one of them keeps them connected, and no bucket can hold more than some 1,400 distinct fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import join_skewed, kept

RADIUS = 3
SHINGLE = 3
SEED = 42
#: A half of more distinct fingerprints than this is split by its other half.
CROWDED = 64
HALF = 0xFFFFFFFF


def simhash(text: str, width: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number; a text without words has 0."""
    import numpy as np
    import xxhash

    words = text.encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    for at in range(0, n, 1 << 15):
        some = words[at : at + (1 << 15) + width - 1]
        if len(some) < width:
            values = [digest(join(some), SEED)]
        else:
            values = [digest(join(x), SEED) for x in zip(*(some[i:] for i in range(width)))]
        ones += np.unpackbits(np.array(values, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def fingerprints(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, row, fp long); row is a hash of id and text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([simhash(x or "") for x in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), found], ["doc_id", "row", "fp"])

    return docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(each, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row long, fp long")


def _flips(value: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: value.bitwiseXOR(m)))


ONE = [0, *(1 << i for i in range(32))]
TWO = [1 << i | 1 << j for quarter in (0, 16) for i in range(quarter, quarter + 16) for j in range(quarter, i)]


def near_links(prints: DataFrame) -> DataFrame:
    """Distinct (fp) -> (a, b), a < b: links that connect all fingerprints that differ in at most 3 bits."""
    low, high = F.col("fp").bitwiseAND(F.lit(HALF)), F.shiftrightunsigned("fp", 32)
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), low.alias("half"), high.alias("other")), F.struct(F.lit(1).alias("side"), high.alias("half"), low.alias("other"))))
    exact = prints.select("fp", sides.alias("s")).select("fp", "s.*")
    counts = exact.groupBy("side", "half").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    counts = kept(counts.withColumn("crowded", F.lit(True)), "crowded-halves")
    total = 2 * prints.count()
    marked = kept(join_skewed(exact, counts, ["side", "half"], "n", total).fillna(False, ["crowded"]), "halves")

    variants = marked.select("side", F.col("fp").alias("a"), "half", "other", _flips(F.col("half"), ONE).alias("meet"))
    light = marked.where(~F.col("crowded")).select("side", F.col("half").alias("meet"), F.col("fp").alias("b"))
    pairs = variants.join(light, ["side", "meet"]).where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS))
    links = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if counts.isEmpty():
        return links.distinct()

    # Around each crowded half: its own fingerprints (balls of radius 1 and 2) and those one bit away (radius 1).
    own = marked.where("crowded").select("side", F.col("half").alias("meet"), "fp", "other")
    nearby = join_skewed(variants.where("half != meet").withColumnsRenamed({"half": "from", "meet": "half", "a": "fp"}), counts, ["side", "half"], "n", 33 * total)
    nearby = nearby.where("crowded").select("side", F.col("half").alias("meet"), "fp", "other")
    rows = (
        own.select("side", "meet", "fp", _flips(F.col("other"), ONE).alias("ball"), F.col("fp").alias("center"))
        .unionByName(own.select("side", "meet", "fp", _flips(F.col("other"), TWO).alias("ball"), F.lit(None).cast("long").alias("center")))
        .unionByName(nearby.select("side", "meet", "fp", _flips(F.col("other"), ONE).alias("ball"), F.lit(None).cast("long").alias("center")))
    )
    star = rows.withColumn("center", F.min("center").over(W.partitionBy("side", "meet", "ball"))).where("center is not null and center != fp")
    return links.unionByName(star.select(F.least("center", "fp").alias("a"), F.greatest("center", "fp").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node reachable, by passing labels along links and then following labels."""
    both = kept(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links")
    labels = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        passed = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("heard"))
        heard = labels.join(passed, "node").select("node", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        heard = kept(heard, "heard")
        uses = heard.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n"))
        roots = uses.join(heard.select("node", F.col("label").alias("jump")), "node").withColumnRenamed("node", "label")
        jumped = join_skewed(heard, roots, ["label"], "n", heard.count()).select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label"))
        labels = kept(jumped, "labels")
        if labels.where("was != label").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """documents -> (doc_id, row, fp long, root, component_id): the smallest doc_id reachable over links, itself included.

    A null text counts as empty; all texts without words share fingerprint 0. Null ids are left out of the smallest
    (a component of null ids alone has null). Rows that repeat an id are rows of the result too; an empty table gives
    none.
    """
    prints = kept(fingerprints(docs), "fingerprints")
    groups = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("doc"), F.count("*").alias("n")), "groups")
    labels = components(near_links(groups.select("fp")))
    rooted = groups.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("label", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "n", "root", "component_id")
    return join_skewed(prints, named, ["fp"], "n", prints.count())


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def dedup_near(docs: DataFrame) -> DataFrame:
    """documents -> the rows that stay: of each component the one with the smallest id (null ids last, then by a hash)."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    key = ["__row", "__null", "__id"]
    # Null-safe keys as columns, so that the window needs no other shuffle than the join.
    keyed = lambda df, row: df.withColumns({"__row": row, "__null": F.col("doc_id").isNull(), "__id": F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType))})
    stays = near_duplicates(docs).groupBy("root").agg(first.alias("__s")).select("__s.row", "__s.doc_id")
    once = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    return keyed(docs, row_hash()).join(keyed(stays, F.col("row")).select(*key), key, "left_semi").withColumn("__n", once).where("__n = 1").drop("__n", *key)
