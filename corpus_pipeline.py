"""The corpus pipeline: documents through five operators, each stage over what the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import kept
from tidebar.llm.decontamination import decontaminate
from tidebar.llm.language_id import UNDETERMINED, identify
from tidebar.llm.line_dedup import dedup_lines
from tidebar.llm.mixing import mix
from tidebar.llm.simhash import dedup_near


def shielded(docs: DataFrame, used: list[str]) -> tuple[DataFrame, list]:
    """docs with the columns that an operator doesn't use under names that it can't replace, and how to select them back."""
    names = {c: f"__in{k}" for k, c in enumerate(docs.columns) if c not in used}
    return docs.withColumnsRenamed(names), [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no language that was learned, or without letters, go; several languages may share a text.

    A null or empty text has no letters and goes; a null lang is not learned from, a null doc_id is held out; repeated
    rows stay or go together; a very long text is judged whole; ties of languages don't matter here. Without any lang to
    learn from, all go. An empty table gives no rows. All columns stay, also those with names that the operator uses.
    """
    docs, columns = shielded(docs, ["doc_id", "text", "lang"])
    return identify(docs).where((F.col("lang_pred") != UNDETERMINED) & F.col("fits")).select(*columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their repeated lines, n_chars follows; documents of which nothing is left go.

    A null or empty text has one empty line and stays as it is, with the n_chars it came with. Rows of one doc_id are one
    document when holders are counted, a null doc_id is the smallest one; of several holders the largest doc_id keeps a
    line, in all its rows, so there are no ties. Very long texts lose lines like others. An empty table gives no rows.
    All columns stay, also those with names that the operator uses.
    """
    kind = docs.schema["n_chars"].dataType
    docs, columns = shielded(docs, ["doc_id", "text", "n_chars"])
    out = dedup_lines(docs)
    n_chars = F.char_length("kept_text").cast(kind)
    changed = out.withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    changed = changed.withColumn("n_chars", F.when(F.col("n_dropped") > 0, n_chars).otherwise(F.col("n_chars")))
    return changed.where((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines"))).select(*columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays.

    Null, empty and wordless texts are one group. Null ids stay only where a group has no others; of rows of one id the
    one of the smaller hash stays, of repeated rows one. Very long texts have fingerprints like others. An empty table
    gives no rows. All columns stay, also those with names that the operator uses.
    """
    return dedup_near(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go.

    Null or empty texts, and items without words, contain nothing and stay; an item without an id counts like others.
    Repeated rows stay or go together; ties cannot be; very long texts are searched whole. An empty table on either side
    takes nothing away. All columns stay, also those with names that the operator uses.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies, size, target and words taken.

    A null source is a source of its own; a null or empty text has size 0 and stays only where its whole source is taken.
    Ties of the hash and repeated rows are taken or left together; a very long text is taken whole. An empty table gives no
    rows. Of clashing names (size, source_size, target, copies, taken) the stage's own columns are returned.
    """
    return mix(docs).where(F.col("copies") > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: Language models and SimHash components are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
