import zlib

import pytest
from pyspark.sql.functions import lit

import corpus_pipeline
from tests.llm.helpers import frame, odd_rows, sentence
from tests.llm.test_text_operators import FIVE, WORDS, language_rows


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    line = "\nthis very line of boilerplate is found in a good many documents"
    passage = " ".join(WORDS["en"].split()[i % 11] for i in range(3, 40, 3))
    rows = [(i, f"{x} {sentence(i, 40, 3000)}" + line * (i % 3 == 0), k, f"s{i % 3}") for i, x, k in language_rows()]
    rows += [(1000, rows[5][1], "en", "s1"), (1001, f"{sentence(3, 30)} {passage} {sentence(4, 30)} {WORDS['en']}", "en", "s2"), (1002, "12 34", "en", "s1")]
    rows += [(2000 + k, *r[1:]) for k, r in enumerate(odd_rows())]
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns or k == 4
    assert 1002 not in kept["language_id"] and 5 in kept["language_id"]
    assert sum("boilerplate" in (x or "") for x in kept["line_dedup"].values()) == 1
    assert 1000 not in kept["simhash_dedup"] and 5 in kept["simhash_dedup"]
    assert 1001 in kept["simhash_dedup"] and 1001 not in kept["decontamination"]
    assert len(kept["language_id"]) > 230 and kept["source_mixing"]


def test_odd_rows_in_each_stage(spark, sf):
    """What each stage's docstring says of nulls, empties, repeats and long texts, each on the odd rows alone."""
    docs = frame(spark, [(2000 + k, *r[1:]) if r[0] is not None else r for k, r in enumerate(odd_rows())]).select("doc_id", "text", "lang", "source", "n_chars")
    twice = docs.unionByName(docs)
    ids = lambda stage, some=twice: sorted(repr((r["doc_id"], r["text"])) for r in stage(spark, some, sf).collect())
    every = sorted(repr((r["doc_id"], r["text"])) for r in twice.collect())
    assert ids(corpus_pipeline.language_id) == []  # none has a lang
    assert ids(corpus_pipeline.line_dedup) == every
    kept = corpus_pipeline.simhash_dedup(spark, twice, sf).collect()
    assert sorted(r["doc_id"] for r in kept if (r["text"] or "").strip() == "") == [2000] and len({r["text"] for r in kept}) == len(kept)
    assert ids(corpus_pipeline.decontamination) == every
    mixed = corpus_pipeline.source_mixing(spark, twice, sf).collect()
    assert all(r["copies"] in (1, 2) for r in mixed) and abs(sum(r["taken"] for r in mixed) - 1.5 * 2 * sum(len((r["text"] or "").split()) for r in docs.collect())) <= 40_000


def test_run_equals_the_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    rows = lambda df: sorted((r["doc_id"], r["taken"]) for r in df.collect())
    assert rows(corpus_pipeline.run(spark, sf)) == rows(docs)


def test_stages_on_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_columns_with_names_of_the_operators_stay(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clash = {c: lit(f"mine {c}") for c in ("score", "lang_pred", "held_out", "keep", "kept_text", "n_lines", "n_dropped", "row", "fp", "root", "n")}
    docs = docs.withColumns(clash)
    for _, stage in corpus_pipeline.STAGES[:4]:
        columns = docs.columns
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    assert all(r[c] == f"mine {c}" for r in docs.limit(50).collect() for c in clash)


def test_a_text_of_five_languages_stays(spark):
    rows = [(i, FIVE[i % 5], f"l{i % 5}", "s") for i in range(40)] + [(100, " ".join(FIVE), "l0", "s"), (101, "\u4e00\u4e01\u4e02 \u4e03\u4e04\u4e05 " * 9, "l0", "s")]
    rows = [r for r in rows if r[0] != 101] + [(next(i for i in range(101, 200) if zlib.crc32(str(i).encode()) % 5 == 0), *rows[-1][1:])]
    out = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame(spark, rows), "").collect()}
    assert out == set(range(40)) | {100}
