"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.alignment import align
from tidebar.llm.common import fresh_path, table
from tidebar.llm.decontamination import find_leaks
from tidebar.llm.divergence import divergence
from tidebar.llm.language_id import identify
from tidebar.llm.line_dedup import dedup_lines
from tidebar.llm.lm_scoring import score
from tidebar.llm.mixing import mix
from tidebar.llm.simhash import hex_print, near_duplicates
from tidebar.llm.substring_dedup import find_repeats
from tidebar.llm.token_counts import count_edits
from tidebar.llm.toxicity import toxicity
from tidebar.llm.warc import read_warc, write_warc
from tidebar.llm.winnowing import digest, hashes, likeness, with_marks, with_next


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("item_ids").alias("same_items"), "n_shingles", "n_found", "containment")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_print(F.col("fp")).alias("fingerprint"), "component_id")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three edits a document: its first 20 characters inserted at a quarter, 16 replaced in the middle, 10 cut at three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    edit = lambda start, end, new: F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("new"))
    quarter, middle, late = F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4)
    edits = F.array(edit(quarter, quarter, F.substring("text", 1, 20)), edit(middle, middle + 16, F.lit(" edited here, twice ")), edit(late, late + 10, F.lit("")))
    out = count_edits(docs.withColumn("edits", edits))
    return out.select("doc_id", "n_tokens", "n_tokens_edited", "n_encoded_again", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_repeats(table(spark, sf_dir, "documents"))
    cut = F.aggregate("cuts", F.lit(0).cast("long"), lambda total, c: total + c["n_chars"])
    return out.select(F.col("doc").alias("doc_id"), F.col("first_doc").alias("first_doc_id"), "start", "n_chars", "n_words", cut.alias("n_chars_dropped"))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_next(table(spark, sf_dir, "documents"))
    n_chars = F.char_length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next.text", F.lit(1), half))
    out = with_marks(out.withColumn("edited", edited), "edited", "edited_print")
    # Own hash sets as columns, so that both likenesses use them.
    out = out.select("doc_id", n_chars.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digest("fingerprint").alias("fingerprint"), digest("edited_print").alias("edited_fingerprint"), F.size("fingerprint").cast("long").alias("n_hashes"), hashes("fingerprint").alias("__own"), hashes("edited_print").alias("__edited"), hashes(F.col("next.fingerprint")).alias("__next"))
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("__own"), F.col("__edited")).alias("near_edited"), likeness(F.col("__own"), F.col("__next")).alias("near_next"), "n_hashes")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_line_dedup": op3_line_dedup,
    "op4_decontamination": op4_decontamination,
    "op5_simhash": op5_simhash,
    "op6_token_counts": op6_token_counts,
    "op7_language_id": op7_language_id,
    "op8_source_mixing": op8_source_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_winnowing": op10_winnowing,
    "op11_divergence": op11_divergence,
    "op12_alignment": op12_alignment,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op3_line_dedup": r"""
        with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
        l as (select doc_id, i, ls[i] as line,
                     translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
              from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from d)),
        g as (select k, max(doc_id) as stays from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
        select l.doc_id, count(*) as n_lines,
               count(*) filter (g.k is not null and l.doc_id <> g.stays) as n_dropped,
               sha256(coalesce(string_agg(l.line, chr(10) order by l.i) filter (g.k is null or l.doc_id = g.stays), '')) as kept_sha256
        from l left join g using (k) group by l.doc_id""",
    "op8_source_mixing": r"""
        with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                          ('0x' || substr(md5(concat(doc_id, chr(10), md5(coalesce(text, '')))), 1, 15))::bigint as h
                   from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source is null, source) - 1 as r from d group by source),
        w as (select *, [3, 1, 2][r % 3 + 1] as w, 2.0 * source_size / w as ratio from s),
        x as (select *, 1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over before, 0) as rest,
                     sum(w) over () - coalesce(sum(w) over before, 0) as ws
              from w window before as (order by ratio, r rows between unbounded preceding and 1 preceding)),
        v as (select arg_min(rest / ws, (ratio, r)) as level from x where ratio * ws > rest),
        t as (select source, source_size, coalesce(least(2.0::double * source_size, level * w), 2.0::double * source_size) as target,
                     case when source_size > 0 then floor(target / source_size)::bigint else 0 end as base,
                     target - base * source_size as budget
              from x, v),
        g as (select source, h, sum(size) as gs from d group by 1, 2),
        c as (select source, h, gs, sum(gs) over (partition by source order by h) as upto from g),
        m as (select c.source, max(h) as last from c join t on c.source is not distinct from t.source
              where upto <= budget or upto - budget < budget - upto + gs group by 1)
        select d.doc_id, d.size, t.source_size, t.target,
               (d.size * (base + (d.h <= coalesce(m.last, -1))::bigint))::bigint as taken
        from d join t on d.source is not distinct from t.source left join m on d.source is not distinct from m.source""",
    "op11_divergence": r"""
        with d as (select coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as r from documents),
        w as (select lang, source, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
        k as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 3),
        v as (select lang, count(*) as v, sum(total) as n from k group by lang),
        c as (select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by all),
        s as (select distinct lang, source from d),
        g as (select s.lang, s.source, coalesce(sum(c.n), 0) as n from s left join c using (lang, source) group by all),
        p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.n + v.v))::hugeint as p,
                     (1 + 1000000000::hugeint * (k.total + 1) // (v.n + v.v))::hugeint as q
              from g join k using (lang) join v using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
        a as (select x.lang, x.source, 'pair' as part, y.source as item,
                     coalesce((select sum((f.p - t.p) * (f.p - t.p) // t.p) from p f join p t using (lang, term) where f.lang = x.lang and f.source = x.source and t.source = y.source), 0)::bigint as value
              from s x join s y on x.lang = y.lang and x.source <> y.source),
        b as (select lang, source, 'term' as part, term as item, ((p - q) * (p - q) // q)::bigint as value from p where n > 0 and p > q),
        r as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from a union all select * from b))
        select * from r where part = 'pair' or rank <= 200""",
}
