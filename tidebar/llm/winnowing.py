"""Document fingerprints by winnowing (DataFrame functions only).

A text's words give rolling hashes of k words (cyclic polynomial: rotate and xor, so that a gram of a + b words comes from
its parts). Every window of w grams keeps its smallest hash, on ties the rightmost, with its position. Two texts that
share w + k - 1 words in a row share a kept hash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import WORD, parallelism

GRAM, WINDOW = 5, 4
#: Characters of scripts that are written without spaces (South East Asian, kana, Han): ranges of Unicode blocks.
UNSPACED = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF\x{20000}-\x{3FFFF}"
#: A token is a word of up to 16 letters of other scripts; a longer run, and unspaced scripts, go character by character.
LETTER = rf"[^\x20\x09-\x0D{UNSPACED}]"
TOKEN = rf"(?<!{LETTER}){LETTER}{{1,16}}(?!{LETTER})|[^\x20\x09-\x0D]"
#: Stands before a text GRAM - 1 times.
START = 0x1D8E4E27C47D124F
LOW = 0x7FFFFFFF


def _rotate(x: Column, by: int) -> Column:
    return F.shiftleft(x, by % 64).bitwiseOR(F.shiftrightunsigned(x, 64 - by % 64))


def _join(by: int):
    return lambda a, b: _rotate(a, by).bitwiseXOR(b)


def _shifted(a: Column, b: Column, by: int, f) -> Column:
    """f of a[i] and b[i + by] for all i where both are."""
    n = F.greatest(F.least(F.size(a), F.size(b) - by), F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, by + 1, n), f)


def with_fingerprint(df: DataFrame, text: str, name: str, gram: int = GRAM, window: int = WINDOW, word: str = WORD) -> DataFrame:
    """df with `name`: array<struct<hash long, position int>>, in order of position (of a gram's last word, from 0).

    Words are what `word` matches (runs without white space), in lower case. Every text has a mark before it gram - 1 times,
    so a gram ends at each word and texts of any length are treated alike: a short text and the same with a word more share
    all grams but one. Fewer grams than `window` are one window; a null text or one without words has no hashes. Of equal hashes in a window the rightmost is kept. Texts of
    any length are hashed whole; repeated rows alike. Columns of the name are replaced, others stay. Each step is a column
    of its own so that it is computed once.
    """
    c = lambda s: f"__{name}_{s}"
    out = df.withColumn(c("words"), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(word), F.lit(0)))
    marks = F.array_repeat(F.lit(START), gram - 1)
    out = out.withColumn(c("1"), F.concat(marks, F.transform(c("words"), lambda w: F.xxhash64(w))))
    have, done = 1, [c("words"), c("1")]
    for bit in bin(gram)[3:]:  # from the second highest bit: double, and add one word where it is set
        col = c(f"g{2 * have}")
        out = out.withColumn(col, _shifted(F.col(done[-1]), F.col(done[-1]), have, _join(have)))
        done.append(col)
        have *= 2
        if bit == "1":
            col = c(f"g{have + 1}")
            out = out.withColumn(col, _shifted(F.col(done[-1]), F.col(c("1")), have, _join(1)))
            done.append(col)
            have += 1
    out = out.withColumnRenamed(done.pop(), c("h"))
    # The hash's upper 31 bits, then the position upside down: the least is the smallest hash, and the rightmost of equals.
    out = out.withColumn(c("k1"), F.transform(c("h"), lambda x, i: F.shiftleft(F.shiftrightunsigned(x, 33), 32).bitwiseOR(F.lit(LOW).cast("long") - i)))
    done += [c("h"), c("k1")]
    have = 1
    while have < window:
        by = min(have, window - have)
        col = c(f"k{have + by}")
        out = out.withColumn(col, _shifted(F.col(done[-1]), F.col(done[-1]), by, lambda a, b: F.least(a, b)))
        done.append(col)
        have += by
    few = F.size(c("k1")).between(1, window - 1)
    picked = F.when(few, F.array(F.array_min(c("k1")))).otherwise(F.array_distinct(done[-1]))
    out = out.withColumn(c("p"), F.transform(picked, lambda k: (F.lit(LOW).cast("long") - k.bitwiseAND(F.lit(LOW).cast("long"))).cast("int")))
    out = out.withColumn(name, F.transform(c("p"), lambda p: F.struct(F.element_at(c("h"), p + 1).alias("hash"), p.alias("position"))))
    return out.drop(*done, c("p"))


def with_marks(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with `name`, the fingerprint over tokens: any GRAM + WINDOW - 1 equal tokens in a row share a hash."""
    return with_fingerprint(df, text, name, word=TOKEN)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two hash arrays without repeats; of two empty ones 1."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both / every)


def hashes(fingerprint: str | Column) -> Column:
    column = F.col(fingerprint) if isinstance(fingerprint, str) else fingerprint
    return F.array_distinct(F.transform(column, lambda x: x["hash"]))


def digest(fingerprint: str) -> Column:
    """32 hexadecimal digits for the hashes and positions of a fingerprint."""
    of = lambda field, salt: F.lpad(F.hex(F.xxhash64(F.lit(salt), F.transform(fingerprint, lambda x: x[field]))), 16, "0")
    return F.lower(F.concat(of("hash", 1), of("position", 2)))


def _text_order() -> Column:
    """Where rows without id stand among each other: by a hash of the text, so that texts that begin alike are dealt evenly."""
    return F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(0)


def _upto(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most value: first among every root-th of them, then in that piece."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds) - 1) + 1
    literal = lambda values, kind="array<bigint>": F.from_json(F.lit(json.dumps(values)), kind)
    count = lambda values: F.size(F.filter(values, lambda b: b <= value))
    pieces = literal([bounds[i : i + step] for i in range(0, len(bounds), step)], "array<array<bigint>>")
    coarse = F.greatest(count(literal(bounds[::step])) - 1, F.lit(0))
    return coarse * step + count(F.element_at(pieces, coarse + 1))


def _with_range(docs: DataFrame, ranges: int) -> tuple[DataFrame, int]:
    """docs with __range, and how many ranges there are: ranges of ids cut at quantiles, and below these, of null ids, of texts' hashes."""
    points = [i / ranges for i in range(1, ranges)]
    null = F.col("doc_id").isNull()
    cuts = lambda value: F.percentile_approx(value, points, 10 * ranges)
    ids, texts = docs.agg(cuts(F.col("doc_id")), cuts(F.when(null, _text_order()))).first() if points else (None, None)
    ids, texts = sorted(set(ids or [])), sorted(set(texts or []))
    number = F.when(null, len(texts) - _upto(texts, _text_order())).otherwise(len(texts) + 1 + _upto(ids, F.col("doc_id")))
    return docs.withColumn("__range", number.cast("int")), len(texts) + len(ids) + 2


def with_next(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, text (null: empty), fingerprint, next (struct of text and fingerprint of the next document).

    The next document has the next smaller id (of equal ids the next larger text; null ids come last, by a hash of their texts), after the last
    comes the first; a lone document follows itself. Ranges of ids, cut at quantiles, are sorted each by itself; the
    first document of each range, one row a range, is handed to the range before it, and there to the last document. Rows that repeat all follow each
    other; very long texts are whole; an empty table gives no rows; other columns are not returned.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs, ranges = _with_range(docs, parallelism(docs))
    tops = docs.groupBy("__range").agg(F.max("doc_id").alias("__top"))
    by_range = W.orderBy(F.desc("__range"))
    after = tops.select("__range", F.coalesce(F.lead("__range").over(by_range), F.first("__range").over(by_range)).alias("__after"))
    firsts = docs.join(F.broadcast(tops.withColumnRenamed("__range", "__after")), (F.col("__range") == F.col("__after")) & F.col("doc_id").eqNullSafe(F.col("__top")))
    # The first document of the range that follows goes to the end of each range, so that one window sees all neighbours.
    tails = firsts.groupBy("__after").agg(F.min_by("text", F.struct(_text_order(), "text")).alias("text")).join(F.broadcast(after), "__after")
    rows = docs.withColumn("__tail", F.lit(0)).unionByName(tails.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "__range", F.lit(1).alias("__tail")))
    spread = with_marks(rows.repartitionById(ranges, "__range"), "text", "fingerprint")
    order = W.partitionBy("__range").orderBy("__tail", F.desc_nulls_last("doc_id"), _text_order(), "text")
    led = spread.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(order))
    return led.where("__tail = 0").select("doc_id", "text", "fingerprint", "next")
