"""Substring dedup by content-defined chunking.

A gear hash rolls over the text's bytes and is read at the ends of words; of every WINDOW words in a row the one of the
smallest hash ends a chunk. So chunk ends depend on the bytes around them only, and two texts with a passage in common
have its chunks in common but for some words at its edges. Chunks are matched by a 64-bit digest across documents; runs of
matched chunks are where repeated passages may be. There every passage of `min_words` words is matched by its own digest,
so what is reported is held in one piece by another document. The first holder (the smallest id) keeps a passage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import SALTS, hot_limit, kept

#: Bytes that a chunk has at most, and words of which one ends a chunk.
MOST, WINDOW = 128, 8
#: Words before a passage's own that its hashes may depend on (16 bytes), and one at its end that punctuation may follow.
BEFORE, AFTER = 8, 1
MIN_WORDS = 50
#: One in so many documents, by a hash, is looked at to find very common digests.
LOOK = 64


@lru_cache(1)
def _gear():
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(bytes([i]), 7) & 0xFFFF for i in range(256)], np.uint16)


def words_of(raw):
    """Where the words of UTF-8 bytes (an array) begin and end."""
    import numpy as np

    word = np.concatenate([[False], ~((raw == 32) | ((raw >= 9) & (raw <= 13))), [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def chunk_ends(data: bytes, window: int = WINDOW) -> list[int]:
    """Ends of the chunks of UTF-8 bytes, the last of which is the length; none inside a character."""
    import numpy as np

    b = np.frombuffer(data, np.uint8)
    h = _gear()[b]
    for by in (1, 2, 4, 8):  # sums over 2, 4, 8 and 16 bytes, older bytes shifted further
        h = np.concatenate([h[:by], h[by:] + (h[:-by] << by)]) if len(h) > by else h
    at = words_of(b)[1]
    # The hash, then the number upside down: the least is the smallest hash, and the rightmost of equals.
    least = (h[at - 1].astype(np.int64) << 40) | ((1 << 40) - 1 - np.arange(len(at)))
    have = 1
    while have < window:
        by = min(have, window - have)
        least = np.minimum(least[:-by], least[by:])
        have += by
    cuts = at[np.unique((1 << 40) - 1 - (least & ((1 << 40) - 1)))].tolist()
    ends, last = [], 0
    for end in [*cuts, len(data)]:
        while end - last > MOST:
            last += MOST
            while data[last] & 0xC0 == 0x80:
                last -= 1
            ends.append(last)
        if end > last:
            ends.append(end)
            last = end
    return ends


def _once(digest, places: list):
    """A document's digests without repeats, in order of first place: which they are, and the later places of those that repeat."""
    import numpy as np

    distinct, first, inverse = np.unique(digest, return_index=True, return_inverse=True)
    if len(distinct) == len(digest):
        return None, [None] * len(digest)
    first.sort()
    also: dict[int, list] = {}
    at = {d: k for k, d in enumerate(digest[first].tolist())}
    for k in np.setdiff1d(np.arange(len(digest)), first).tolist():
        also.setdefault(at[int(digest[k])], []).append({name: int(x[k]) for name, x in places})
    return first, [also.get(k) for k in range(len(first))]


def chunks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, row, text) -> (digest, doc, row, idx, word, n_words, also) in order; word: the words that begin before the chunk.

    A chunk that a text repeats has one row; its other places are in `also`.
    """
    place = pa.struct([(x, pa.int32()) for x in ("idx", "word", "n_words")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest
        for b in batches:
            parts: list[list] = [[] for _ in range(6)]
            others: list = []
            for doc, row, text in zip(b.column("doc").to_pylist(), b.column("row").to_pylist(), b.column("text").to_pylist()):
                if not text:
                    continue
                data = text.encode()
                ends = chunk_ends(data, window)
                starts = [0, *ends[:-1]]
                word = np.searchsorted(words_of(np.frombuffer(data, np.uint8))[0], [0, *ends]).astype(np.int32)
                found = np.array([digest(data[i:j]) for i, j in zip(starts, ends)], np.uint64).view(np.int64)
                n = len(ends)
                columns = [found, np.full(n, doc), np.full(n, row), np.arange(n, dtype=np.int32), word[:-1], np.diff(word)]
                keep, also = _once(found, list(zip(("idx", "word", "n_words"), columns[3:])))
                for part, x in zip(parts, columns):
                    part.append(x if keep is None else x[keep])
                others += also
            if parts[0]:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(x)) for x in parts), pa.array(others, pa.list_(place))], ["digest", "doc", "row", "idx", "word", "n_words", "also"])

    kind = "digest long, doc long, row long, idx int, word int, n_words int, also array<struct<idx: int, word: int, n_words: int>>"
    return docs.select("doc", "row", "text").mapInArrow(each, kind)


def cores(raw):
    """Where the words of UTF-8 bytes begin and end without punctuation at either end."""
    import numpy as np

    inside = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
    begin, end = words_of(raw)
    inner = np.flatnonzero(inside[raw])
    i, j = np.searchsorted(inner, begin), np.searchsorted(inner, end)
    some = j > i
    begin[some], end[some] = inner[i[some]], inner[j[some] - 1] + 1
    return begin, end


def passages(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, row, number, text, spans) -> (digest, check, doc, row, number, word, also) of every `min_words` words in a row inside the spans.

    digest and check are 96 bits of a hash. spans are arrays of (first word, word after the last). Punctuation before the
    first word and after the last is left out. A passage that a text repeats has one row; its other places are in `also`.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh3_128_digest
        for b in batches:
            for doc, row, number, text, spans in zip(*(b.column(x).to_pylist() for x in ("doc", "row", "number", "text", "spans"))):
                data = text.encode()
                begin, end = cores(np.frombuffer(data, np.uint8))
                wanted = np.zeros(len(begin) + 1, np.int32)
                for x in spans:
                    first, last = max(0, x["first"]), min(len(begin), x["last"]) - min_words + 1
                    if first < last:
                        wanted[first] += 1
                        wanted[last] -= 1
                word = np.flatnonzero(np.cumsum(wanted) > 0)
                if not len(word):
                    continue
                starts, stops = begin[word], end[word + min_words - 1]
                found = np.frombuffer(b"".join([digest(data[x:y]) for x, y in zip(starts.tolist(), stops.tolist())]), np.int64).reshape(-1, 2)
                keep, also = _once(found[:, 0], [("word", word)])
                if keep is not None:
                    found, word = found[keep], word[keep]
                n = len(word)
                columns = (found[:, 0].copy(), found[:, 1].astype(np.int32), np.full(n, doc), np.full(n, row), np.full(n, number), word.astype(np.int32))
                later = pa.array([x and [y["word"] for y in x] for x in also], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in columns), later], ["digest", "check", "doc", "row", "number", "word", "also"])

    return docs.select("doc", "row", "number", "text", "spans").mapInArrow(each, "digest long, check int, doc long, row long, number long, word int, also array<int>")


def row_hash() -> Column:
    """With doc_number, tells rows apart."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def doc_number() -> Column:
    return F.coalesce(F.col("doc_id").try_cast("long"), row_hash())


def repeated(docs: DataFrame, rows_of: Callable[[DataFrame], DataFrame], columns: list[str], firsts: bool = False) -> DataFrame:
    """These columns of the rows of docs (one a document and digest) whose digest more than one document holds.

    With `firsts` also first, the smallest doc that holds it. Rows meet by digest. Very common digests, which one in LOOK
    documents shows and two of these hold, are spread over SALTS parts instead; their first holder is the smallest of the
    parts' ones.
    """
    some = rows_of(docs.where(F.pmod("row", F.lit(LOOK)) == 0)).groupBy("digest").agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b"))
    some = kept(some.where("n > 1"), "look")
    limit = max(hot_limit(docs, some.agg(F.sum("n")).first()[0] or 0), 8)
    common = kept(some.where((F.col("n") > limit) & (F.col("a") != F.col("b"))).select("digest", F.lit(True).alias("common")), "common")
    rows = rows_of(docs)
    check = [c for c in rows.columns if c == "check"]
    rows = rows.join(F.broadcast(common), "digest", "left")
    rows = rows.withColumn("salt", F.when(F.col("common"), 1 + F.pmod(F.col("row"), F.lit(SALTS))).otherwise(0).cast("int"))
    of_digest = W.partitionBy("digest", *check, "salt")
    rows = rows.withColumn("first", F.min("doc").over(of_digest)).withColumn("last", F.max("doc").over(of_digest)).where("salt > 0 or first != last")
    if not firsts:
        return rows.select(*columns)
    rows = rows.select(*columns, "first", F.when(F.col("salt") > 0, F.col("digest")).alias("common"))
    if common.isEmpty():
        return rows.drop("common")
    rows = kept(rows, "repeated")
    least = rows.where("common is not null").groupBy("common").agg(F.min("first").alias("least"))
    return rows.join(F.broadcast(kept(least, "least")), "common", "left").select(*columns, F.coalesce("least", "first").alias("first"))


def candidates(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, row, text) -> doc, row, text, spans: the words around runs of repeated chunks that a passage may lie in.

    Of a passage's words the chunk ends are sure where the hashes and all windows lie inside it, and one of every `window`
    is an end. So its own chunks are a run of `least` words or more, with fewer than `beside` words of it on either side.
    """
    window = min(WINDOW, (min_words - BEFORE - AFTER - 1) // 5)
    if window < 1:
        raise ValueError(f"min_words must be {BEFORE + AFTER + 6} or more")
    least, beside = min_words - 1 - AFTER - BEFORE - 4 * (window - 1), BEFORE + AFTER + 2 * window
    rows = repeated(docs, lambda d: chunks(d, window), ["doc", "row", "idx", "word", "n_words", "also"])
    places = F.concat(F.array(F.struct("idx", "word", "n_words")), F.coalesce("also", F.array().cast("array<struct<idx: int, word: int, n_words: int>>")))
    rows = rows.select("doc", "row", F.explode(places).alias("at")).select("doc", "row", "at.*").repartition("doc", "row").dropDuplicates(["doc", "row", "idx"])
    rows = rows.withColumn("run", F.col("idx") - F.row_number().over(W.partitionBy("doc", "row").orderBy("idx")))
    runs = rows.groupBy("doc", "row", "run").agg(F.min("word").alias("first"), F.max(F.col("word") + F.col("n_words")).alias("last"))
    runs = runs.where(F.col("last") - F.col("first") >= least)
    span = F.struct((F.col("first") - beside).alias("first"), (F.col("last") + beside).alias("last"))
    return docs.join(runs.groupBy("doc", "row").agg(F.collect_list(span).alias("spans")), ["doc", "row"]).dropDuplicates(["doc", "row"])


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents -> (doc, row, start, n_chars, n_words, first_doc, cuts) for each passage that other documents hold too.

    Every `min_words` whole words in a row (less punctuation at either end) that another document holds too, white space
    included, are found; those that overlap are one passage. first_doc is the smallest of their holders; cuts are the
    parts (start, n_chars in code points) that a smaller document holds. So each word of a cut part stands, with the
    `min_words` words around it, in a smaller document, which may have lost it only to a smaller one still: the smallest
    keeps it. Null or empty texts have no passages; rows that repeat id and text are one document, rows of one id but other
    texts share it and don't repeat each other; a null id, or one that is no number, is stood for by a hash. Very long texts
    are read whole, each by one task. An empty table gives no rows; other columns are not looked at.
    """
    docs = docs.select(doc_number().alias("doc"), row_hash().alias("row"), "text").where("text != ''")
    found = kept(candidates(docs, min_words).withColumn("number", F.monotonically_increasing_id()), "candidates")
    rows = repeated(found, lambda d: passages(d, min_words), ["doc", "number", "word", "also"], firsts=True)
    rows = rows.select("number", F.explode(F.concat(F.array("word"), F.coalesce("also", F.array().cast("array<int>")))).alias("word"), "first", (F.col("first") != F.col("doc")).alias("goes"))
    in_row = W.partitionBy("number").orderBy("word")
    sofar, before = in_row.rowsBetween(W.unboundedPreceding, 0), in_row.rowsBetween(W.unboundedPreceding, -1)
    apart = lambda previous: F.when(F.col("word") - previous < min_words, 0).otherwise(1)
    rows = rows.withColumn("word_cut", F.when(F.col("goes"), F.col("word"))).withColumn("run", apart(F.lag("word").over(in_row)))
    rows = rows.withColumn("cut", F.when(F.col("goes"), apart(F.last("word_cut", ignorenulls=True).over(before))).otherwise(0))
    rows = rows.withColumn("run", F.sum("run").over(sofar)).withColumn("cut", F.when(F.col("goes"), F.sum("cut").over(sofar)))
    ends = [F.min("word").alias("word"), F.max("word").alias("last"), F.min("first").alias("first")]
    pieces = rows.groupBy("number", "run", "cut").agg(*ends)
    cut = F.when(F.col("cut").isNotNull(), F.struct("word", "last"))
    runs = pieces.groupBy("number", "run").agg(F.min("word").alias("word"), F.max("last").alias("last"), F.min("first").alias("first_doc"), F.sort_array(F.collect_list(cut)).alias("cuts"))
    runs = runs.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("word", "last", "first_doc", "cuts"))).alias("runs"))
    return _in_characters(found.select("number", "doc", "row", "text").join(runs, "number"), min_words)


def _in_characters(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc, row, text, runs of word numbers) -> find_repeats' rows."""
    cut = pa.list_(pa.struct([("start", pa.int32()), ("n_chars", pa.int64())]))
    kinds = [("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n_chars", pa.int64()), ("n_words", pa.int64()), ("first_doc", pa.int64()), ("cuts", cut)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            out: list[tuple] = []
            for doc, row, text, runs in zip(*(b.column(x).to_pylist() for x in ("doc", "row", "text", "runs"))):
                raw = np.frombuffer(text.encode(), np.uint8)
                begin, end = cores(raw)
                chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                place = lambda first, last: (int(chars[begin[first]]), int(chars[end[last + min_words - 1]] - chars[begin[first]]))  # noqa: E731, B023
                for x in runs:
                    cuts = [dict(zip(("start", "n_chars"), place(y["word"], y["last"]))) for y in x["cuts"]]
                    out.append((doc, row, *place(x["word"], x["last"]), x["last"] - x["word"] + min_words, x["first_doc"], cuts))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out) if out else [[]] * len(kinds), kinds)], [n for n, _ in kinds])

    schema = "doc long, row long, start int, n_chars long, n_words long, first_doc long, cuts array<struct<start: int, n_chars: long>>"
    return docs.select("doc", "row", "text", "runs").mapInArrow(each, schema)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """documents -> their columns, with text less the passages that a smaller document holds; odd rows as for find_repeats."""
    cuts = find_repeats(docs, min_words).groupBy(F.col("doc").alias("__doc"), F.col("row").alias("__row")).agg(F.sort_array(F.flatten(F.collect_list("cuts"))).alias("__cuts"))
    edges = lambda f: F.transform("__cuts", f)
    starts = F.concat(F.array(F.lit(0)), edges(lambda c: c["start"] + c["n_chars"]))
    ends = F.concat(edges(lambda c: c["start"]), F.array(F.char_length("text")))
    text = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring("text", a + 1, b - a)), "")
    out = docs.withColumn("__row", row_hash()).withColumn("__doc", doc_number()).join(cuts, ["__doc", "__row"], "left")
    return out.withColumn("text", F.when(F.size("__cuts") > 0, text).otherwise(F.col("text"))).drop("__doc", "__row", "__cuts")
