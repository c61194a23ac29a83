"""How a language's sources differ in the words they use: divergence of every pair of sources, and each source's own words.

The divergence of two sources is a sum of a function f of the two counts over all terms that the language keeps. It is not
summed term by term: for each pair of sources the distinct combinations (count, count) are tallied, f is evaluated once a
combination and weighed by the number of terms. Most terms are rare, so combinations are few. Terms that a source lacks
are zero cells; they follow from the source's own histogram of counts and the number of kept terms, and are never listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidebar.llm.common import ascii_lower, kept

#: What is between terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: A language keeps the terms of so many documents at least.
HOLDERS = 3
#: Shares are counted in parts of so many.
SCALE = 1_000_000_000
#: Ranks of a source's own terms that are returned.
RANKS = 200


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact for counts of up to 18 digits; null without terms."""
    wide = lambda x: x.cast("decimal(19,0)")
    parts = (wide(count) + 1) * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(terms > 0, 1 + F.call_function("div", parts, wide(total) + wide(terms)))


def chi(p: str, q: str) -> Column:
    """f: floor((p - q)**2 / q). Shares are below 2**30, so the square is a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div {q}")


def lowered(text: Column) -> Column:
    """A-Z alone in lower case. `lower` does that to ASCII text, at a quarter of the cost."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(ascii_lower(text))


def numbered(groups: DataFrame) -> tuple[DataFrame, Column]:
    """lang, source -> these and group, a number of their own; and the number as a column of documents.

    A hash is the number; should two groups share one, another hash is taken.
    """
    for seed in range(100):
        number = F.xxhash64(F.lit(seed), "lang", "source")
        out = kept(groups.withColumn("group", number), "groups")
        if out.groupBy("group").count().where("count > 1").isEmpty():
            return out, number
    raise ValueError("groups can't be told apart by their hashes")


def term_counts(docs: DataFrame) -> DataFrame:
    """(text, group) -> group, term, count, holders (documents that have the term).

    Each document's terms are sorted and come once with the length of their run, so one aggregation, which begins before
    the shuffle, gives both numbers. Texts are taken whole.
    """
    # Texts of ASCII only are lowered whole, of others term by term.
    ascii_text = F.octet_length("text") == F.char_length("text")
    words = F.when(ascii_text, F.split(F.lower("text"), BETWEEN)).otherwise(F.transform(F.split("text", BETWEEN), lowered))
    out = docs.select("group", F.sort_array(words).alias("words"))
    at = lambda i: F.get("words", i)
    out = out.withColumn("starts", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: (i == 0) | (at(i) != at(i - 1))))
    run = lambda i, k: F.struct(at(i).alias("term"), (F.coalesce(F.get("starts", k + 1), F.size("words")) - i).alias("times"))
    rows = out.select("group", F.explode(F.transform("starts", run)).alias("x")).where("x.term <> ''")
    return rows.groupBy("group", F.col("x.term").alias("term")).agg(F.sum("x.times").alias("count"), F.count("*").alias("holders"))


def kept_vectors(counts: DataFrame) -> DataFrame:
    """(lang, group, term, count, holders) -> lang, term, total, cells (group, count): the terms that a language keeps.

    A vector has no more cells than the language has sources.
    """
    cell = F.struct("group", "count")
    by_term = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(cell)).alias("cells"), F.sum("count").alias("total"), F.sum("holders").alias("holders"))
    return by_term.where(F.col("holders") >= HOLDERS).drop("holders")


def joint_histogram(vectors: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (groups, a < b), m, n (counts of a term in each), cells (terms with these counts): all terms of each pair.

    Equal vectors are tallied first, so rare terms, which share theirs, give their pairs once. Cells in which both counts
    are above zero are listed; those with a zero are what is left of each group's histogram, those with two what is left
    of the language's terms.
    """
    same = vectors.groupBy("lang", "cells").agg(F.count("*").alias("times"))
    first = same.select("lang", "times", F.posexplode("cells").alias("at", "x"), "cells")
    # One row a cell with the cells after it, then one row a pair: no row holds more than a vector.
    pairs = first.select("lang", "times", "x", F.explode(F.slice("cells", F.col("at") + 2, F.size("cells"))).alias("y"))
    both = pairs.groupBy("lang", F.col("x.group").alias("a"), F.col("y.group").alias("b"), F.col("x.count").alias("m"), F.col("y.count").alias("n")).agg(F.sum("times").alias("cells"))
    both = kept(both, "joint")
    alone = kept(same.select("lang", "times", F.explode("cells").alias("x")).groupBy("lang", F.col("x.group").alias("group"), F.col("x.count").alias("count")).agg(F.sum("times").alias("times")), "alone")
    named = lambda c: groups.select("lang", F.col("group").alias(c), "terms")
    every = named("a").join(named("b").drop("terms"), "lang").where("a < b")
    zero = F.lit(0).cast("long")
    # What each known count adds to its own cell it takes from the cell where it is taken for zero.
    of = lambda df, m, n, times: df.select("lang", "a", "b", m.alias("m"), n.alias("n"), times.alias("cells"))
    m, n, c, t = F.col("m"), F.col("n"), F.col("cells"), F.col("times")
    left, right = every.join(alone.withColumnRenamed("group", "a"), ["lang", "a"]), every.join(alone.withColumnRenamed("group", "b"), ["lang", "b"])
    parts = [of(both, m, n, c), of(both, m, zero, -c), of(both, zero, n, -c), of(both, zero, zero, c)]
    parts += [of(left, F.col("count"), zero, t), of(left, zero, zero, -t), of(right, zero, F.col("count"), t), of(right, zero, zero, -t), of(every, zero, zero, F.col("terms"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("lang", "a", "b", "m", "n").agg(F.sum("cells").alias("cells")).where("cells > 0")


def divergence(docs: DataFrame) -> DataFrame:
    """documents -> lang, source, part ('pair' or 'term'), item, value, rank.

    A row is a document, repeated rows too. Null text, lang and source count as empty; a text without terms still makes its
    source one of the language. In a language that keeps no term all pairs have value 0. Ranks go by value, then by
    the item's bytes, so there are no ties. Very long texts are read whole; an empty table gives no rows; other columns,
    whatever their names, are left alone.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    docs = docs.select(c("text"), c("lang"), c("source"))
    names, number = numbered(docs.select("lang", "source").distinct())
    counts = kept(term_counts(docs.select("text", number.alias("group"))).join(names.select("group", "lang"), "group"), "terms")
    vectors = kept(kept_vectors(counts), "vectors")
    cells = vectors.select("term", "total", F.explode("cells").alias("x")).select("term", "total", "x.*")
    langs = vectors.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count("*").alias("terms"))
    totals = cells.groupBy("group").agg(F.sum("count").alias("group_total"))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0)).alias(name)
    groups = names.join(totals, "group", "left").join(langs, "lang", "left")
    groups = kept(groups.select("lang", "source", "group", zero("group_total"), zero("terms"), zero("lang_total")), "totals")

    side = lambda c, total: groups.select(F.col("group").alias(c), F.col("group_total").alias(total))
    tally = joint_histogram(vectors, groups).join(groups.select(F.col("group").alias("a"), F.col("group_total").alias("a_total"), "terms"), "a").join(side("b", "b_total"), "b")
    tally = tally.withColumn("p", share(F.col("m"), F.col("a_total"), F.col("terms"))).withColumn("q", share(F.col("n"), F.col("b_total"), F.col("terms")))
    weighed = lambda p, q: F.sum(chi(p, q).cast("decimal(19,0)") * F.col("cells").cast("decimal(18,0)"))
    summed = tally.groupBy("a", "b").agg(weighed("p", "q").alias("ab"), weighed("q", "p").alias("ba"))
    way = lambda group, other, value: F.struct(F.col(group).alias("group"), F.col(other).alias("other"), F.col(value).cast("long").alias("value"))
    found = summed.select(F.explode(F.array(way("a", "b", "ab"), way("b", "a", "ba"))).alias("x")).select("x.*")
    found = found.join(names, "group").join(names.select(F.col("group").alias("other"), F.col("source").alias("item")), "other").select("lang", "source", "item", "value")
    # Of a language without terms no cell is left; its pairs are there all the same.
    bare = groups.where("terms = 0").select("lang", "source")
    bare = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    pairs = found.unionByName(bare).withColumn("part", F.lit("pair"))

    own = cells.join(groups, "group")
    own = own.withColumn("p", share(F.col("count"), F.col("group_total"), F.col("terms"))).withColumn("q", share(F.col("total"), F.col("lang_total"), F.col("terms")))
    own = own.where("p > q").select("lang", "source", F.col("term").alias("item"), chi("p", "q").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    terms = ranked(own).where(F.col("rank") <= RANKS).withColumn("part", F.lit("term"))
    return ranked(pairs).unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
