"""Language identification as multilingual mixture inference.

Each language has a model of letter trigrams. A document's words are taken as draws from a mixture of languages:
expectation-maximisation over the words' likelihoods estimates the proportions, and of the nested sets of the likeliest
languages the one of the best penalised likelihood (BIC) is selected. The prediction is the set's largest language, its
score the language's proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import part

#: Trigrams are hashed to so many bins; the model that is sent to tasks holds the bins that a language has.
BINS = 1 << 16
#: About so many documents of each language are learned from, chosen by hash.
LEARN_DOCS = 2000
ROUNDS = 15
#: Languages of the sets that are always tried; larger ones while they are better.
TRIED_SET = 3
#: Numbers of words times languages that are held at a time, but for a single text.
AT_ONCE = 4_000_000
UNDETERMINED = "und"


@dataclass
class Trigrams:
    """The letter trigrams of texts, word by word; a word's edges count as spaces."""

    bins: object  #: of each trigram
    word_at: object  #: where each word's trigrams begin
    doc_of: object  #: the text of each word


def trigrams(texts: list[str]) -> Trigrams:
    """Of texts without line feeds, which here end each text."""
    import numpy as np

    joined = f" {' \n '.join([*texts, ''])}".lower()
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.bincount(points).astype(bool)
    for point in np.flatnonzero(table).tolist():
        table[point] = chr(point).isalpha()
    is_letter = table[points]
    codes = np.where(is_letter, points, 0).astype(np.uint64)
    code = (codes[:-2] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(48)
    middle = is_letter[1:-1]
    first = middle & ~is_letter[:-2]
    where = np.flatnonzero(middle)
    doc_of = np.cumsum(points == 10)[1:-1]
    return Trigrams((code[where]).astype(np.int64) % BINS, np.flatnonzero(first[where]), doc_of[where][first[where]])


@dataclass
class Model:
    """Log-probabilities (float32) of trigrams: `rest` of each language for the bins that it hasn't, and bin by bin the others."""

    languages: list[str]
    rest: object = field(repr=False)
    begin: object = field(repr=False)  #: where each bin's entries begin, and the end
    language: object = field(repr=False)
    log_p: object = field(repr=False)

    def of(self, bins):
        """float32, bins x languages."""
        import numpy as np

        some, at = np.unique(bins, return_inverse=True)
        table = np.tile(self.rest, (len(some), 1))
        first, n = self.begin[some], self.begin[some + 1] - self.begin[some]
        entry = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        table[np.repeat(np.arange(len(some)), n), self.language[entry]] = self.log_p[entry]
        return table[at]


def learn(labelled: DataFrame, docs_per_language: int = LEARN_DOCS) -> Model:
    """(doc_id, text, lang) with no null lang -> the model, from about so many documents of each language.

    Which documents is settled by a hash against each language's rate, so no group is gathered or sorted. An empty table
    gives a model without languages. The driver gets a number a language and bin, as Arrow columns.
    """
    import numpy as np

    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    languages = sorted(r["lang"] for r in sizes.collect())
    if not languages:
        return Model([], np.zeros(0, np.float32), np.zeros(BINS + 1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
    numbered = labelled.sparkSession.createDataFrame(list(zip(languages, range(len(languages)))), "lang string, language int")
    limit = (F.least(F.lit(1.0), docs_per_language / F.col("n")) * (1 << 30)).cast("long")
    some = labelled.join(F.broadcast(sizes.select("lang", limit.alias("__limit"))), "lang")
    some = some.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("__limit")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, object] = {}
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                by.setdefault(lang, []).append(one_line(text))
            for lang, texts in by.items():
                totals[lang] = totals.get(lang, 0) + np.bincount(trigrams(texts).bins, minlength=BINS)
        for lang, n in totals.items():
            bins = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(bins), pa.string()), pa.array(bins), pa.array(n[bins])], ["lang", "bin", "n"])

    rows = some.mapInArrow(count, "lang string, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).join(F.broadcast(numbered), "lang").select("bin", "n", "language").toArrow()
    bins, n, language = (rows.column(x).to_numpy().astype(kind) for x, kind in (("bin", np.int64), ("n", np.float64), ("language", np.int64)))
    order = np.lexsort((language, bins))
    bins, n, language = bins[order], n[order], language[order]
    total = np.bincount(language, n, len(languages)) + 0.1 * BINS
    begin = np.searchsorted(bins, np.arange(BINS + 1))
    return Model(languages, np.log(0.1 / total).astype(np.float32), begin, language.astype(np.int32), np.log((n + 0.1) / total[language]).astype(np.float32))


def one_line(text: str | None) -> str:
    return (text or "").replace("\n", " ")


def mixtures(texts: list[str], model: Model):
    """-> for each text the index of its language (-1: no letter) and its proportion."""
    return fitted_mixtures(texts, model)[:2]


def fitted_mixtures(texts: list[str], model: Model):
    """-> for each text the index of its language (-1: no letter), its proportion, and whether it fits the languages.

    It fits if the selected set makes it likelier than trigrams of equal chances do.
    """
    import numpy as np

    k, n = len(model.languages), len(texts)
    best, share, fits = np.full(n, -1, np.int64), np.zeros(n), np.zeros(n, bool)
    grams = trigrams([one_line(x) for x in texts])
    if not k or not len(grams.word_at):
        return best, share, fits
    by_word = np.concatenate([np.add.reduceat(model.of(grams.bins[a:b]), grams.word_at[i:j] - a, axis=0) for i, j, a, b in _slices(grams, max(1, AT_ONCE // (8 * k)))])
    by_word = np.maximum(by_word, by_word.max(axis=1, keepdims=True) - 30)
    docs, at = np.unique(grams.doc_of, return_index=True)
    n_words = np.diff([*at, len(by_word)])
    alone = np.add.reduceat(by_word, at, axis=0)  # log-likelihood of each language for the whole text
    top = by_word.max(axis=1, keepdims=True)
    p = np.exp(by_word - top)
    shift = np.add.reduceat(top[:, 0], at)

    def fit(allowed, p, at, n_words, shift):
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(ROUNDS):
            r = p * np.repeat(pi, n_words, axis=0)
            r /= r.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(r, at, axis=0) / n_words[:, None]
        mixed = (p * np.repeat(pi, n_words, axis=0)).sum(axis=1)
        return pi, np.add.reduceat(np.log(np.maximum(mixed, 1e-300)), at) + shift

    pi, _ = fit(np.ones((len(docs), k), np.float32), p, at, n_words, shift)
    order = np.argsort(-pi, axis=1, kind="stable")
    chosen, proportion = alone.argmax(axis=1), np.ones(len(docs))
    value = alone.max(axis=1)
    likeliest = value.copy()
    open_, size = np.arange(len(docs)), 2  # the texts whose set may grow
    while len(open_) and size <= k:
        allowed = np.zeros((len(open_), k), pi.dtype)
        np.put_along_axis(allowed, order[open_, :size], 1, axis=1)
        found, likelihood = fit(allowed, p, at, n_words[open_], shift[open_])
        penalised = likelihood - 0.5 * (size - 1) * np.log(n_words[open_] + 1.0)
        better = penalised > value[open_]
        up = open_[better]
        value[up], likeliest[up] = penalised[better], likelihood[better]
        chosen[up], proportion[up] = found.argmax(axis=1)[better], found.max(axis=1)[better]
        if size >= TRIED_SET:
            p = p[np.repeat(better, n_words[open_])]
            open_ = up
            at = np.cumsum(n_words[open_]) - n_words[open_]
        size += 1
    n_grams = np.add.reduceat(np.diff([*grams.word_at, len(grams.bins)]), np.cumsum(n_words) - n_words)
    best[docs], share[docs], fits[docs] = chosen, proportion, likeliest > -np.log(BINS) * n_grams
    return best, share, fits


def _slices(grams: Trigrams, words: int = 1 << 18):
    """Words in pieces (first word, last, first trigram, last), for bounded memory."""
    for i in range(0, len(grams.word_at), words):
        j = min(i + words, len(grams.word_at))
        yield i, j, grams.word_at[i], grams.word_at[j] if j < len(grams.word_at) else len(grams.bins)


def predict(docs: DataFrame, model: Model, batch_chars: int = 2_000_000) -> DataFrame:
    """docs -> its columns and lang_pred, score, fits; `und` and 0 if the text is null or has no letter. Only text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "fits")
    batch_chars = min(batch_chars, 1 + 8 * AT_ONCE // max(1, len(model.languages)))
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            labels, scores, fit, at = [], [], [], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size < batch_chars):
                    size += len(texts[upto] or "")
                    upto += 1
                best, share, fits = fitted_mixtures(texts[at:upto], sent.value)
                labels += [sent.value.languages[i] if i >= 0 else UNDETERMINED for i in best]
                scores += [float(min(1.0, x)) for x in share]
                fit += fits.tolist()
                at = upto
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(fit, pa.bool_())], [*names, "lang_pred", "score", "fits"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(each, ", ".join([*fields, "lang_pred string", "score double", "fits boolean"]))


def held_out(doc_id: Column) -> Column:
    return part(doc_id) == 0


def identify(docs: DataFrame) -> DataFrame:
    """documents -> their columns and held_out, lang_pred, score, fits; learned from the rows that aren't held out.

    A null doc_id counts as empty text (held out, as its crc32 is 0). Null lang or text isn't learned from. Without any
    row to learn from all texts are `und`. A text without letters is `und`, fits nothing and has score 0. Of equal
    proportions the language that sorts first is predicted. Very long texts are read whole, at one time. Repeated rows are
    predicted alike; an empty table gives no rows. Columns of the names above are replaced, others stay.
    """
    model = learn(docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang"))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
