"""Small documents with everything that may go wrong in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, digest string, n long, keep string"


def frame(spark, rows):
    """(doc_id, text[, lang[, source]]) rows; the other columns have names that operators use themselves."""
    full = []
    for r in rows:
        doc_id, text, lang, source = (*r, *(None,) * (4 - len(r)))
        full.append((doc_id, text, lang, source, len(text or ""), -1, -2, "x", -3, "k"))
    return spark.createDataFrame(full, DOCS)


def sentence(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    """Nulls, empties, repeats, white space, a very long text, letters of many bytes."""
    long = sentence(1, 20000)
    return [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "two words"), (6, long), (6, long), (7, "ärger ñandú 日本語 " * 3), (None, "no id"), (None, None), (8, "A" * 5000)]
