"""The registered queries, as they stand, against plain Python over one small set of tables with all kinds of odd rows."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from tests.llm.helpers import frame, odd_rows, sentence
from tests.llm.test_text_operators import WORDS, brute_components, language_rows
from tidebar.llm import language_id, token_counts
from tidebar.llm.queries import QUERIES
from tidebar.llm.winnowing import START

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return (text or "").translate(LOW).translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ")


def split(text):
    return [w for w in words_of(text) if w]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    passage = sentence(70, 64, 4000)
    out = [(i, x, k) for i, x, k in language_rows()[:60]]
    out += [(100 + i, f"{sentence(i, 60 + i, 4000)}, {passage}. {sentence(i + 50, 40, 4000)}", "en") for i in range(6)]
    out += [(120 + i, sentence(i % 4, 90, 4000) + " tail" * (i // 4), "de") for i in range(12)]
    out += [(140, "".join(chr(0x4E00 + r.randrange(2000)) for _ in range(300)), "zh"), (141, "ÄÖÜ ß wide", None), (142, "İstanbul DIŞ", "fr")]
    return out + [(i if i is None else 200 + i, x, None) for i, x in odd_rows()]


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("registered")
    frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    html = [(k, f"http://x/{k}", x) for k, (_, x, _) in enumerate(rows)] + [(None, None, "no id"), (None, "http://y", "no id"), (7, "http://z", rows[3][1])]
    spark.createDataFrame(html, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    return str(d), html


def test_op1(spark, sf):
    d, html = sf
    got = QUERIES["op1_warc"](spark, d).collect()
    payloads = Counter((p, (x or "").encode()) for p, _, x in html)
    expected = []
    for (page, payload), n in payloads.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        same = [p for p, x in payloads if x == payload]
        most = max(same, key=lambda p: -1 if p is None else p)
        for k in range(n):
            revisit = page != most or k > 0
            expected.append((page, len(payload), digest, "revisit" if revisit else "response", most if revisit else None))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_op5(spark, sf, rows):
    got = QUERIES["op5_simhash"](spark, sf[0]).collect()

    def fingerprint(text):
        w = split(text)
        grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(x) for _, x, _ in rows]
    root = brute_components(prints)
    least = {}
    for (i, _, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], 1 << 60), i)
    expected = sorted(repr((i, f"{p:016x}", least.get(root[p]))) for (i, _, _), p in zip(rows, prints))
    assert sorted(repr(tuple(x)) for x in got) == expected


def test_op6(spark, sf, rows):
    bpe = token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())
    got = QUERIES["op6_token_counts"](spark, sf[0]).collect()
    expected = []
    for i, text, _ in rows:
        x = text or ""
        q, m, late = len(x) // 4, len(x) // 2, len(x) * 3 // 4
        edited = x
        for start, end, new in ((q, q, x[:20]), (m, m + 16, " edited here, twice "), (late, late + 10, "")):
            edited = edited[:start] + new + edited[end:]
        expected.append(repr((i, len(bpe.encode(x)), len(bpe.encode(edited)), hashlib.sha256(edited.encode()).hexdigest())))
    assert sorted(repr((r["doc_id"], r["n_tokens"], r["n_tokens_edited"], r["edited_sha256"])) for r in got) == sorted(expected)


def brute_languages(learned, text):
    """The language set and its largest share: dictionaries and loops over words, in double precision."""
    counts, names = {}, sorted({k for _, k in learned})

    def grams(x):
        out = []
        for word in "".join(c if c.isalpha() else " " for c in x.lower()).split():
            padded = f" {word} "
            out.append([padded[j : j + 3] for j in range(len(word))])
        return out

    def slot(gram):
        a, b, c = (0 if x == " " else ord(x) for x in gram)
        return ((a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & (1 << 64) - 1) >> 48

    for x, k in learned:
        counts.setdefault(k, Counter()).update(slot(g) for w in grams(x) for g in w)
    total = {k: sum(counts[k].values()) + 0.1 * 65536 for k in names}
    by_word = [[sum(math.log((counts[k][slot(g)] + 0.1) / total[k]) for g in w) for k in names] for w in grams(text)]
    if not by_word:
        return "und", 0.0
    by_word = [[max(x, max(w) - 30) for x in w] for w in by_word]

    def em(some):
        pi = {j: 1 / len(some) for j in some}
        p = [{j: math.exp(w[j] - max(w)) for j in some} for w in by_word]
        for _ in range(15):
            new = dict.fromkeys(some, 0.0)
            for w in p:
                s = sum(w[j] * pi[j] for j in some)
                for j in some:
                    new[j] += w[j] * pi[j] / s / len(p)
            pi = new
        return pi, sum(math.log(sum(w[j] * pi[j] for j in some)) + max(b) for w, b in zip(p, by_word))

    alone = [sum(w[j] for w in by_word) for j in range(len(names))]
    best, share, value = max(range(len(names)), key=lambda j: alone[j]), 1.0, max(alone)
    pi, _ = em(range(len(names)))
    order = sorted(pi, key=lambda j: -pi[j])
    for size in range(2, len(names) + 1):
        pi, likelihood = em(order[:size])
        penalised = likelihood - 0.5 * (size - 1) * math.log(len(by_word) + 1)
        if penalised > value:
            value, best, share = penalised, max(pi, key=lambda j: pi[j]), max(pi.values())
        elif size >= 3:
            break
    return names[best], share


def test_op7(spark, sf, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0
    learned = [(x, k) for i, x, k in rows if not held(i) and k is not None and x is not None]
    got = QUERIES["op7_language_id"](spark, sf[0]).collect()
    mixed = " ".join(f"{a} {b}" for a, b in zip(WORDS["en"].split(), WORDS["de"].split()))
    model = language_id.learn(spark.createDataFrame([(i, x, k) for i, (x, k) in enumerate(learned)], "doc_id long, text string, lang string"))
    for text in (mixed, mixed + " " + WORDS["fr"], WORDS["fr"] + " the fox"):
        best, share = language_id.mixtures([text], model)
        name, value = brute_languages(learned, text)
        assert model.languages[best[0]] == name and abs(share[0] - value) < 1e-3
    some = [r for r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: repr(r["doc_id"]))) if len(r[0][1] or "") < 800]
    assert len(got) == len(rows) and all(r["held_out"] == held(r["doc_id"]) for r in got)
    texts = Counter(i for i, _, _ in rows)
    by_id = {r["doc_id"]: r for r in got if texts[r["doc_id"]] == 1}
    for i, x, _ in [(i, x, k) for (i, x, k), _ in some][::5]:
        if i in by_id:
            name, value = brute_languages(learned, x or "")
            assert by_id[i]["lang_pred"] == name and abs(by_id[i]["score"] - value) < 1e-3, i


def test_op9(spark, sf, rows):
    """Every 50 words in a row, less punctuation at their ends, that another document holds."""
    got = QUERIES["op9_substring_dedup"](spark, sf[0]).collect()
    windows = {}
    per = {}
    for i, x in {(i, x) for i, x, _ in rows if x and i is not None}:
        at, n, spans = 0, 0, []
        for w in split_keep(x):
            start = at + x[at:].index(w)
            at = start + len(w)
            inner = [j for j, ch in enumerate(w) if ord(ch) >= 128 or ch.isalnum()]
            spans.append((start + inner[0], start + inner[-1] + 1) if inner else (start, at))
        for n in range(len(spans) - 49):
            piece = x[spans[n][0] : spans[n + 49][1]]
            windows.setdefault(piece, set()).add(i)
            per.setdefault(i, []).append((n, piece, spans[n][0], spans[n + 49][1]))
    expected = []
    for i, found in per.items():
        run = []
        for n, piece, a, b in [*((n, p, a, b) for n, p, a, b in found if len(windows[p]) > 1), (10**9, "", 0, 0)]:
            if run and n - run[-1][0] >= 50:
                expected.append((i, min(min(windows[p]) for _, p, _, _ in run), run[0][2], run[-1][3] - run[0][2], run[-1][0] - run[0][0] + 50))
                run = []
            run.append((n, piece, a, b))
    assert sorted((r["doc_id"], r["first_doc_id"], r["start"], r["n_chars"], r["n_words"]) for r in got) == sorted(expected)
    assert {x[0] for x in expected} >= set(range(100, 106))


def split_keep(text):
    return [w for w in text.translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]


UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"


def brute_marks(text):
    """The hashes that stay, of the grams that end at each token."""
    letter = rf"[^\x20\x09-\x0D{UNSPACED}]"
    lower = (text or "").replace("İ", "i̇").lower()
    mask = (1 << 64) - 1
    turn = lambda x, b: (x << b | x >> 64 - b) & mask if b else x
    tokens = re.findall(rf"(?<!{letter}){letter}{{1,16}}(?!{letter})|[^\x20\x09-\x0D]", lower)
    hashes = [START] * 4 + [xxhash.xxh64_intdigest(t.encode(), 42) for t in tokens]
    grams = [turn(a, 4) ^ turn(b, 3) ^ turn(c, 2) ^ turn(d, 1) ^ e for a, b, c, d, e in zip(*(hashes[j:] for j in range(5)))]
    windows = [range(i, i + 4) for i in range(len(grams) - 3)] or [range(len(grams))]
    return {grams[min(w, key=lambda p: (grams[p] >> 33, -p))] for w in windows if len(w)}


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_op10(spark, sf, rows):
    got = QUERIES["op10_winnowing"](spark, sf[0]).collect()
    order = sorted(((i, x or "") for i, x, _ in rows if i is not None), key=lambda r: (-r[0], r[1])) + sorted(((i, x or "") for i, x, _ in rows if i is None), key=lambda r: (signed_hash(r[1]), r[1]))
    expected = []
    for k, (i, x) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(x) // 2
        edited = x[: len(x) - half] + following[:half]
        a, b, c = map(brute_marks, (x, edited, following))
        near = lambda p, q: round(len(p & q) / len(p | q), 9) if p | q else 1.0
        expected.append((i, len(x), hashlib.sha256(edited.encode()).hexdigest(), near(a, b), near(a, c)))
    found = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(map(repr, found)) == sorted(map(repr, expected))
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    by_text = {}
    for r, (i, x) in zip(sorted(got, key=lambda r: repr((r["doc_id"], r["n_chars"]))), sorted(order, key=lambda r: repr((r[0], len(r[1]))))):
        by_text.setdefault(x, set()).add(r["fingerprint"])
    assert all(len(prints) == 1 for prints in by_text.values())
    assert all(r["near_edited"] == 1 for r in got if r["fingerprint"] == r["edited_fingerprint"])
    long = next(r for r in got if r["doc_id"] == 140)
    assert long["near_edited"] > 0.3
