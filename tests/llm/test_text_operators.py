import base64
import hashlib
import os
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, frame, odd_rows, sentence
from tidebar.llm import decontamination, language_id, lm_scoring, queries, simhash, substring_dedup, token_counts, warc, winnowing
from tidebar.llm.line_dedup import dedup_lines
from tidebar.llm.mixing import mix

EMPTY = []


def test_kept_tables_are_released(spark):
    from tidebar.llm import common

    df = common.kept(spark.range(5).toDF("x"), "some")
    path = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert df.count() == 5 and os.path.isdir(path)
    before = list(common.KEPT)
    common.KEPT[:] = before[-1:]
    common.release(spark)
    assert not os.path.isdir(path) and not common.KEPT
    common.KEPT[:] = before[:-1]


# WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, kind string, digest string")


def test_warc_round_trip_with_revisits(spark, tmp_path):
    rows = [(1, "u1", "<p>same</p>", "a", "b"), (9, "u9", "<p>same</p>", "a", "b"), (9, "u9", "<p>same</p>", "a", "b"), (3, None, None, "a", "b"), (4, "u 4", "", "a", "b"), (None, "u", "ünïcode", "a", "b"), (5, "u5", "alone", "a", "b")]
    path = f"file://{tmp_path}/w"
    manifest = warc.write_warc(pages(spark, rows), path)
    out = [(r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()]
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    expected = [(1, "revisit", 11, digest("<p>same</p>"), 9), (9, "response", 11, digest("<p>same</p>"), None), (9, "revisit", 11, digest("<p>same</p>"), 9), (3, "revisit", 0, digest(""), 4), (4, "response", 0, digest(""), None), (None, "response", 9, digest("ünïcode"), None), (5, "response", 5, digest("alone"), None)]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert manifest.agg(F.sum("n_records")).first()[0] == 7
    payloads = {r["page_id"]: r["payload"] for r in warc.read_warc(spark, path, with_payload=True).where("record_type = 'response'").collect()}
    assert bytes(payloads[9]) == b"<p>same</p>"


def test_warc_files_roll_and_are_the_same_again(spark, tmp_path):
    rows = [(i, f"http://x/{i}", "".join(random.Random(i).choices("abcdef", k=3000)), "", "") for i in range(60)]
    seen = []
    for name in ("a", "b"):
        m = warc.write_warc(pages(spark, rows), f"file://{tmp_path}/{name}", roll_bytes=20_000)
        seen.append(sorted((r["file"], r["sha256"], r["n_records"]) for r in m.collect()))
        assert all(r["n_bytes"] <= 20_000 for r in m.collect())
    assert seen[0] == seen[1] and len(seen[0]) > 4
    import gzip

    data = (tmp_path / "a/data" / seen[0][0][0]).read_bytes()
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == seen[0][0][2] + 1  # and the warcinfo record


def test_warc_bytes_do_not_depend_on_partitions(spark, tmp_path):
    rows = [(i if i % 9 else None, f"http://x/{i}", f"{i % 700} payload " * (i % 50), "", "") for i in range(4000)]
    seen, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    for name, some, n in (("c", rows, 4), ("d", rows[::-1], 7)):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        m = warc.write_warc(pages(spark, some).repartition(n), f"file://{tmp_path}/{name}", roll_bytes=50_000, range_bytes=40_000)
        seen.append(sorted((r["file"], r["sha256"], r["n_records"]) for r in m.collect()))
        assert sum(r["n_records"] for r in m.collect()) == 4000
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] and len({x[0][:11] for x in seen[0]}) > 20  # ranges
    order = [r["page_id"] for r in warc.read_warc(spark, f"file://{tmp_path}/c").orderBy("file").collect() if r["page_id"] is not None]
    assert order == sorted(order)


def test_warc_very_long_payload(spark, tmp_path):
    path = f"file://{tmp_path}/long"
    text = "".join(random.Random(1).choices("abcdefgh", k=3_000_000))
    warc.write_warc(pages(spark, [(1, "u", text, "", ""), (2, "u", "a", "", ""), (3, "u", text, "", "")]), path, roll_bytes=1000)
    out = {r["page_id"]: (r["record_type"], r["payload_bytes"], r["refers_to"]) for r in warc.read_warc(spark, path).collect()}
    assert out == {1: ("revisit", 3_000_000, 3), 2: ("response", 1, None), 3: ("response", 3_000_000, None)}


def test_warc_minimum_size_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    warc.write_warc(pages(spark, [(1, "u", "aa", "", ""), (2, "u", "aa", "", "")]), path, min_bytes=3)
    assert {r["record_type"] for r in warc.read_warc(spark, path).collect()} == {"response"}
    warc.write_warc(pages(spark, EMPTY), f"{path}0")
    assert warc.read_warc(spark, f"{path}0").count() == 0


# Language-model scores


def test_lm_scores_against_brute_counts(spark):
    rows = [(i, sentence(i % 40, 60, 50) if i % 7 else None) for i in range(300)] + odd_rows()
    got = lm_scoring.score(frame(spark, rows)).collect()
    import math
    from collections import Counter

    tokens = lambda x: [*(x or "").encode().lower().split(), b"\n"]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    count = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(count.values()), len(count)
    base = lambda x: sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens(x))
    expected = sorted((repr(i), held(i), len(tokens(x)), sum(count[t] > 0 for t in tokens(x)), n, round(base(x), 4)) for i, x in rows)
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == expected
    scored = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)
    assert all(r["score"] < 0 for r in got)


def test_lm_scores_against_brute_interpolation(spark):
    """The model again from its definition, token by token and without tables of steps."""
    import math
    from collections import Counter

    rows = [(i, sentence(i % 90, 40 + i % 17, 60)) for i in range(400)] + odd_rows()
    docs = frame(spark, rows)
    roles = [r["role"] for r in docs.select(lm_scoring.role(F.col("doc_id")).alias("role"), "row").collect()]
    got = lm_scoring.score(docs).collect()
    tokens = [[*(x or "").encode().lower().split(), b"\n"] for _, x in rows]
    pairs = [list(zip([b"\n", *t], t)) for t in tokens]
    one, two = {}, {}
    for kinds in ((0,), (0, 1)):
        one[kinds] = Counter(t for ts, r in zip(tokens, roles) if r in kinds for t in ts)
        two[kinds] = Counter(p for ps, r in zip(pairs, roles) if r in kinds for p in ps)
    bucket = lambda n: int(math.log2(n)) + 1 if n else 0

    def parts(pair, kinds):
        c1, n = one[kinds], sum(one[kinds].values())
        context = c1[pair[0]]
        return bucket(context), two[kinds][pair] / context if context else 0.0, c1[pair[1]] / n, 1 / (len(c1) + 1)

    seen = {}
    for ps, r in zip(pairs, roles):
        for pair in ps if r == 1 else []:
            b, *p = parts(pair, (0,))
            seen.setdefault(b, []).append(p)
    mix = {}
    for b, events in seen.items():
        w = [1 / 3] * 3 if b else [0, 0.5, 0.5]
        for _ in range(50):
            total = [float(x > 0) for x in w]
            for p in events:
                s = sum(x * y for x, y in zip(p, w))
                total = [t + x * y / s for t, x, y in zip(total, p, w)]
            w = [t / sum(total) for t in total]
        mix[b] = w
    expected = []
    for (i, _), ps in zip(rows, pairs):
        logs = []
        for pair in ps:
            b, *p = parts(pair, (0, 1))
            logs.append(math.log10(sum(x * y for x, y in zip(p, mix.get(b, [1 / 3] * 3 if b else [0, 0.5, 0.5])))))
        expected.append((repr(i), len(ps), sum(logs)))
    found = sorted((repr(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    assert [x[:2] for x in found] == [x[:2] for x in sorted(expected)]
    assert all(abs(a[2] - b[2]) < 0.003 * abs(b[2]) for a, b in zip(found, sorted(expected)))


def test_lm_requests_over_several_levels(spark, monkeypatch):
    docs = frame(spark, [(i, sentence(i % 70, 300, 900)) for i in range(300)])
    rows = lambda: sorted((r["doc_id"], r["n_known"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_scoring.score(docs).collect())
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 20_000)
    one = rows()
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 8_000)
    monkeypatch.setattr(lm_scoring, "FAN_BITS", 2)
    assert rows() == one


def test_lm_weights_are_learned_and_bounded():
    w = lm_scoring.weights([(3, 1000, 0.5, 1e-4), (3, 10, 0.0, 1e-4), (1, 50, 0.0, 1e-3)], 1e-6)
    assert w[3][0] > 0.9 and w[1][0] < 0.1 and abs(w[3].sum() - 1) < 1e-9
    assert w[0][0] == 0 and (w[7] > 0).all()


def test_lm_empty(spark):
    assert lm_scoring.score(frame(spark, EMPTY)).collect() == []


# Lines


def brute_lines(rows, least=40, docs=5):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, text in rows:
        for line in set(map(key, (text or "").split("\n"))):
            holders.setdefault(line, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        rank = lambda x: -1 if x is None else x
        gone = [len(key(x)) >= least and len(holders[key(x)]) >= docs and i != max(holders[key(x)], key=rank) for x in lines]
        out.append((repr(i), len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out)


def test_lines_against_brute_force(spark):
    r = random.Random(5)
    common = ["  The same boilerplate LINE stands in many documents here\t", "another quite long line that a few documents hold, too", "short line"]
    rows = [(i, "\n".join(r.choice([*common, f"only here {i} {r.random()} and long enough to count", ""]) for _ in range(r.randrange(1, 9)))) for i in range(60)]
    rows += odd_rows() + [(200 + k, "THE SAME boilerplate line stands in many documents here\n" * 3) for k in range(30)]
    out = dedup_lines(frame(spark, rows))
    assert sorted((repr(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept_text"]) for x in out.collect()) == brute_lines(rows)
    assert {"size", "row", "digest", "n"} <= set(out.columns)
    runs = out.where("n_dropped > 0").first()
    assert sum(x["length"] for x in runs["keep"]) == runs["n_lines"] - runs["n_dropped"]


def test_lines_count_ids_not_versions(spark):
    line = "this is a line of more than forty characters, certainly"
    rows = [(1, f"{line}\nversion {k}") for k in range(5)] + [(0, line)]
    assert all(x["n_dropped"] == 0 for x in dedup_lines(frame(spark, rows)).collect())
    rows += [(k, line) for k in (2, 3, None)] + [(None, f"{line}\nagain")]
    out = sorted((repr(x["doc_id"]), x["n_lines"], x["n_dropped"], x["kept_text"]) for x in dedup_lines(frame(spark, rows)).collect())
    assert out == brute_lines(rows) and sum(x[2] for x in out) == 9


def test_lines_empty(spark):
    assert dedup_lines(frame(spark, EMPTY)).count() == 0


# Decontamination


def test_leaks_against_brute_force(spark):
    r = random.Random(2)
    items = [(k, sentence(1000 + k, n, 3000)) for k, n in enumerate([5, 6, 9, 14, 30, 59, 120, 3, 1])] + [(50, sentence(1004, 30, 3000)), (51, None), (52, " .,; ")]
    rows = [(i, sentence(i, 300, 3000)) for i in range(20, 40)]
    for i in range(40, 80):
        words = items[i % 9][1].split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, f"{sentence(i, 200)}, {' '.join(words).upper()}. {sentence(i + 1, 2000)}"))
    rows += odd_rows()
    found = decontamination.find_leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    words = decontamination.words_of

    def grams(x, n):
        return set(decontamination.shingles_of(words(x), n))

    expected = set()
    for i, text in rows:
        for k, item in items:
            n = min(5, len(words(item)))
            if n and len(g := grams(item, n)) and len(g & grams(text, n)) >= 0.8 * len(g) - 1e-9:
                expected.add((i, k))
    assert {(x["doc_id"], k) for x in found for k in x["item_ids"]} == expected and len(expected) > 20
    kept = decontamination.decontaminate(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    leaked = {i for i, _ in expected}
    assert sorted(map(repr, ((x["doc_id"], x["text"]) for x in kept.collect()))) == sorted(map(repr, (x for x in rows if x[0] not in leaked)))


def test_leaks_of_items_without_ids_and_by_the_shuffle(spark, monkeypatch):
    item, other = sentence(1, 30, 3000), sentence(2, 20, 3000)
    items = spark.createDataFrame([(None, item), (4, other), (None, other), (5, "one two three four five six")], "item_id long, text string")
    rows = [(k, f"{sentence(k, 50)} {item if k % 2 else other} {sentence(k + 9, 50)}") for k in range(10, 40)] + [(None, item), (None, other)]
    seen = []
    for most in (decontamination.BROADCAST_ROWS, 0):
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", most)
        seen.append(sorted((repr(x["doc_id"]), repr(x["item_id"]), x["item_ids"], x["n_found"]) for x in decontamination.find_leaks(frame(spark, rows), items).collect()))
    assert seen[0] == seen[1] and len(seen[0]) == 32
    assert {x[1] for x in seen[0]} == {"None", "4"}
    assert decontamination.decontaminate(frame(spark, rows), items).count() == 0


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_leaks(frame(spark, odd_rows()), none).count() == 0
    assert decontamination.find_leaks(frame(spark, EMPTY), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


# SimHash


def brute_components(prints):
    names = sorted(set(prints))
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(names):
        for y in names[i + 1 :]:
            if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3:
                parent[find(x)] = find(y)
    return {x: find(x) for x in names}


def test_simhash_fingerprint_by_hand():
    import xxhash

    text = "The Quick  brown\tfox JUMPS over"
    words = text.lower().split()
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(4)]
    bits = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > 2)
    assert simhash.simhash(text) & ((1 << 64) - 1) == bits
    assert simhash.simhash("") == 0 == simhash.simhash(" \n")
    assert simhash.simhash("Ä b") & ((1 << 64) - 1) == xxhash.xxh64_intdigest("Ä b", 42)
    assert simhash.simhash("x " * 40000) == simhash.simhash("x x x")


def test_simhash_components_with_nulls_and_repeats(spark):
    rows = [(i, sentence(i % 25, 80)) for i in range(60)] + [(100 + i, sentence(i, 80) + " tail") for i in range(10)] + odd_rows()
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    root = brute_components([x["fp"] for x in got])
    least = {}
    for x in got:
        if x["doc_id"] is not None:
            least[root[x["fp"]]] = min(least.get(root[x["fp"]], 10**9), x["doc_id"])
    assert len(got) == len(rows) and all(x["component_id"] == least.get(root[x["fp"]]) for x in got)
    kept = simhash.dedup_near(frame(spark, rows)).collect()
    assert len(kept) == len(set(root.values())) and set(DOCS.split()[0::2][:1]) <= set(kept[0].asDict())


def test_simhash_crowded_halves(spark):
    r = random.Random(3)
    prints, now = set(), r.getrandbits(63)
    for _ in range(700):
        x = now
        for _ in range(r.choice([1, 2, 3, 3, 5])):
            x ^= 1 << (r.randrange(36, 63) if r.random() < 0.8 else r.randrange(63))
        prints.add(x)
        now = x if r.random() < 0.3 else now
    links = simhash.near_links(spark.createDataFrame([(x,) for x in prints], "fp long"))
    labels = {x["node"]: x["label"] for x in simhash.components(links).collect()}
    root = brute_components(prints)
    groups = lambda of: {frozenset(x for x in prints if of(x) == k) for k in set(map(of, prints))}
    assert groups(lambda x: labels.get(x, x)) == groups(root.get)


def test_simhash_empty(spark):
    assert simhash.near_duplicates(frame(spark, EMPTY)).count() == 0


# Token counts


@pytest.fixture(scope="module")
def bpe():
    return token_counts.Counter(open(token_counts.VOCABULARY, "rb").read())


PIECES = st.lists(st.sampled_from(["a", "b", "Z", "é", " ", "  ", "\n", "'", "'l", "l", "'re", "23", "!", "\t", "日本", "word"]), max_size=60).map("".join)


@settings(max_examples=150, deadline=None)
@given(text=PIECES, edits=st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30), PIECES), max_size=4))
def test_edited_counts_are_those_of_the_whole_text(bpe, text, edits):
    tree = token_counts.build(text, bpe)
    for start, length, new in edits:
        text, _ = token_counts.apply(tree, text, start, start + length, new, bpe)
        assert tree.n_tokens == len(bpe.encode(text))
        assert tree.flat()[0] == [len(x) for x in bpe.split.findall(text)]


def test_edits_encode_only_their_surroundings(bpe):
    text = sentence(1, 20000)
    tree = token_counts.build(text, bpe)
    _, again = token_counts.apply(tree, text, 50_000, 50_010, "new words", bpe)
    assert again < 60


def test_kept_trees_encode_edits_only(spark, bpe):
    text = sentence(1, 20000)
    edits = "array(named_struct('start', {0}, 'end', {0} + 9, 'new', 'other words'))"
    once = token_counts.count_edits(frame(spark, [(1, text), (2, None), (3, "")]).withColumn("edits", F.expr(edits.format(40_000)))).first()
    docs = spark.createDataFrame([(1, once["edited"], once["tree"]), (2, "another text", once["tree"]), (3, "no tree", None)], "doc_id long, text string, kept struct<lengths: array<int>, counts: array<int>>")
    again = token_counts.count_edits(docs.withColumn("edits", F.expr(edits.format(70_000))), tree="kept").collect()
    assert [r["n_encoded"] for r in again] == [0, 12, 7] and again[0]["n_encoded_again"] < 100
    for r in again:
        assert r["n_tokens"] == len(bpe.encode(r["text"])) and r["n_tokens_edited"] == len(bpe.encode(r["edited"])) == sum(r["tree"]["counts"])
        assert "kept" in r.asDict() and "__tree" not in r.asDict()


def test_token_counts_frame(spark, bpe):
    docs = frame(spark, odd_rows()).withColumn("edits", F.expr("case when doc_id > 4 then array(named_struct('start', 1, 'end', 3, 'new', ' xyz '), cast(null as struct<start:int,end:int,new:string>), named_struct('start', 99999999, 'end', null, 'new', 'tail')) end"))
    for r in token_counts.count_edits(docs).collect():
        assert r["n_tokens"] == len(bpe.encode(r["text"] or ""))
        assert r["n_tokens_edited"] == len(bpe.encode(r["edited"])) == sum(r["tree"]["counts"])
        assert r["size"] == -1
    assert token_counts.count_edits(docs.where("false")).count() == 0


# Languages

WORDS = {"en": "the quick brown fox and then they were looking through houses", "de": "der schnelle braune fuchs und dann schauten sie durch häuser", "fr": "le renard brun rapide et puis ils regardaient à travers les maisons"}


def language_rows():
    r = random.Random(4)
    return [(i, " ".join(r.choices(WORDS[k].split(), k=30)), k) for i in range(240) for k in [sorted(WORDS)[i % 3]]]


def test_language_accuracy_and_undetermined(spark):
    rows = language_rows() + [(900, "12 34 !!", "en"), (901, None, "de"), (902, "", None), (None, "the fox", None)]
    out = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows)).collect()}
    assert all(out[i]["lang_pred"] == k for i, _, k in language_rows() if zlib.crc32(str(i).encode()) % 5 == 0)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == out[902]["lang_pred"] == "und" and out[900]["score"] == 0
    assert all(r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_of_a_text_does_not_depend_on_its_place(spark):
    model = language_id.learn(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string"))
    texts = ["maisons", "the", "durch", " ".join(WORDS["en"].split()[:3]), "", "then 1", "x"]
    alone = [tuple(x[0] for x in language_id.fitted_mixtures([t], model)) for t in texts]
    for order in (texts, texts[::-1], texts[3:] + texts[:3]):
        together = dict(zip(order, zip(*language_id.fitted_mixtures(order, model))))
        assert [together[t][0] for t in texts] == [a[0] for a in alone]
        assert all(abs(together[t][1] - a[1]) < 1e-6 and together[t][2] == a[2] for t, a in zip(texts, alone))
    assert [model.languages[a[0]] if a[0] >= 0 else "" for a in alone[:5]] == ["fr", "en", "de", "en", ""]


def test_language_mixture_proportions(spark):
    model = language_id.learn(spark.createDataFrame(language_rows(), "doc_id long, text string, lang string"))
    half = " ".join(WORDS["en"].split() * 6 + WORDS["de"].split() * 3)
    best, share = language_id.mixtures([half, WORDS["fr"] * 3], model)
    assert model.languages[best[0]] == "en" and 0.55 < share[0] < 0.8 and share[1] > 0.95


def test_languages_are_all_learned(spark):
    words = lambda k: " ".join(f"{a}{b}{c}" for a, b, c in [[chr(0x4E00 + 3 * k + x) for x in t] for t in ((0, 1, 2), (1, 2, 0), (2, 0, 1))])
    rows = [(1000 * (j + 1) + k, f"{words(k)} {words(k)}", f"l{k:03}") for k in range(230) for j in range(2 if k < 200 else 1)]
    model = language_id.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230
    best, share = language_id.mixtures([words(k) for k in range(230)], model)
    assert best.tolist() == list(range(230)) and share.min() > 0.9


FIVE = [" ".join("".join(chr(first + (3 * i + j * j) % 20) for j in range(6)) for i in range(30)) for first in (0x61, 0x3B1, 0x430, 0x561, 0x10D0)]


def test_language_sets_of_five(spark):
    model = language_id.learn(spark.createDataFrame([(i, x, f"l{i}") for i, x in enumerate(FIVE)], "doc_id long, text string, lang string"))
    for n in (3, 4, 5):
        _, share = language_id.mixtures([" ".join(FIVE[:n])], model)
        assert abs(share[0] - 1 / n) < 0.02
    best, share, fits = language_id.fitted_mixtures([" ".join(FIVE), "\u4e00\u4e01\u4e02 \u4e03\u4e04\u4e05 " * 9], model)
    assert fits.tolist() == [True, False]


def test_language_without_labels(spark):
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, odd_rows())).collect()} == {"und"}
    assert language_id.identify(frame(spark, EMPTY)).count() == 0


# Mixing


def test_mix_meets_targets(spark):
    r = random.Random(6)
    sizes = {"b": 40, "a": 400, "c": 200, None: 100}
    rows = [(i, sentence(i, r.randrange(1, 30)), None, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))] + [(5000, None, None, "a"), (5001, "", None, "empty")]
    out = mix(frame(spark, rows)).collect()
    assert len(out) == len(rows) and all(0 <= x["taken"] <= 2 * x["size"] and x["taken"] % max(x["size"], 1) == 0 for x in out)
    total = sum(x["size"] for x in out)
    by = {}
    for x in out:
        t = by.setdefault(x["source"], [x["source_size"], x["target"], 0, 0])
        t[2] += x["size"]
        t[3] += x["taken"]
    assert all(t[0] == t[2] and abs(t[3] - t[1]) <= 15 for t in by.values())
    assert abs(sum(t[1] for t in by.values()) - 1.5 * total) < 1e-6
    order = ["a", "b", "c", "empty", None]
    weight = dict(zip(order, [3, 1, 2, 3, 1]))
    level = {by[s][1] / weight[s] for s in order if by[s][1] < 2 * by[s][0] - 1e-9}
    assert max(level) - min(level) < 1e-9 and all(2 * by[s][0] / weight[s] <= max(level) + 1e-9 for s in order if by[s][1] >= 2 * by[s][0] - 1e-9)
    again = mix(frame(spark, rows[::-1]).repartition(3)).collect()
    assert sorted((x["doc_id"], x["taken"]) for x in again) == sorted((x["doc_id"], x["taken"]) for x in out)


def test_mix_takes_no_document_more_than_twice(spark):
    rows = [(1, "a b c", None, "s"), (2, "", None, "s"), (3, None, None, "s"), *((k, "x " * 50, None, "t") for k in range(10, 90))]
    out = {x["doc_id"]: x for x in mix(frame(spark, rows)).collect()}
    assert all(x["copies"] <= 2 for x in out.values()) and out[1]["taken"] == 6 and out[2]["taken"] == out[3]["taken"] == 0


def test_mix_odd_rows_and_empty(spark):
    out = mix(frame(spark, odd_rows())).collect()
    assert len(out) == len(odd_rows())
    assert mix(frame(spark, EMPTY)).count() == 0


# Substrings


def test_repeated_passages_are_found_and_cut(spark):
    passage = sentence(77, 70, 5000)
    rows = [(i, sentence(i, 200, 5000)) for i in range(30)] + [(40, f"{sentence(40, 90, 5000)} {passage} {sentence(41, 50, 5000)}"), (50, f"{sentence(50, 33, 5000)}x {passage}, {sentence(51, 80, 5000)}"), (60, passage)]
    rows += [(70, f"{sentence(70, 100, 5000)} {sentence(99, 15, 5000)} {sentence(71, 90, 5000)}"), (80, f"{sentence(80, 100, 5000)} {sentence(99, 15, 5000)} {sentence(81, 90, 5000)}")]
    rows += odd_rows()
    found = substring_dedup.find_repeats(frame(spark, rows)).collect()
    assert {x["doc"] for x in found} == {40, 50, 60} and {x["first_doc"] for x in found} == {40}
    texts = dict(rows)
    for x in found:
        inside = texts[x["doc"]][x["start"] : x["start"] + x["n_chars"]]
        assert inside.strip() in texts[40]
    out = {x["doc_id"]: x["text"] for x in substring_dedup.drop_repeats(frame(spark, rows)).collect()}
    assert out[40] == texts[40] and len(out[60]) < 90 and len(out[50]) < len(texts[50]) - 250 and out[1] == texts[1]


def test_repeated_passages_with_a_common_chunk(spark):
    passage = sentence(5, 80, 5000)
    rows = [(i, f"{sentence(i, 20, 5000)} {passage}") for i in range(400)]
    found = substring_dedup.find_repeats(frame(spark, rows)).collect()
    assert {x["doc"] for x in found} == set(range(400)) and {x["first_doc"] for x in found} == {0}


def test_common_passages_are_found_alike_whether_salted_or_not(spark, monkeypatch):
    passage, twice = sentence(5, 80, 5000), "one and the same words " * 30
    rows = [(i, f"{sentence(i, 20, 5000)} {passage} {twice}") for i in range(90, 40, -1)] + [(200 + i, sentence(i + 300, 90, 5000)) for i in range(20)] + [(None, passage), (300, "x " * 400), (301, "x " * 300)]
    seen = []
    for look in (1, 1 << 40):  # all documents are looked at, or next to none
        monkeypatch.setattr(substring_dedup, "LOOK", look)
        seen.append(sorted(map(repr, substring_dedup.find_repeats(frame(spark, rows)).collect())))
    assert seen[0] == seen[1] and len(seen[0]) >= 52
    found = [r for r in substring_dedup.find_repeats(frame(spark, rows)).collect() if r["doc"] in range(41, 91)]
    assert {r["first_doc"] for r in found} <= {41, substring_dedup_doc(spark, passage)} and not [r for r in found if r["doc"] == 41 and r["cuts"] and r["first_doc"] == 41]


def substring_dedup_doc(spark, text):
    """What stands for the id of a text without one."""
    return frame(spark, [(None, text)]).select(substring_dedup.doc_number().alias("d")).first()["d"]


def test_repeated_passages_of_just_the_least_length(spark):
    rows = []
    for i in range(120):
        r = random.Random(i)
        vocabulary = "abcdefghij" if i % 4 == 0 else [f"w{k}" for k in range(5000)]  # one-letter words: the fewest bytes
        words = lambda n: " ".join(r.choices(vocabulary, k=n))  # noqa: E731, B023
        passage = words(50 + i % 6 if i < 110 else 49)
        for doc in (2 * i, 2 * i + 1):
            rows.append((doc, f"{words(r.randrange(90))} {'(' * (i % 3 == 0)}L{doc} {passage} R{doc} {words(r.randrange(90))}"))
    found = substring_dedup.find_repeats(frame(spark, rows)).collect()
    assert {x["doc"] for x in found} == set(range(220))
    assert all(x["n_words"] >= 50 for x in found) and all(x["n_words"] == 50 + x["doc"] // 2 % 6 for x in found)


def test_passages_put_together_from_two_documents_stay(spark):
    one, two = sentence(500, 26, 5000), sentence(501, 26, 5000)
    rows = [(1, f"{sentence(1, 80, 5000)} {one} {sentence(2, 80, 5000)}"), (2, f"{sentence(3, 80, 5000)} {two} {sentence(4, 80, 5000)}"), (3, f"{sentence(5, 80, 5000)} {one} {two} {sentence(6, 80, 5000)}")]
    assert not substring_dedup.find_repeats(frame(spark, rows)).collect()
    assert {r["doc_id"]: r["text"] for r in substring_dedup.drop_repeats(frame(spark, rows)).collect()} == dict(rows)


def test_chunks_cover_the_text_and_resist_shifts():
    text = sentence(3, 500).encode()
    ends = substring_dedup.chunk_ends(text)
    pieces = {text[a:b] for a, b in zip([0, *ends], ends)}
    assert ends[-1] == len(text) and all(b - a <= substring_dedup.MOST for a, b in zip([0, *ends], ends))
    moved = b"inserted " + text
    ends = substring_dedup.chunk_ends(moved)
    assert len(pieces & {moved[a:b] for a, b in zip([0, *ends], ends)}) > 0.9 * len(pieces)
    for data in (b"a" * 1000, "日本語".encode() * 200, b"x"):
        ends = substring_dedup.chunk_ends(data)
        assert ends[-1] == len(data)
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()


def test_substrings_empty(spark):
    assert substring_dedup.find_repeats(frame(spark, EMPTY)).count() == 0


# Winnowing


def brute_winnow(words, gram=5, window=4):
    mask = (1 << 64) - 1
    words = [winnowing.START] * (gram - 1) + list(words) if words else []
    turn = lambda x, b: (x << b | x >> 64 - b) & mask if b else x
    grams = []
    for i in range(len(words) - gram + 1):
        h = 0
        for j in range(gram):
            h ^= turn(words[i + j] & mask, gram - 1 - j)
        grams.append(h)
    out = []
    for i in range(max(1, len(grams) - window + 1)):
        best = min(range(i, min(len(grams), i + window)), key=lambda p: (grams[p] >> 33, -p))
        if best not in out:
            out.append(best)
    return [(grams[p], p) for p in out]


def test_winnowing_against_brute_force(spark):
    rows = odd_rows() + [(i, sentence(i, n)) for i, n in enumerate([5, 6, 7, 8, 9, 50, 51], 20)] + [(60, "same " * 40)]
    words = F.transform(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), lambda w: F.xxhash64(w))
    for r in winnowing.with_fingerprint(frame(spark, rows).select("doc_id", "text"), "text", "f").withColumn("words", words).collect():
        got = [(x["hash"] & (1 << 64) - 1, x["position"]) for x in r["f"]]
        assert got == (brute_winnow(r["words"]) if r["words"] else [])


def test_next_document_goes_down_and_around(spark):
    rows = [(i * 7 % 101, f"text {i}") for i in range(101)] + [(None, "last"), (None, "last but one")]
    out = winnowing.with_next(frame(spark, rows)).collect()
    hashed = dict(spark.createDataFrame([("last",), ("last but one",)], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + sorted(((None, t) for t in hashed), key=lambda r: hashed[r[1]])
    after = {(i, x): order[(k + 1) % len(order)][1] for k, (i, x) in enumerate(order)}
    assert len(out) == len(rows) and all(after[r["doc_id"], r["text"]] == r["next"]["text"] for r in out)
    one = winnowing.with_next(frame(spark, [(1, "alone")])).collect()
    assert one[0]["next"]["text"] == "alone"
    assert winnowing.with_next(frame(spark, EMPTY)).count() == 0


def test_winnowing_guarantee(spark):
    shared = sentence(9, 8, 5000)
    rows = [(1, f"{sentence(1, 30, 5000)} {shared} {sentence(2, 30, 5000)}"), (2, f"{sentence(3, 17, 5000)} {shared} {sentence(4, 5, 5000)}")]
    a, b = ({x["hash"] for x in r["f"]} for r in winnowing.with_fingerprint(frame(spark, rows), "text", "f").collect())
    assert a & b
    assert re.fullmatch("[0-9a-f]{32}", winnowing.with_fingerprint(frame(spark, rows), "text", "f").select(winnowing.digest("f").alias("d")).first()["d"])


def test_likeness_changes_steadily_with_length(spark):
    """A text and itself with a word, or a character of an unspaced script, more: no length at which another measure begins."""
    r = random.Random(17)
    lengths = [*range(5, 41), 63, 64, 65, 127, 128, 129, 199, 200]
    spaced = lambda n: [f"w{r.randrange(10**6)} " for _ in range(n)]
    unspaced = lambda n: [chr(0x4E00 + r.randrange(6000)) for _ in range(n)]
    for kind in (spaced, unspaced):
        rows = []
        for n in lengths:
            for _ in range(30):
                whole = kind(n + 1)
                rows.append((n, "".join(whole[:-1]), "".join(whole)))
        df = spark.createDataFrame(rows, "n int, a string, b string")
        df = winnowing.with_marks(winnowing.with_marks(df, "a", "p"), "b", "q")
        near = dict(df.groupBy("n").agg(F.avg(winnowing.likeness(winnowing.hashes("p"), winnowing.hashes("q")))).collect())
        assert all(abs(near[m] - near[n]) < 0.1 for m, n in zip(lengths, lengths[1:])) and near[5] > 0.6 and near[200] > 0.97


def test_one_deletion_in_an_unspaced_text(spark):
    r = random.Random(16)
    text = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    rows = [(1, text), (2, text[:700] + text[701:])]
    out = winnowing.with_marks(frame(spark, rows), "text", "f").agg(F.collect_list(winnowing.hashes("f")).alias("p"))
    assert out.select(winnowing.likeness(F.col("p")[0], F.col("p")[1]).alias("near")).first()["near"] > 0.98


def test_winnowing_of_unspaced_and_short_texts(spark, tmp_path):
    r = random.Random(6)
    unspaced = lambda n: "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(n))
    short = "seven words are here and no more"
    rows = [(1, unspaced(400)), (2, unspaced(300)), (3, short), (4, "others entirely stand in this line"), (5, "A" * 5000), (6, None), (7, ""), (8, "x"), (9, sentence(9, 60, 5000)), (10, sentence(10, 60, 5000))]
    frame(spark, rows).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    out = {x["doc_id"]: x for x in queries.op10_winnowing(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    assert all(0.1 < out[i]["near_edited"] < 0.9 for i in (1, 2, 9, 10))
    # Seven words have four windows, of which the edit may leave none.
    assert all(0 <= out[i]["near_edited"] < 0.9 for i in (3, 4))
    shared = unspaced(8)
    rows = [(1, unspaced(200) + shared + unspaced(50)), (2, unspaced(33) + shared + unspaced(90))]
    a, b = ({x["hash"] for x in y["f"]} for y in winnowing.with_marks(frame(spark, rows), "text", "f").collect())
    assert a & b
