"""Source divergence, tokenizer alignment and toxicity against plain Python: odd rows, ties, tiny limits, held-out accuracy."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import frame, odd_rows, sentence
from tidebar.llm import alignment, toxicity
from tidebar.llm.divergence import divergence
from tidebar.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows):
    docs = [((lang or ""), (source or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        holders = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in holders.items() if n >= 3)
        total = Counter(t for d in mine for t in d[2])
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            count[s].update(t for t in terms if holders[t] >= 3)
        share = lambda c, n: 1 + 10**9 * (c + 1) // (n + len(kept))
        f = lambda p, q: (p - q) ** 2 // q
        n_all = sum(total[t] for t in kept)
        for s, c in count.items():
            n = sum(c.values())
            pairs = [(o, sum(f(share(c[t], n), share(count[o][t], sum(count[o].values()))) for t in kept)) for o in count if o != s]
            terms = [(t, f(share(c[t], n), share(total[t], n_all))) for t in kept if c[t] and share(c[t], n) > share(total[t], n_all)]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(found, 1) if part == "pair" or k <= 200]
    return sorted(out)


def test_divergence(spark):
    r = random.Random(3)
    vocabulary = ["The", "the", "Äpfel", "äpfel", "naïve", "don't", "x1y2", "日本", "😀", "É", "é"] + [f"w{k}" for k in range(300)]
    rows = [(" ".join(r.choice(vocabulary[: r.choice([8, 40, 311])]) for _ in range(r.randrange(1, 90))), r.choice(["en", "en", "de", None]), r.choice(["a", "b", "é", "Z", None])) for _ in range(150)]
    rows += [(x, None, "odd") for _, x in odd_rows()] + [(None, "xx", s) for s in ("p", "q", "q", None)] + [("same same same", "yy", "one")] * 3 + [("rare words here", "zz", "alone")]
    given = [(k, *x) for k, x in enumerate(rows)]
    got = sorted(map(tuple, divergence(frame(spark, given)).collect()))
    assert got == brute_divergence(rows)
    assert {x[2] for x in got} == {"pair", "term"} and any(x[0] == "xx" and x[4] == 0 for x in got)
    assert divergence(frame(spark, given).limit(0)).count() == 0


def test_divergence_ranks_end_at_200(spark):
    many = " ".join(f"t{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300))
    rows = [(many, "en", "a")] * 3 + [("other words only", "en", "b")] * 3
    got = sorted(map(tuple, divergence(frame(spark, [(k, *x) for k, x in enumerate(rows)])).collect()))
    assert got == brute_divergence(rows) and sum(x[2] == "term" and x[1] == "a" for x in got) == 200


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    import tokenizers

    a = tokenizers.Tokenizer.from_file(alignment.VOCABULARY_A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.VOCABULARY_B)
    byte_of, names = alignment._byte_of(), {i: t for t, i in a.get_vocab().items()}
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def encode(text):
        """Both libraries over the whole text at once."""
        i, j = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        return (i, [bytes(byte_of[c] for c in names[k]) for k in i]), (j, [piece(k) for k in j])

    return encode


def brute_alignment(texts, encode):
    rows, counts = [], Counter()
    for text in texts:
        (a, x), (b, y) = encode(text) if text else (([], []), ([], []))
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            rows.append(None)
            continue
        i = j = end_a = end_b = 0
        links, groups = [], [([], [])]
        end_a, end_b = len(x[0]), len(y[0])
        groups[0][0].append(a[0]), groups[0][1].append(b[0])
        while True:
            links.append((a[i], b[j]))
            step_a, step_b = end_a <= end_b, end_b <= end_a
            i, j = i + step_a, j + step_b
            if i == len(a):
                break
            if step_a and step_b:
                groups.append(([], []))
            if step_a:
                end_a += len(x[i])
                groups[-1][0].append(a[i])
            if step_b:
                end_b += len(y[j])
                groups[-1][1].append(b[j])
        counts.update(set(links))
        written = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        rows.append((len(a), len(b), len(groups), links, hashlib.sha256(written.encode()).hexdigest()))
    best = Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (*r[:3], len(r[3]), sum(counts[x] == best[x[0]] for x in r[3]), sum(counts[x] for x in r[3]), r[4]) for r in rows]


def odd_texts():
    r = random.Random(4)
    texts = ["", None, " ", "a", "a  b", " lead", "trail ", "x\n y", "tab\tx  \n\n y", "▁ under", "a▁ b", "日本語 テキスト、です。", "é é ﬁ ½", "<s> </s> <|endoftext|> <0x41> <unk>", "😀😀 x", "\x00 a \x00b", "don't it's we'll I'M", "　 全角", "z" * 5000, "日" * 3000, "same", "same", "a\x1c b", sentence(2, 30000)]
    return texts + ["".join(r.choice("ab \n日▁é0<>.'") for _ in range(r.randrange(1, 60))) for _ in range(60)]


def test_alignment(spark, sides, tmp_path):
    texts = odd_texts()
    frame(spark, [(None if k % 9 == 4 else k // 2, t) for k, t in enumerate(texts)]).coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op12_alignment"](spark, str(tmp_path)).collect()
    expected = [(None if k % 9 == 4 else k // 2, *x) for k, x in enumerate(brute_alignment(texts, sides))]
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(repr(tuple(r[c] for c in names)) for r in got) == sorted(map(repr, expected))
    empty = alignment.align(frame(spark, [(1, "x")]).limit(0))
    assert empty.count() == 0 and tuple(empty.columns) == names


def test_alignment_in_small_pieces(spark, sides, monkeypatch):
    """Spans of 64 bytes, and as few tokens at once as one: the open group and the pairs are carried on."""
    monkeypatch.setattr(alignment, "SPAN", 64)
    r = random.Random(5)
    texts = ["".join(r.choice("abc  \n日é0.'") for _ in range(r.randrange(1, 900))) for _ in range(25)] + ["", "日" * 2000, "z" * 2000]
    docs = frame(spark, list(enumerate(texts))).coalesce(1)
    dealt, sent = alignment._dealt(docs, alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    batch = pa.RecordBatch.from_pylist([x.asDict() for x in sorted(dealt.collect(), key=lambda x: (x.row, x.span, x.side))])
    both = (alignment.ByteSide(sent.value[0]), alignment.PieceSide(sent.value[1]))
    lengths, table = [alignment._lengths(s) for s in both], alignment._table()
    expected = brute_alignment(texts, sides)
    for at_once in (1, 50, 300, 1 << 20):
        got, parted = {}, 0
        for found_docs, found, ends, goes_on in alignment.sweep(iter([batch]), lengths, at_once):
            alignment._taken(found_docs, found, ends, table, len(both[1].token_bytes))
            parted += goes_on
            for d in found_docs[: len(found_docs) - goes_on]:
                got[d.doc_id] = (*map(int, d.n), int(d.times.sum()), d.digest.hexdigest() if d.digest else "")
        assert got == {k: (*e[:4], e[3], e[6]) for k, e in enumerate(expected)}
        assert (parted > 0) == (at_once <= 300)
    groups = alignment.groups(docs).toPandas().sort_values(["doc_id", "group"])
    for k, text in enumerate(texts):
        mine = groups[groups.doc_id == k]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in zip(mine.a_ids, mine.b_ids))
        assert (hashlib.sha256(written.encode()).hexdigest() if written else "") == expected[k][6]
        assert list(mine.group) == list(range(len(mine))) and list(mine.start)[1:] == list(mine.end)[:-1]
        assert not len(mine) or (mine.start.min(), mine.end.max()) == (0, len(text.encode()) + 1)
        assert sum(map(len, mine.links)) == expected[k][3]


def test_sequences_of_the_string_kernel():
    """Numbers and weights of all four-letter sequences, by going through all choices of places."""
    text = "Ab-c dé.f g!\nqrs 日t. Uv w"
    letters, decays = [], []
    gone = 0.0
    for i, c in enumerate(text):
        if c.isalpha():
            letters.append(int(toxicity._tables()[0][ord(c)]))
            decays.append(gone)
            gone = 0.0
            continue
        end = i + 1 < len(text) and c in ".!?" and text[i + 1].isspace()
        lone = c == " " and 0 < i < len(text) - 1 and all(text[j].isalpha() for j in (i - 1, i + 1)) and (i < 2 or not text[i - 2].isalpha()) and not text[i + 2 : i + 3].isalpha()
        gone += toxicity.CUT if c == "\n" or end else math.log(toxicity.SIGN if lone or not c.isspace() else toxicity.SPACE)
    expected = Counter()
    for places in itertools.combinations(range(len(letters)), 4):
        if places[3] - places[0] < toxicity.REACH:
            number = sum(letters[p] << (5 * (3 - k)) for k, p in enumerate(places))
            expected[number] += toxicity.LETTER ** (places[3] - places[0] - 3) * math.exp(sum(decays[places[0] + 1 : places[3] + 1]))
    got = Counter()
    for _, number, weight in toxicity.Letters.of([text]).sequences():
        for k, w in zip(number.tolist(), weight.tolist()):
            got[k] += w
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-5 for k in got)


INSULTS = ["blorfen", "skrunk", "vexomad", "quispot"]


def labelled(n, seed):
    r = random.Random(seed)
    parts = ["ta", "re", "ing", "lo", "se", "mi", "on", "ver", "ch", "un", "da", "po", "ku", "est"]
    rows = []
    for k in range(n):
        words = ["".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 120))]
        toxic = r.random() < 0.15
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(INSULTS) + r.choice(["", "s", "ig"]))
        for at in range(9, len(words), 11):
            words[at] += "."
        rows.append((k, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def machine():
    rows = labelled(1500, 6)
    return toxicity.fit([t for _, t, _ in rows], [y for _, _, y in rows])


def test_toxicity_of_held_out_texts(machine):
    rows = labelled(1200, 7)
    score = machine.score([t for _, t, _ in rows])
    toxic = np.array([y for _, _, y in rows], bool)
    assert (score[toxic] >= toxicity.THRESHOLD).mean() > 0.97 and (score[~toxic] >= toxicity.THRESHOLD).mean() < 0.02


@pytest.mark.parametrize("change", ["signs", "gap", "letter", "spaced"])
def test_insults_pulled_apart(machine, change):
    r = random.Random(8)

    def changed(found):
        w = found.group()
        k = r.randrange(2, len(w) - 1)
        return {"signs": "-".join(w), "gap": w[:k] + " " + w[k:], "letter": w[:k] + r.choice("xz") + w[k:], "spaced": " ".join(w)}[change]

    texts = [re.sub("|".join(INSULTS), changed, t) for _, t, y in labelled(1200, 9) if y]
    assert (machine.score(texts) >= toxicity.THRESHOLD).mean() > (0.7 if change == "letter" else 0.9)


def test_very_long_texts_are_scored_whole(machine, monkeypatch):
    clean = " ".join(t for _, t, y in labelled(300, 10) if not y)
    texts = [clean, clean[:40001] + " blorfen " + clean[40001:], clean + " vexomad", "", "日本" * 500, "a" * 50000]
    whole = machine.score(texts)
    assert whole[0] < toxicity.THRESHOLD and (whole[1:3] >= toxicity.THRESHOLD).all() and whole[3] < toxicity.THRESHOLD
    for at_once in (997, 4096, 40005):
        monkeypatch.setattr(toxicity, "AT_ONCE", at_once)
        assert np.allclose(machine.score(texts), whole, atol=2e-3)


def test_toxicity_query(spark, tmp_path):
    rows = labelled(500, 11)
    odd = [(i if i is None else 9000 + i, t) for i, t in odd_rows()]
    frame(spark, [(k, t) for k, t, _ in rows] + odd).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, 1, y) for k, _, y in rows] + [(0, 1, rows[0][2]), (None, 1, 1), (9006, 0, 0), (123456, 1, 1), (7, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["op13_toxicity"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + len(odd)
    known = {k: y for k, _, y in rows}
    held = [r for r in got if r.held_out and r.doc_id in known]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    right = [r.predicted == known[r.doc_id] for r in held]
    assert len(held) > 80 and sum(right) / len(right) > 0.9
    assert len({r.score for r in got if r.doc_id == 9006}) == 1  # repeated rows


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "some text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.toxicity(docs.withColumn("score", docs.n), none)
    assert [r.score for r in out.collect()] == [0.5, 0.5] and set(docs.columns) < set(out.columns)
    one = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, one).collect()} == {round(1 / 3, 6)}
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
