"""Toxicity by a support vector machine with a subsequence string kernel, which still sees an insult that is pulled apart.

The kernel of two strings is the sum, over all sequences of four letters, of the product of their weights in both. A sequence's weight
in a string is the sum over the places where its letters occur in that order within a few letters, times a decay for every
character skipped: letters in between count a lot, signs and spaces little. So `id-io.t` and `idxiot` keep most of what
they share with `idiot`. Strings here are windows of some letters; sequences end with the sentence.

Nyström: the machine works on the kernel values with a few landmarks, whitened by the landmarks' own kernel matrix. Its
decision for a window is then a weighted sum of kernel values with landmarks, which is a weighted sum over the window's own
four-letter sequences. That is how texts are scored: one table of weights, a few look-ups a letter, no kernel matrix.

Labels belong to documents, insults to sentences. Of a toxic document the window that the machine finds most toxic stands for
it, chosen again in each round; of clean documents all windows are clean, and those that score highest come in.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import part

#: Letters in a sequence, from its first to its last at most, and in a window.
LENGTH, REACH, WINDOW = 4, 6, 8
BITS = 5
#: Decay of a skipped letter, white space, and other character.
LETTER, SPACE, SIGN = 0.5, 0.7, 0.9
#: What ends a sentence: no sequence goes on over it.
CUT = -60.0
#: Between texts: a line's end and as many letters of no class as a window has, so that no window sees two texts.
BREAK = "\n" + WINDOW * "\ud800"
#: Labelled documents to learn from at most (by a hash of their id; toxic, clean), the longest of them, and characters in all.
LEARN_TOXIC, LEARN_CLEAN, LEARN_LONGEST, LEARN_CHARS = 1000, 2000, 8_000, 4_000_000
#: Landmarks: fragments typical of toxic documents, and others.
TYPICAL, OTHERS = 160, 64
SLACK = 1.0
#: A window's kernel value with a fragment that counts as found at first; all of a fragment gives 1.
FOUND = 0.9
#: Part of its score that an insult keeps with a sign put in; with other letters put in it is some half.
APART = 0.8
ROUNDS = 5
#: Windows of a clean document that come in as examples a round.
HARD = 3
THRESHOLD = 0.3
#: Characters of text that are scored at once.
AT_ONCE = 1 << 20


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of each 16-bit character (0: no letter; 1 to 26: a to z without accents; from 27 on other letters) and its log decay."""
    kind, decay = np.zeros(1 << 16, np.uint8), np.full(1 << 16, np.log(SIGN), np.float32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            base = unicodedata.normalize("NFKD", c)[0].lower()[0]
            base = "s" if base == "ß" else base
            kind[code] = ord(base) - 96 if "a" <= base <= "z" else 27 + code % 5
        elif c.isspace():
            decay[code] = np.log(SPACE)
    decay[ord("\n")] = CUT
    return kind, decay


@dataclass
class Letters:
    """The letters of texts in a row: class, log decay of the characters before each (summed up), and where texts begin."""

    kind: np.ndarray
    gone: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Letters:
        kinds, decays = _tables()
        codes = np.frombuffer(BREAK.join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(codes < 1 << 16, codes, 0xFFFF)  # beyond: signs
        kind, decay = kinds[codes], decays[codes]
        ends = (codes == 46) | (codes == 33) | (codes == 63)
        decay[:-1][ends[:-1] & (decay[1:] == np.float32(np.log(SPACE))) & (kind[1:] == 0)] = CUT
        letter = (kind > 0) | (codes == ord(BREAK[-1]))
        # A space between two letters that stand alone is a sign like others: an insult written letter by letter.
        alone = letter.copy()
        alone[1:] &= ~letter[:-1]
        alone[:-1] &= ~letter[1:]
        between = decay[1:-1] == np.float32(np.log(SPACE))
        decay[1:-1][between & alone[:-2] & alone[2:]] = np.log(SIGN)
        # Summed up in double: differences of neighbours are what matters.
        gone = np.cumsum(np.where(letter, 0, decay), dtype=np.float64)[letter]
        begin = np.r_[0, np.cumsum([len(t) + len(BREAK) for t in texts[:-1]])].astype(np.int64)
        return cls(kind[letter].astype(np.int32), gone, np.r_[0, np.cumsum(letter)][begin])

    def sequences(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(distance, number of the sequence by its first place, weight by its first place) for each choice of places."""
        k, n = self.kind, len(self.kind)
        for far in range(LENGTH - 1, REACH):
            if n <= far:
                return
            weight = (LETTER ** (far - LENGTH + 1) * np.exp(self.gone[far:] - self.gone[:-far])).astype(np.float32)
            ends = (k[: n - far] << (3 * BITS)) | k[far:]
            for i in range(1, far - 1):
                two = ends | (k[i : n - far + i] << (2 * BITS))
                for j in range(i + 1, far):
                    yield far, two | (k[j : n - far + j] << BITS), weight


def window_scores(letters: Letters, table: np.ndarray) -> np.ndarray:
    """By letter: the sum over the sequences that end at it or up to WINDOW - 1 letters before."""
    at = np.zeros(len(letters.kind), np.float32)
    for far, number, weight in letters.sequences():
        at[far:] += table[number] * weight
    out = at.copy()
    step = 1
    while step < WINDOW:  # WINDOW is a power of two
        out[step:] += out[:-step].copy()
        step *= 2
    return out


def best_windows(scores: np.ndarray, starts: np.ndarray, floor: float = 0.0) -> np.ndarray:
    """The highest score of each text, at least that of an empty window."""
    if not len(scores):
        return np.full(len(starts), floor, np.float32)
    ends = np.r_[starts[1:], len(scores)]
    some = ends > starts
    out = np.full(len(starts), floor, np.float32)
    out[some] = np.maximum(np.maximum.reduceat(scores, starts[some]), floor)
    return out


@dataclass
class Machine:
    table: np.ndarray
    slope: float
    shift: float

    def chance(self, best: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -500, 500)))

    def score(self, texts: list[str]) -> np.ndarray:
        """The chance that each text is toxic; texts of any length, in pieces that overlap by what a window sees."""
        out = np.zeros(len(texts), np.float32)
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size < AT_ONCE):
                size += len(texts[upto])
                upto += 1
            if upto == at + 1 and size > AT_ONCE:
                out[at] = self._long(texts[at])
            else:
                letters = Letters.of(texts[at:upto])
                out[at:upto] = best_windows(window_scores(letters, self.table), letters.starts)
            at = upto
        return self.chance(out)

    def _long(self, text: str) -> float:
        """The best window of a very long text. A piece begins so many letters before the one before it ended."""
        best, begin = 0.0, 0
        while True:
            end = min(len(text), begin + AT_ONCE)
            letters = Letters.of([text[begin:end]])
            best = max(best, float(best_windows(window_scores(letters, self.table), letters.starts)[0]))
            if end == len(text):
                return best
            back, seen = end, 0
            while back > begin + 1 and seen < WINDOW + REACH:
                back -= 1
                seen += text[back].isalpha()
            begin = back


def _fragments(letters: Letters, toxic: np.ndarray, n: int) -> list[tuple[int, ...]]:
    """Runs of 4 to 6 letters that are in more toxic texts than chance explains, such that most toxic texts have several.

    Of all runs tried (those of two toxic texts or more) about e**SLACK at most should get through by chance: the Chernoff
    bound of a run's share of toxic texts against theirs among all.
    """
    text_of = np.repeat(np.arange(len(toxic)), np.diff(np.r_[letters.starts, len(letters.kind)]))
    n_toxic, n_clean, common = toxic.sum(), (~toxic).sum(), toxic.mean()
    held: list[np.ndarray] = []
    names: list[tuple[int, ...]] = []
    rank: list[float] = []
    for size in (4, 5, 6):
        m = len(letters.kind) - size + 1
        if m <= 0:
            continue
        number = np.zeros(m, np.int64)
        for j in range(size):
            number = (number << BITS) | letters.kind[j : m + j]
        whole = letters.gone[size - 1 :] == letters.gone[:m]
        key = np.unique((number[whole] << 20) | text_of[:m][whole])
        number, text = key >> 20, key & ((1 << 20) - 1)
        first = np.flatnonzero(np.diff(number, prepend=-1))
        a = np.add.reduceat(toxic[text].astype(np.int64), first) if len(first) else np.zeros(0)
        b = np.diff(np.r_[first, len(number)]) - a
        ratio = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
        value = a * np.log(ratio)
        mine = a / np.maximum(a + b, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.nan_to_num(mine * np.log(mine / common)) + np.nan_to_num((1 - mine) * np.log((1 - mine) / (1 - common)))
        tried = max(1, int((a >= 2).sum()))
        good = np.flatnonzero((a >= 2) & (mine > common) & ((a + b) * gap > np.log(tried) - SLACK))
        for g in good[np.argsort(-value[good], kind="stable")[: 8 * n]]:
            upto = first[g + 1] if g + 1 < len(first) else len(number)
            mine = text[first[g] : upto]
            held.append(mine[toxic[mine]])
            names.append(tuple(int(number[first[g]] >> (BITS * (size - 1 - j))) & 31 for j in range(size)))
            rank.append(float(value[g] / a[g]))
    # The next fragment is the one that adds most to texts that have few yet; a text's tenth adds little.
    had, out, left = np.zeros(len(toxic)), [], list(range(len(names)))
    while left and len(out) < n:
        gains = np.array([rank[i] * (0.7 ** had[held[i]]).sum() for i in left])
        top = int(gains.argmax())
        if gains[top] < 1:
            break
        i = left.pop(top)
        had[held[i]] += 1
        out.append(names[i])
    return out


def _weights(fragment: tuple[int, ...]) -> dict[int, float]:
    """The sequences of a fragment, as one unit of length."""
    found: dict[int, float] = {}
    letters = Letters(np.array(fragment, np.int32), np.zeros(len(fragment)), np.zeros(1, np.int64))
    for _, number, weight in letters.sequences():
        for k, w in zip(number.tolist(), weight.tolist()):
            found[k] = found.get(k, 0.0) + w
    norm = np.sqrt(sum(w * w for w in found.values()))
    return {k: w / norm for k, w in found.items()}


def _machine(z: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, both classes weighing as much as the smaller has examples, by Newton steps."""
    z = np.c_[z, np.ones(len(z))]
    n = np.where(y > 0, (y > 0).sum(), (y < 0).sum())
    cost = c * n.min() / n
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(z.shape[1])
    for _ in range(30):
        inside = y * (z @ w) < 1
        s = z[inside] * cost[inside, None]
        new = np.linalg.solve(ridge + s.T @ z[inside], s.T @ y[inside])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the chance of y (0 or 1) given x, with the usual smoothed goals."""
    pos, neg = y.sum(), (1 - y).sum()
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    design = np.c_[x, np.ones(len(x))]
    w = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2), design.T @ (goal - p) - 1e-6 * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _originals(texts: list[str]) -> list[int]:
    """Places of texts without those that share half of their stretches with texts before: copies are no further evidence."""
    letters = Letters.of(texts)
    ends = np.r_[letters.starts[1:], len(letters.kind)]
    number = np.zeros(max(0, len(letters.kind) - 11), np.int64)
    for j in range(12):
        number = (number << BITS) | letters.kind[j : len(number) + j]
    number *= np.int64(0x5851F42D4C957F2D)
    seen: set[int] = set()
    out = []
    for k, (i, j) in enumerate(zip(letters.starts, ends)):
        mine = number[i : max(i, j - 11)]
        mine = set(mine[(mine >> 60) & 7 == 0].tolist())
        if 2 * len(mine & seen) <= len(mine):
            out.append(k)
        seen |= mine
    return out


def fit(texts: list[str], labels: list[int]) -> Machine:
    """The machine for these texts and labels (1: toxic). Without both labels every text gets the share of toxic ones."""
    places = _originals(texts) if texts else []
    texts, toxic = [texts[k] for k in places], np.array([labels[k] for k in places], dtype=bool)
    table = np.zeros(1 << (LENGTH * BITS), np.float32)
    letters = Letters.of(texts) if texts else None
    fragments = _fragments(letters, toxic, TYPICAL) if letters is not None and toxic.any() and not toxic.all() else []
    if not fragments:
        chance = (toxic.sum() + 1) / (len(toxic) + 2)
        return Machine(table, 1.0, float(np.log(chance / (1 - chance))))
    # Other landmarks: runs of six letters at even distances, most of which are of clean texts.
    places = np.linspace(0, max(0, len(letters.kind) - REACH), OTHERS).astype(np.int64)
    landmarks = fragments + [tuple(letters.kind[p : p + REACH].tolist()) for p in places if len(letters.kind) >= p + REACH]
    weights = [_weights(f) for f in landmarks]
    features = sorted({k for w in weights for k in w})
    place = np.full(len(table), -1, np.int32)
    place[features] = np.arange(len(features))
    phi = np.zeros((len(landmarks), len(features)))
    for row, w in zip(phi, weights):
        row[place[list(w)]] = list(w.values())
    values, vectors = np.linalg.eigh(phi @ phi.T)
    known = values > 1e-6 * values.max()
    project = phi.T @ (vectors[:, known] / np.sqrt(values[known]))  # features -> whitened kernel values

    where, which, weight = [], [], []
    for far, number, w in letters.sequences():
        hit = np.flatnonzero((place[number] >= 0) & (w > 1e-4))
        where.append((hit + far).astype(np.int32)), which.append(place[number[hit]]), weight.append(w[hit])
    order = np.argsort(np.concatenate(where), kind="stable")
    where, which, weight = (np.concatenate(x)[order] for x in (where, which, weight))
    last = np.r_[letters.starts[1:], len(letters.kind)]

    def mapped(at: np.ndarray) -> np.ndarray:
        """The windows that end at these letters, as the machine sees them; a thousand at a time, for bounded memory."""
        out = np.zeros((len(at), project.shape[1]))
        for i in range(0, len(at), 1000):
            some = at[i : i + 1000]
            begin, end = np.searchsorted(where, some - WINDOW + 1), np.searchsorted(where, some, "right")
            row = np.repeat(np.arange(len(some)), end - begin)
            item = np.arange(len(row)) - np.repeat(np.cumsum(end - begin) - (end - begin), end - begin) + np.repeat(begin, end - begin)
            flat = np.bincount(row * len(features) + which[item], weight[item], len(some) * len(features))
            out[i : i + 1000] = flat.reshape(len(some), -1) @ project
        return out

    # A fifth, by place, is kept for the chances.
    learns = np.arange(len(texts)) % 5 != 0
    if not (learns & toxic).any() or not (learns & ~toxic).any():
        learns[:] = True
    table[features] = phi[: len(fragments)].sum(axis=0)
    examples, shift = np.zeros(0, np.int64), -FOUND
    explained = np.zeros(len(texts), bool)
    for _ in range(ROUNDS):
        scores = window_scores(letters, table)
        # Toxic texts in which nothing is found yet teach nothing; labels may be wrong, too.
        explained |= best_windows(scores, letters.starts) + shift > 0
        positive, hard = [], []
        for k in np.flatnonzero(learns & (last > letters.starts)):
            mine = scores[letters.starts[k] : last[k]]
            if toxic[k] and not explained[k]:
                continue
            if toxic[k]:
                positive.append(letters.starts[k] + int(mine.argmax()))
            else:
                top = np.argpartition(-mine, min(HARD, len(mine)) - 1)[:HARD]
                hard.append(letters.starts[k] + top)
        examples = np.union1d(examples, np.concatenate(hard)) if hard else examples
        if not positive or not len(examples):
            break
        at = np.r_[np.array(positive, np.int64), examples]
        y = np.r_[np.ones(len(positive)), -np.ones(len(examples))]
        w, shift = _machine(mapped(at), y)
        table[features] = project @ w
    best = best_windows(window_scores(letters, table), letters.starts)
    judged = ~learns if (~learns & toxic).sum() >= 8 and (~learns & ~toxic).sum() >= 8 else np.ones(len(texts), bool)
    # Each toxic text counts a second time as if its insult were pulled apart, which leaves it so much of its score.
    x = np.r_[best[judged], APART * best[judged & toxic]].astype(np.float64)
    return Machine(table, *_logistic(x, np.r_[toxic[judged], np.ones((judged & toxic).sum())].astype(np.float64)))


def held_out(doc_id: Column) -> Column:
    return part(doc_id, 4) == 2


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic, order: the bounded sample to learn from, of each label the documents whose ids hash lowest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).withColumn("order", F.xxhash64("doc_id"))
    some = lambda label, n: known.where(F.col("toxic") == label).orderBy("order", "doc_id").limit(n)
    chosen = some(1, LEARN_TOXIC).unionByName(some(0, LEARN_CLEAN))
    # At most LEARN_TOXIC + LEARN_CLEAN rows, so the broadcast has a bound.
    texts = docs.select("doc_id", "text").where(F.char_length("text") <= LEARN_LONGEST).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic", "order").agg(F.min("text").alias("text")).select("text", "toxic", "order", "doc_id")


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine of the sample, fitted in one task: the driver sees its table of weights only."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, toxic, size = [], [], 0
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                size += len(text)
                if size <= LEARN_CHARS:
                    texts.append(text)
                    toxic.append(label)
        machine = fit(texts, toxic)
        used = np.flatnonzero(machine.table)
        one = lambda x, t: pa.array([x], pa.list_(t))
        yield pa.RecordBatch.from_arrays([one(used, pa.int32()), one(machine.table[used], pa.float32()), pa.array([machine.slope]), pa.array([machine.shift])], ["used", "weights", "slope", "shift"])

    rows = sample(docs, labels).repartition(1).sortWithinPartitions("order", "doc_id").mapInArrow(each, "used array<int>, weights array<float>, slope double, shift double").collect()
    if not rows:
        return fit([], [])
    table = np.zeros(1 << (LENGTH * BITS), np.float32)
    table[rows[0]["used"]] = rows[0]["weights"]
    return Machine(table, rows[0]["slope"], rows[0]["shift"])


def predict(docs: DataFrame, machine: Machine) -> DataFrame:
    """docs -> its columns and score. Only text is looked at; whole texts, those beyond AT_ONCE in overlapping pieces."""
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = sent.value.score([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores.astype(np.float64))], [*names, "score"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    return docs.mapInArrow(each, ", ".join([*fields, "score double"]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """documents and labels (doc_id, toxic) -> documents' columns and held_out, score (0 to 1), predicted (score >= THRESHOLD).

    Learned from labelled documents that aren't held out: LEARN_TOXIC and LEARN_CLEAN at most, of LEARN_LONGEST characters at
    most. A document labelled both ways is toxic; labels other than 0 and 1, and null ids or texts, aren't learned from; of
    rows of one id the text that sorts first is. A null doc_id counts as empty text when documents are held out. A null or
    empty text scores as one without any fragment of an insult. Equal texts score alike, repeated rows too. Very long texts
    are scored whole. Without labels of both kinds all texts get the same score. An empty table gives no rows. Columns of the
    names above are replaced, others stay.
    """
    out = predict(docs.drop("held_out", "predicted"), learn(docs, labels))
    return out.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
