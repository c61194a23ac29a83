"""Alignment of two tokenizers over the same texts: where both end a token, which tokens overlap, how usual each link is.

Every token gives an end event (its end in bytes). The events of both tokenizers are put together, dealt out by document and
sorted by offset within partitions; one pass over the sorted events keeps the open token of each side and the open group,
and emits a group where both sides end, and a link for each stretch between two ends: there one token of each side lies, and
no other stretch has this pair of tokens. Events travel in rows of so many bytes of text, ids only: their lengths
follow from the vocabularies.

How many documents hold a pair of ids linked is counted over packs of documents: a pack tells each pair that it has once, with
the number of its documents, and is told the corpus's number; so what is exchanged is pairs a pack, not links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidebar.llm.common import kept
from tidebar.llm.token_counts import PATTERN

VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text whose ends are in one row of events.
SPAN = 1 << 16
#: Tokens of a side that are aligned at once, and distinct pairs of documents in a pack, each about.
AT_ONCE, PACK = 1 << 19, 1 << 19
#: Encoded words that a task remembers at most, and their length.
REMEMBERED, LONGEST = 1 << 18, 64
META = "▁"
#: Neither tokenizer has a token across a single space between two other characters, so words are encoded one by one.
WORDS = re.compile(rf"(?<=[^\s{META}]) (?=[^\s{META}])")


def _byte_of() -> dict[str, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, others as characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """One tokenizer: ids of texts as 16-bit numbers, and the bytes of its tokens by id."""

    token_bytes: list[bytes]

    def __init__(self) -> None:
        self.known: dict[str, bytes | None] = {}
        self.splits = True

    def encode_words(self, words: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, words: set[str]) -> None:
        new = list(words)
        for word, ids in zip(new, self.encode_words(new)):
            same = b"".join([self.token_bytes[i] for i in ids]) == b" " + word.encode()
            self.known[word] = np.array(ids, np.uint16).tobytes() if same else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """The ids of space + text; None where their bytes are others."""
        parts = [WORDS.split(t) if self.splits else [t] for t in texts]
        known = self.known
        new = {w for p in parts for w in p if w not in known}
        self.learn(new)
        out: list[bytes | None] = []
        for p in parts:
            ids = [known[w] for w in p]
            out.append(None if None in ids else b"".join(ids))
        for w in new:
            if len(w) >= LONGEST:
                del known[w]
        if len(known) > REMEMBERED:
            known.clear()
        return out


class ByteSide(Side):
    """Byte-level BPE, from the JSON file of its vocabulary. Strings of special tokens are plain text."""

    def __init__(self, data: bytes):
        import tiktoken

        super().__init__()
        given = json.loads(data)
        special = {x["id"] for x in given["added_tokens"] if x["special"]}
        byte_of = _byte_of()
        ranks = {bytes(byte_of[c] for c in token): i for token, i in given["model"]["vocab"].items() if i not in special}
        self.token_bytes = [b""] * (max(given["model"]["vocab"].values()) + 1)
        for token, i in ranks.items():
            self.token_bytes[i] = token
        self._encode = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return [self._encode(" " + w) for w in words]


class PieceSide(Side):
    """SentencePiece, which puts the space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        super().__init__()
        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(n)]
        self.token_bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(META, " ").encode() for i, p in enumerate(names)]
        self.splits = not any(re.search(rf"[^{META}]{META}", p) for p in names)

    def encode_words(self, words: list[str]) -> list[list[int]]:
        return self.model.encode(words, num_threads=1) if words else []


def _lengths(side: Side) -> np.ndarray:
    return np.array([len(t) for t in side.token_bytes], np.int64)


def _ids(packed: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(packed), np.uint16)


def events(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> tuple[DataFrame, object]:
    """(doc_id, text) -> row, doc_id, span, side (0: A, 1: B), ids: the end events of so many bytes of a text; and the vocabularies.

    A document has a row of side A at least. Where the bytes of a side are others than space + text, a row of span -1 says so.
    """
    blobs = tuple(open(p, "rb").read() for p in (vocabulary_a, vocabulary_b))
    sent = docs.sparkSession.sparkContext.broadcast(blobs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sides = (ByteSide(sent.value[0]), PieceSide(sent.value[1]))
        lengths = [_lengths(s) for s in sides]
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and size < 1 << 22:
                    size += len(texts[upto]) + 64
                    upto += 1
                found = [s.encode(texts[at:upto]) for s in sides]
                of, span, side, data = [], [], [], []
                for k in range(upto - at):
                    if found[0][k] is None or found[1][k] is None or not texts[at + k]:
                        of.append(at + k), span.append(-1), side.append(0), data.append(pack(b""))
                        continue
                    for j in (0, 1):
                        ids = np.frombuffer(found[j][k], np.uint16)
                        if len(texts[at + k]) * 4 < SPAN:
                            of.append(at + k), span.append(0), side.append(j), data.append(pack(found[j][k]))
                            continue
                        spans = (np.cumsum(lengths[j][ids]) - 1) // SPAN
                        cuts = np.flatnonzero(np.diff(spans)) + 1
                        for part, s in zip(np.split(ids, cuts), spans[np.r_[0, cuts]]):
                            of.append(at + k), span.append(int(s)), side.append(j), data.append(pack(part.tobytes()))
                rows = pa.array(of, pa.int64())
                columns = [b.column("row").take(rows), b.column("doc_id").take(rows), pa.array(span, pa.int32()), pa.array(side, pa.int32()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "span", "side", "ids"])
                at = upto

    # A document is told by its place in the table, so that repeated rows and null ids stay apart.
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(each, f"row long, doc_id {kind}, span int, side int, ids binary"), sent


class Aligned:
    """Documents in a row, aligned: tokens, links (one for each stretch between ends) and groups, of all of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, lengths: list[np.ndarray], open_from: int):
        """open_from: the byte at which the last document begins if more of it is to come, else -1; of it only whole groups are taken."""
        self.a, self.b = a, b
        ends = [np.cumsum(n[x]) for n, x in zip(lengths, (a, b))]
        mark = np.zeros(max([0, *(e[-1] + 1 for e in ends if len(e))]), np.uint8)
        mark[ends[0]] = 1
        mark[ends[1]] += 2
        self.upto = len(mark) - 1
        if open_from >= 0:
            both = np.flatnonzero(mark[open_from + 1 :] == 3)
            self.upto = open_from + 1 + int(both[-1]) if len(both) else open_from
            mark = mark[: self.upto + 1]
        self.end = np.flatnonzero(mark)
        kind = mark[self.end]
        ends_a, ends_b, both = (kind & 1) == 1, kind >= 2, kind == 3
        before = lambda x: np.cumsum(x) - x
        self.at_a, self.at_b, self.group = before(ends_a), before(ends_b), before(both)
        self.common = self.end[both]
        self.groups_a, self.groups_b = self.group[ends_a], self.group[ends_b]
        self.upto_a, self.upto_b = self.at_a[both] + 1, self.at_b[both] + 1
        self.n_a, self.n_b = int(ends_a.sum()), int(ends_b.sum())

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        return self.a[self.at_a], self.b[self.at_b]

    def written(self, table: np.ndarray) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;...` of all groups with a mark after each token, and where each group ends. table: texts by mark and id."""
        i, j = np.arange(self.n_a), np.arange(self.n_b)
        earlier = np.r_[0, self.upto_b]
        place_a, place_b = i + earlier[self.groups_a], j + self.upto_a[self.groups_b]
        code = np.empty(self.n_a + self.n_b, np.int64)
        code[place_a] = self.a[: self.n_a] + (np.where(i == self.upto_a[self.groups_a] - 1, 1, 0) << 16)
        code[place_b] = self.b[: self.n_b] + (np.where(j == self.upto_b[self.groups_b] - 1, 2, 0) << 16)
        digits = 2 + sum((code & 0xFFFF) >= 10**k for k in range(1, 5))
        return b"".join(table[code].tolist()), np.r_[0, np.cumsum(digits)][self.upto_a + self.upto_b]


def _table() -> np.ndarray:
    out = np.empty(3 << 16, object)
    for k, mark in enumerate(",|;"):
        out[k << 16 : (k + 1) << 16] = [f"{i}{mark}".encode() for i in range(1 << 16)]
    return out


class Doc:
    """A document while its events stream by."""

    def __init__(self, row: int, doc_id: object):
        self.row, self.doc_id = row, doc_id
        self.ids: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        self.tokens, self.none, self.base = 0, False, 0
        self.n = np.zeros(4, np.int64)  # tokens of A, of B, groups, links
        self.digest = None
        self.pairs, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, span: int, side: int, ids: bytes) -> None:
        if span < 0:
            self.none = True
        else:
            self.ids[side].append(_ids(ids))
            self.tokens += len(self.ids[side][-1])

    def add_pairs(self, pairs: np.ndarray, times: np.ndarray) -> None:
        if not len(self.pairs):
            self.pairs, self.times = pairs, times
            return
        every, at = np.unique(np.r_[self.pairs, pairs], return_inverse=True)
        self.times = np.bincount(at, np.r_[self.times, times], len(every)).astype(np.int64)
        self.pairs = every

    def hashed(self, text: memoryview) -> None:
        """Marks of groups are between them, so the last one waits."""
        if not len(text):
            return
        if self.digest is None:
            self.digest = hashlib.sha256()
        else:
            self.digest.update(b";")
        self.digest.update(text[:-1])


def sweep(batches: Iterator[pa.RecordBatch], lengths: list[np.ndarray], at_once: int = AT_ONCE) -> Iterator[tuple[list[Doc], Aligned, np.ndarray, bool]]:
    """Sorted events -> documents in a row, their alignment, where each ends in it (bytes), and whether the last one goes on."""

    def aligned(docs: list[Doc], goes_on: bool) -> tuple[list[Doc], Aligned, np.ndarray, bool]:
        sides = [np.concatenate([np.zeros(0, np.uint16), *(x for d in docs for x in d.ids[j])]).astype(np.int64) for j in (0, 1)]
        sizes = [sum(int(lengths[0][x].sum()) for x in d.ids[0]) for d in docs]
        starts = np.r_[0, np.cumsum(sizes)]
        found = Aligned(*sides, lengths, int(starts[-2]) if goes_on else -1)
        for d in docs:
            d.ids, d.tokens = ([], []), 0
        ends = starts[1:].copy()
        if goes_on:
            ends[-1] = found.upto
            rest = (sides[0][found.n_a :].astype(np.uint16), sides[1][found.n_b :].astype(np.uint16))
            docs[-1].ids, docs[-1].tokens = ([rest[0]], [rest[1]]), 0
        return docs, found, ends, goes_on

    docs: list[Doc] = []
    held = 0
    for b in batches:
        for row, doc_id, span, side, ids in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "span", "side", "ids"))):
            if not docs or docs[-1].row != row:
                if held >= at_once:
                    yield aligned(docs, False)
                    docs, held = [], 0
                docs.append(Doc(row, doc_id))
            elif docs[-1].tokens >= 2 * at_once:
                # A row before a new span may leave A's half of it there; whole groups only are taken, so it waits.
                yield aligned(docs, True)
                docs, held = docs[-1:], 0
            docs[-1].add(span, side, ids)
            held = held + len(ids)
    if docs:
        yield aligned(docs, False)


def _taken(docs: list[Doc], found: Aligned, ends: np.ndarray, table: np.ndarray, width: int) -> None:
    """Adds counts, hashes and pairs of an alignment to its documents."""
    at = np.searchsorted(found.end, ends, "right")
    links, groups = np.diff(np.r_[0, at]), np.diff(np.r_[0, np.searchsorted(found.common, ends, "right")])
    last = np.cumsum(groups)
    upto = lambda x: np.diff(np.r_[0, np.r_[0, x][last]])
    counts = np.stack([upto(found.upto_a), upto(found.upto_b), groups, links], axis=1)
    text, places = found.written(table)
    view, places = memoryview(text), np.r_[0, places]
    a, b = found.links()
    key = (np.repeat(np.arange(len(docs)), links) << 32) | (a * width + b)
    key.sort()
    first = np.flatnonzero(np.diff(key, prepend=-1))
    times, key = np.diff(np.r_[first, len(key)]), key[first]
    cuts = np.searchsorted(key, np.arange(len(docs) + 1) << 32)
    pairs, begin = key & 0xFFFFFFFF, 0
    for k, d in enumerate(docs):
        d.n += counts[k]
        d.add_pairs(pairs[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]])
        d.hashed(view[places[begin] : places[last[k]]])
        begin = last[k]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _packs(dealt: DataFrame, sent: object) -> DataFrame:
    """Sorted events -> packs of documents: their counts and hashes, the pack's pairs with how many of its documents hold each."""
    kind = dealt.schema["doc_id"].dataType.simpleString()
    fields = ["pack long", f"doc_id array<{kind}>", *(f"{c} array<long>" for c in COUNTS), "groups_sha256 array<string>", "pairs array<long>", "holders array<long>", "n_pairs array<int>", "places binary", "times binary"]
    arrow_id = to_arrow_type(dealt.schema["doc_id"].dataType)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        sides = (ByteSide(sent.value[0]), PieceSide(sent.value[1]))
        lengths, width, table = [_lengths(s) for s in sides], len(sides[1].token_bytes), _table()
        compressed = zstandard.ZstdCompressor(level=1).compress
        waiting: list[Doc] = []
        size = 0

        def flushed() -> pa.RecordBatch:
            nonlocal waiting, size
            every, at = np.unique(np.concatenate([d.pairs for d in waiting]), return_inverse=True)
            one = lambda x, t: pa.array([x], pa.list_(t))
            columns = [pa.array([waiting[0].row], pa.int64()), one([d.doc_id for d in waiting], arrow_id), *(one([int(d.n[k]) for d in waiting], pa.int64()) for k in range(4))]
            columns += [one([d.digest.hexdigest() if d.digest else "" for d in waiting], pa.string()), one(every, pa.int64()), one(np.bincount(at, minlength=len(every)), pa.int64())]
            columns += [one([len(d.pairs) for d in waiting], pa.int32()), pa.array([compressed(at.astype(np.int32).tobytes())], pa.binary())]
            columns.append(pa.array([compressed(np.concatenate([d.times for d in waiting]).astype(np.int64).tobytes())], pa.binary()))
            waiting, size = [], 0
            return pa.RecordBatch.from_arrays(columns, [f.split(" ")[0] for f in fields])

        for docs, found, ends, goes_on in sweep(batches, lengths):
            _taken(docs, found, ends, table, width)
            for d in docs[: len(docs) - goes_on]:
                waiting.append(d)
                size += len(d.pairs) + 64
                if size >= PACK:
                    yield flushed()
        if waiting:
            yield flushed()

    return dealt.mapInArrow(each, ", ".join(fields))


def _dealt(docs: DataFrame, vocabulary_a: str, vocabulary_b: str) -> tuple[DataFrame, object]:
    found, sent = events(docs.select("doc_id", "text"), vocabulary_a, vocabulary_b)
    return found.repartition("row").sortWithinPartitions("row", "span", "side"), sent


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """documents -> doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, a row a document.

    A null or empty text, and one whose tokens' bytes are not space + text (by normalization, say), has no tokens: zeros and
    an empty hash. Repeated rows are documents of their own, also in the counts; null ids as well. Ties for an A id's highest
    count are all best. A very long text streams by in spans; what is held of it is its open group (where the two sides
    never end together, that is the whole text's ids) and its distinct pairs. An empty table gives no rows; other columns are not
    returned. docs must give its rows in the same order when read again, as files do: rows are told apart by their place.
    """
    dealt, sent = _dealt(docs, vocabulary_a, vocabulary_b)
    packs = kept(_packs(dealt, sent), "packs")
    width = len(PieceSide(sent.value[1]).token_bytes)
    counts = packs.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.holders").alias("n"))
    # An A id has no more pairs than B has ids.
    best = F.col("n") == F.max("n").over(W.partitionBy(F.expr(f"pair div {width}")))
    asked = packs.select("pack", F.posexplode("pairs").alias("at", "pair")).join(counts.select("pair", "n", best.alias("best")), "pair").select(F.col("pack").alias("by"), "at", "n", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def told(left: pa.Table, right: pa.Table) -> pa.Table:
        import zstandard

        order = np.argsort(right.column("at").to_numpy())
        n, is_best = right.column("n").to_numpy()[order], right.column("best").to_numpy()[order].astype(np.int64)
        row = left.slice(0, 1)
        flat = lambda c: row.column(c).combine_chunks().flatten()
        at = np.frombuffer(zstandard.decompress(row.column("places")[0].as_py()), np.int32)
        times = np.frombuffer(zstandard.decompress(row.column("times")[0].as_py()), np.int64)
        cuts = np.r_[0, np.cumsum(flat("n_pairs").to_numpy())]
        total = lambda x: np.diff(np.r_[0, np.cumsum(x[at] * times)].astype(np.int64)[cuts])
        columns = [flat("doc_id"), *(flat(c) for c in COUNTS), pa.array(total(is_best), pa.int64()), pa.array(total(n), pa.int64()), flat("groups_sha256")]
        return pa.table(columns, names)

    wanted = ["pack", "doc_id", *COUNTS, "groups_sha256", "n_pairs", "places", "times"]
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return packs.select(*wanted).groupBy("pack").cogroup(asked.groupBy("by")).applyInArrow(told, schema)


def groups(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B) -> DataFrame:
    """documents -> doc_id, group (from 0), start, end (bytes of space + text), a_ids, b_ids, links: the groups themselves.

    links is an array of (a, b), places in a_ids and b_ids. Texts without tokens, see align, give no rows.
    """
    dealt, sent = _dealt(docs, vocabulary_a, vocabulary_b)
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow_id = to_arrow_type(docs.schema["doc_id"].dataType)
    names = ["doc_id", "group", "start", "end", "a_ids", "b_ids", "links"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = [_lengths(s) for s in (ByteSide(sent.value[0]), PieceSide(sent.value[1]))]
        for docs, found, ends, goes_on in sweep(batches, lengths):
            last = np.searchsorted(found.common, ends, "right")
            first = np.r_[0, last[:-1]]
            of = np.repeat(np.arange(len(docs)), last - first)
            start, base = np.r_[0, found.common[:-1]], np.r_[0, ends[:-1]]
            shift = np.array([d.base for d in docs], np.int64)[of] - base[of]
            number = np.arange(len(of)) - first[of] + np.array([d.n[2] for d in docs], np.int64)[of]
            cut = lambda x, upto: pa.ListArray.from_arrays(pa.array(np.r_[0, upto], pa.int32()), pa.array(x[: upto[-1] if len(upto) else 0], pa.int32()))
            of_link = np.searchsorted(found.end, found.common, "right")
            from_a, from_b = np.r_[0, found.upto_a][found.group], np.r_[0, found.upto_b][found.group]
            pairs = pa.StructArray.from_arrays([pa.array(found.at_a - from_a, pa.int32()), pa.array(found.at_b - from_b, pa.int32())], ["a", "b"])
            links = pa.ListArray.from_arrays(pa.array(np.r_[0, of_link], pa.int32()), pairs)
            yield pa.RecordBatch.from_arrays([pa.array([docs[k].doc_id for k in of], arrow_id), pa.array(number, pa.int64()), pa.array(start + shift, pa.int64()), pa.array(found.common + shift, pa.int64()), cut(found.a, found.upto_a), cut(found.b, found.upto_b), links], names)
            for k, d in enumerate(docs):
                d.n[2] += last[k] - first[k]
                d.base += int(ends[k] - base[k])

    return dealt.mapInArrow(each, f"doc_id {kind}, group long, start long, end long, a_ids array<int>, b_ids array<int>, links array<struct<a: int, b: int>>")
