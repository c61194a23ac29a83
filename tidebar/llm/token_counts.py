"""Edit-aware token counts: a segment tree over each document's pre-tokens, updated where edits touch it.

Byte-level BPE merges never cross a pre-token, so a text's count is the sum over its pre-tokens. A tree keeps, for blocks
of pre-tokens, their characters and tokens, and the sums of these upwards. An edit is re-encoded from the last pre-token
end that the change cannot have moved until a pre-token start meets an old one again; then the touched blocks are
replaced and the sums above them updated.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of the byte-level BPE vocabularies; a fixed value that must equal the one they were made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a pre-token's end that its match may have looked at, and one more.
CONTEXT = 3
BLOCK = 32
#: Counts of pre-tokens that a task remembers at most.
REMEMBERED = 1 << 19
#: Documents whose trees a task holds at once.
ROWS = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class Counter:
    """Pre-token splits and token counts by one vocabulary (the bytes of a rank file)."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        import regex
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.split = regex.compile(pattern)
        self.encode = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        try:
            return [known[p] for p in pieces]
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in pieces:
            n = known.get(p)
            if n is None:
                n = len(self.encode(p))
                if len(p) < 64:
                    known[p] = n
            out.append(n)
        return out


@lru_cache(2)
def counter(ranks: bytes, pattern: str) -> Counter:
    return Counter(ranks, pattern)


class Tree:
    """Blocks of (lengths, counts) of pre-tokens under binary sums of characters and tokens."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.blocks = [[lengths[i : i + BLOCK], counts[i : i + BLOCK]] for i in range(0, max(1, len(lengths)), BLOCK)]
        self.leaves = 1 << (len(self.blocks) - 1).bit_length()
        self.chars = [0] * (2 * self.leaves)
        self.tokens = [0] * (2 * self.leaves)
        for i, (a, b) in enumerate(self.blocks):
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(a), sum(b)
        for i in range(self.leaves - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def block_at(self, offset: int) -> tuple[int, int]:
        """The block with the character at offset (the last one beyond the end), and its first character."""
        i, before = 1, 0
        while i < self.leaves:
            i *= 2
            if offset - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return min(i - self.leaves, len(self.blocks) - 1), before

    def update(self, first: int, last: int, lengths: list[int], counts: list[int]) -> None:
        """Blocks first to last become these pre-tokens, shared out among them; then the sums above them."""
        each = -(-len(lengths) // (last - first + 1))
        for n, i in enumerate(range(first, last + 1)):
            a, b = lengths[n * each : (n + 1) * each], counts[n * each : (n + 1) * each]
            self.blocks[i] = [a, b]
            self.chars[self.leaves + i], self.tokens[self.leaves + i] = sum(a), sum(b)
        low, high = (self.leaves + first) // 2, (self.leaves + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2

    def flat(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.blocks for x in a], [x for _, b in self.blocks for x in b]


def build(text: str, with_: Counter) -> Tree:
    pieces = with_.split.findall(text)
    return Tree(list(map(len, pieces)), with_.counts(pieces))


def apply(tree: Tree, text: str, start: int, end: int, new: str, with_: Counter) -> tuple[str, int]:
    """text[start:end] becomes new, the tree follows; -> the new text, and how many characters were encoded again."""
    start = max(0, min(start, len(text)))
    end = max(start, min(end, len(text)))
    edited, shift = text[:start] + new + text[end:], len(new) - (end - start)
    first, at = tree.block_at(max(0, start - CONTEXT))
    # From the last end in this block that the edit can't have moved, or the block's start, if that is far enough away.
    while first and at > start - CONTEXT:
        first -= 1
        at -= tree.chars[tree.leaves + first]
    lengths, counts = [], []
    for a, b in zip(*tree.blocks[first]):
        if at + a > start - CONTEXT:
            break
        lengths.append(a)
        counts.append(b)
        at += a
    resume = at
    last, old = first, resume  # old: the start of the next old pre-token; rest: those of the last block that follow
    rest = list(zip(*tree.blocks[first]))[len(lengths) :]
    pieces, upto = [], resume

    def old_start(position: int) -> bool:
        """Moves on to the first old pre-token that starts at or after position."""
        nonlocal last, old, rest
        while old < position:
            if not rest:
                if last + 1 >= len(tree.blocks):
                    return False
                last += 1
                rest = list(zip(*tree.blocks[last]))
                continue
            old += rest[0][0]
            rest = rest[1:]
        return old == position

    past = start + len(new)
    for m in with_.split.finditer(edited, resume):
        if m.start() >= past and old_start(m.start() - shift):
            break
        pieces.append(m.group())
        upto = m.end()
    else:
        old_start(len(text))
        rest = []
    lengths += [*map(len, pieces), *(a for a, _ in rest)]
    counts += [*with_.counts(pieces), *(b for _, b in rest)]
    tree.update(first, last, lengths, counts)
    if len(lengths) > 8 * BLOCK * (last - first + 1):  # a block has outgrown the others
        tree.__init__(*tree.flat())
    return edited, upto - resume


def again(tree: dict | None, text: str) -> Tree | None:
    """The kept tree of a text; None if there is none or its characters aren't as many as the text's."""
    if tree is None or tree["lengths"] is None or tree["counts"] is None or sum(tree["lengths"]) != len(text):
        return None
    return Tree(tree["lengths"], tree["counts"])


def count_edits(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, tree: str | None = None) -> DataFrame:
    """docs with text and edits, array<struct<start int, end int, new string>>, applied in turn (code points of the text as
    the edits before left it; ends are cut to its length) -> their columns and

    n_tokens, n_tokens_edited, n_encoded (characters that were encoded to build the tree: all, or 0 where it was kept),
    n_encoded_again (characters of the edits and their context that were encoded once more), edited (the text after all
    edits) and tree (lengths and token counts of the edited text's pre-tokens, for later edits).

    `tree` names the column of the trees that an earlier call returned for these texts: then only the edits are encoded.
    A tree that is null or of another length than its text is built anew.

    Null text, null edits and null parts of an edit count as empty (0 for places); edits at one place apply in their
    order. A very long text is held whole by its task, edits in it still encode their surroundings only. Repeated rows are
    counted alike. The driver reads the vocabulary, whose size is fixed, and sends it to the tasks. An empty table gives no
    rows. Columns of the names above are replaced, others stay.
    """
    new = ["n_tokens", "n_tokens_edited", "n_encoded", "n_encoded_again", "edited", "tree"]
    if tree is not None:
        docs = docs.withColumn("__tree", F.col(f"`{tree}`").cast("struct<lengths: array<int>, counts: array<int>>"))
    docs = docs.drop(*new)
    names = docs.columns
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_ = counter(sent.value, pattern)
        for b in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            rows: list[list] = [[] for _ in new]
            trees = b.column("__tree").to_pylist() if tree is not None else [None] * b.num_rows
            for text, edits, old in zip(b.column("text").to_pylist(), b.column("edits").to_pylist(), trees):
                text = text or ""
                known = again(old, text)
                encoded = 0 if known else len(text)
                now = known or build(text, with_)
                before, more = now.n_tokens, 0
                for e in edits or []:
                    if e is not None:
                        text, n = apply(now, text, e["start"] or 0, e["end"] or 0, e["new"] or "", with_)
                        more += n
                lengths, counts = now.flat()
                for row, x in zip(rows, (before, now.n_tokens, encoded, more, text, {"lengths": lengths, "counts": counts})):
                    row.append(x)
            kinds = [*[pa.int64()] * 4, pa.string(), pa.struct([("lengths", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, k) for x, k in zip(rows, kinds))], [*names, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    more = "n_tokens long, n_tokens_edited long, n_encoded long, n_encoded_again long, edited string, tree struct<lengths: array<int>, counts: array<int>>"
    return docs.mapInArrow(each, ", ".join([*fields, more])).drop("__tree")
