"""Language-model scores by deleted interpolation.

A bigram model: the maximum-likelihood estimates of bigram and unigram and a uniform floor are mixed with weights that
depend on how often the context was seen; the weights of each bucket of context frequency are learned by
expectation-maximisation on held-out counts, that is on training documents whose own counts are left out meanwhile.

Counts are looked up by exchange. Documents are packed into blocks of some megabytes. Each block sends every n-gram that it
has once, with its own counts, to the n-gram's bucket; the bucket adds up and answers each block with the totals in the
order of the request. So a frequent n-gram comes once a block, not once a token, no table of n-grams is ever sent to all
tasks, and requests (sorted 64-bit hashes, as differences) take some 6 bytes an n-gram.

A block has at most 2**FAN_BITS requests for each order. Where more buckets are needed than that (from some 32 GB), a
bucket's requests are merged for so many blocks into one, which is then dealt to finer buckets as a block's would be, and
its answer is handed down. So the number of requests is in proportion to the input, and what a task holds has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.llm.common import kept, part

#: Bytes of text in a block, and of all text for each bucket of n-grams.
BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20
#: Buckets that a block's n-grams are dealt to at most, as bits, and blocks whose requests are merged then.
FAN_BITS = 11
#: One of so many training documents is held out for the weights.
HELD = 10
ROUNDS = 50
#: Roles of documents: counted, held out for the weights and then counted, only scored.
COUNTED, WEIGHING, SCORED = 0, 1, 2
#: Steps of likelihoods in the table that the weights are learned from: a quarter of a doubling, down to 2**-48.
STEP, DEEPEST = 4, 48
END = b"\n"


def role(doc_id: Column) -> Column:
    weighing = F.pmod(F.xxhash64(doc_id, F.lit("weights")), F.lit(HELD)) == 0
    return F.when(part(doc_id) == 1, SCORED).when(weighing, WEIGHING).otherwise(COUNTED)


def pack(docs: DataFrame) -> DataFrame:
    """(doc_id, role, text) -> (block, weighing, n_bytes, data): blocks of documents, written once to the shared folder.

    Held-out documents have blocks of their own, so that learning the weights reads no others; their numbers are
    odd.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        open_: dict[bool, list] = {False: [], True: []}
        size = {False: 0, True: 0}

        def flush(weighing: bool) -> pa.RecordBatch:
            nonlocal made
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(open_[weighing])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            made += 1
            row = [[base + 2 * made + weighing], [weighing], [size[weighing]], [sink.getvalue().to_pybytes()]]
            open_[weighing], size[weighing] = [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.bool_(), pa.int64(), pa.binary()))], ["block", "weighing", "n_bytes", "data"])

        for b in batches:
            roles = b.column("role").to_pylist()
            lengths = [x or 0 for x in pc.binary_length(b.column("text")).to_pylist()]
            for weighing in (False, True):
                rows = [i for i, r in enumerate(roles) if (r == WEIGHING) == weighing]
                at = 0
                while at < len(rows):
                    upto = at
                    while upto < len(rows) and size[weighing] < BLOCK_BYTES:
                        size[weighing] += lengths[rows[upto]]
                        upto += 1
                    open_[weighing].append(b.take(pa.array(rows[at:upto], pa.int32())))
                    at = upto
                    if size[weighing] >= BLOCK_BYTES:
                        yield flush(weighing)
        for weighing in (False, True):
            if open_[weighing]:
                yield flush(weighing)

    return kept(docs.select("doc_id", "role", "text").mapInArrow(each, "block long, weighing boolean, n_bytes long, data binary"), f"blocks-{kind}")


class Block:
    """A block's documents as n-grams: per order the distinct keys in order, and each token's place among them."""

    def __init__(self, data: bytes):
        import numpy as np
        import xxhash

        table = pa.ipc.open_stream(pa.py_buffer(data)).read_all().combine_chunks()
        self.doc_id = table.column("doc_id")
        self.role = np.array(table.column("role").to_pylist(), np.int32)
        digest, end = xxhash.xxh64_intdigest, xxhash.xxh64_intdigest(END)
        hashes, sizes = [], []
        for text in table.column("text"):
            words = (text.as_py() or "").encode().lower().split()
            hashes.append(np.array([*map(digest, words), end], np.uint64))
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes)
        tokens = np.concatenate(hashes)
        self.doc_of = np.repeat(np.arange(len(sizes)), self.sizes)
        # The end of the document before, which is the end token, is the context of a first word.
        context = np.concatenate([[np.uint64(end)], tokens[:-1]])
        pairs = context * np.uint64(0x9E3779B97F4A7C15) + tokens
        pairs ^= pairs >> np.uint64(32)
        pairs *= np.uint64(0xD6E8FEB86659FD93)
        pairs ^= pairs >> np.uint64(32)
        self.keys, self.at = {}, {}
        self.keys[1], self.at[1] = np.unique(tokens, return_inverse=True)
        self.keys[2], self.at[2] = np.unique(pairs, return_inverse=True)
        ends = np.searchsorted(self.keys[1], np.uint64(end))
        self.context_at = np.concatenate([[ends], self.at[1][:-1]])

    def counts(self, order: int):
        """Own counts of each key, in counted and in held-out documents."""
        import numpy as np

        role = self.role[self.doc_of]
        return [np.bincount(self.at[order][role == r], minlength=len(self.keys[order])) for r in (COUNTED, WEIGHING)]


def _planes(x) -> bytes:
    """Numbers as bytes, first all lowest ones and so on, compressed."""
    import numpy as np

    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _numbers(data: bytes, n: int):
    import numpy as np

    raw = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, n).T).view("<u8").reshape(n)


REQUEST = "gram int, bucket int, block long, n int, keys binary, counted binary, weighing binary"


NAMES = [x.split()[0] for x in REQUEST.split(", ")]
KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())


def _dealt(order: int, block: int, keys, counts: list, bits: int, below: int) -> pa.RecordBatch:
    """Sorted keys and their counts as requests, one for each value of the `bits` of the key that follow the first `below`."""
    import numpy as np

    shift = 64 - below - bits
    part = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    finer, at = np.unique(part, return_index=True)
    rows = [(order, int(i), block, int(v - u), _planes(np.diff(keys[u:v], prepend=np.uint64(0))), *(_planes(x[u:v]) for x in counts)) for i, u, v in zip(finer, at, [*at[1:], len(keys)])]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(KINDS), KINDS)], NAMES)


def requests(blocks: DataFrame, bits: int) -> DataFrame:
    """Those of each block, to 2**bits buckets: the first bits of the keys."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                one = Block(data.as_buffer())
                for order in (1, 2):
                    yield _dealt(order, block, one.keys[order], one.counts(order), bits, 0)

    return blocks.select("block", "data").mapInArrow(each, REQUEST)


ANSWER = "gram int, bucket int, block long, n int, counted binary, weighing binary, sizes array<long>"


class Merged:
    """The requests of one bucket: their distinct keys, the sums of their counts, and where each request's keys are."""

    def __init__(self, table: pa.Table):
        import numpy as np

        self.order, self.bucket = table.column("gram")[0].as_py(), table.column("bucket")[0].as_py()
        self.blocks, self.ns = table.column("block").to_pylist(), table.column("n").to_pylist()
        keys = np.concatenate([np.cumsum(_numbers(k.as_py(), n), dtype=np.uint64) for k, n in zip(table.column("keys"), self.ns)])
        self.keys, self.at = np.unique(keys, return_inverse=True)
        self.sums = []
        for name in ("counted", "weighing"):
            own = np.concatenate([_numbers(x.as_py(), n) for x, n in zip(table.column(name), self.ns)])
            self.sums.append(np.bincount(self.at, weights=own, minlength=len(self.keys)).astype(np.uint64))

    def answers(self, totals: list, sizes: list[int] | None = None) -> pa.Table:
        """totals (counted, weighing) of the distinct keys -> a row for each request; with sizes one more, of block -1."""
        import numpy as np

        edges = np.cumsum([0, *self.ns])
        out = [[_planes(t[self.at[u:v]]) for u, v in zip(edges, edges[1:])] for t in totals]
        n, more = len(self.ns), [] if sizes is None else [None]
        columns = [pa.array([self.order] * (n + len(more)), pa.int32()), pa.array([self.bucket] * (n + len(more)), pa.int32()), pa.array([*self.blocks, *([-1] * len(more))], pa.int64()), pa.array([*self.ns, *([0] * len(more))], pa.int32())]
        columns += [pa.array([*x, *([b""] * len(more))], pa.binary()) for x in out]
        columns.append(pa.array([*([None] * n), *([sizes] * len(more))], pa.list_(pa.int64())))
        return pa.Table.from_arrays(columns, [x.split()[0] for x in ANSWER.split(", ")])


def answers(asked: DataFrame, below: int, bits: int, groups: int) -> DataFrame:
    """The totals of each request's keys, in their order; block -1 has the sizes of its bucket's n-grams.

    Requests are for the first `below` bits of the keys; `bits` more are still needed, and `groups` is how many blocks, or
    groups of them, ask.
    """
    if not bits:

        def last(table: pa.Table) -> pa.Table:
            some = Merged(table)
            a, b = some.sums
            return some.answers([a, b], [int(a.sum()), int((a > 0).sum()), int(b.sum()), int((a + b > 0).sum())])

        return kept(asked.groupBy("gram", "bucket").applyInArrow(last, ANSWER), "answers")
    fine, groups = min(bits, FAN_BITS), 1 + (groups - 1 >> FAN_BITS)
    asked = kept(asked.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups))), "requests")

    def merge(table: pa.Table) -> pa.Table:
        some = Merged(table)
        return pa.Table.from_batches([_dealt(some.order, table.column("part")[0].as_py(), some.keys, some.sums, fine, below)])

    merged = asked.groupBy("gram", "bucket", "part").applyInArrow(merge, REQUEST)
    found = answers(merged, below + fine, bits - fine, groups)

    def hand_down(table: pa.Table, answer: pa.Table) -> pa.Table:
        import numpy as np

        some = Merged(table)
        order = np.argsort(answer.column("bucket").to_numpy()).tolist()
        ns = answer.column("n").to_pylist()
        return some.answers([np.concatenate([_numbers(answer.column(x)[i].as_py(), ns[i]) for i in order]) for x in ("counted", "weighing")])

    back = found.where("block != -1").drop("sizes").withColumn("coarse", F.shiftright("bucket", fine))
    down = asked.groupBy("gram", "bucket", "part").cogroup(back.groupBy("gram", "coarse", "block")).applyInArrow(hand_down, ANSWER)
    return kept(down.unionByName(found.where("block = -1")), "answers")


class Likelihoods:
    """Of each token of a block: context count, and the estimates of bigram and unigram."""

    def __init__(self, one: Block, answer: pa.Table, total: int, all_counts: bool):
        import numpy as np

        rows = sorted(zip(answer.column("gram").to_pylist(), answer.column("bucket").to_pylist(), range(answer.num_rows)))
        count = {}
        for order in (1, 2):
            some = [i for o, _, i in rows if o == order]
            names = ("counted", "weighing") if all_counts else ("counted",)
            count[order] = np.concatenate([sum(_numbers(answer.column(x)[i].as_py(), answer.column("n")[i].as_py()) for x in names) for i in some]).astype(np.float64)
        self.count = count[1][one.at[1]]
        self.context = count[1][one.context_at]
        pair = count[2][one.at[2]]
        self.two = np.divide(pair, self.context, out=np.zeros_like(pair), where=self.context > 0)
        self.one = self.count / max(total, 1)
        self.bucket = np.where(self.context > 0, np.floor(np.log2(np.maximum(self.context, 1))) + 1, 0).astype(np.int32)


def weights(cells, floor: float):
    """EM over (bucket, n, p2, p1) cells: a row of mixture weights (bigram, unigram, uniform) for each bucket.

    One more event for each part keeps every weight above zero; the bucket of unseen contexts has no bigram part. A bucket
    without held-out counts has equal weights.
    """
    import numpy as np

    out = np.full((64, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)
    cells = np.asarray(cells, np.float64).reshape(-1, 4)
    for bucket in np.unique(cells[:, 0]).astype(int).tolist():
        rows = cells[cells[:, 0] == bucket, 1:]
        n, p = rows[:, 0], np.column_stack([rows[:, 1], rows[:, 2], np.full(len(rows), floor)])
        w = out[bucket]
        for _ in range(ROUNDS):
            r = p * w
            r /= r.sum(axis=1, keepdims=True)
            w = (r * n[:, None]).sum(axis=0) + (w > 0)
            w = w / w.sum()
        out[bucket] = w
    return out


def _with_answers(blocks: DataFrame, answered: DataFrame, each, schema: str) -> DataFrame:
    return blocks.select("block", "data").groupBy("block").cogroup(answered.drop("sizes").groupBy("block")).applyInArrow(each, schema)


def score(docs: DataFrame) -> DataFrame:
    """documents -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learned from the documents whose crc32(doc_id as text) modulo 5 is not 1. A null text is empty (its one token is the
    end), a null doc_id counts as empty text (crc32 0, learned from); repeated rows count as often as they are there, and
    score alike. A very long text is a block of its own, scored whole. Nothing is ranked, so there are no ties. An empty table gives
    no rows; other columns are not looked at. With nothing to learn from only the floors are left.
    """
    import numpy as np

    docs = docs.select("doc_id", role(F.col("doc_id")).alias("role"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    blocks = pack(docs)
    n_blocks, size = blocks.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    bits = int(size // BUCKET_BYTES).bit_length()
    first = min(bits, FAN_BITS)
    answered = answers(requests(blocks, first), first, bits - first, n_blocks)
    sizes = answered.where("block = -1 and gram = 1").agg(*(F.sum(F.col("sizes")[i]) for i in range(4))).first()
    counted, types, weighing, all_types = (int(x or 0) for x in sizes)
    answered = answered.where("block != -1")

    def cells(pack_: pa.Table, answer: pa.Table) -> pa.Table:
        import numpy as np

        one = Block(pack_.column("data")[0].as_buffer())
        p = Likelihoods(one, answer, counted, all_counts=False)
        step = lambda x: np.where(x > 0, 1 + np.clip(-np.log2(np.maximum(x, 1e-300)) * STEP, 0, STEP * DEEPEST).astype(np.int64), 0)
        cell, at = np.unique((p.bucket.astype(np.int64) * 1024 + step(p.two)) * 1024 + step(p.one), return_inverse=True)
        columns = [pa.array(cell), pa.array(np.bincount(at)), pa.array(np.bincount(at, weights=p.two)), pa.array(np.bincount(at, weights=p.one))]
        return pa.Table.from_arrays(columns, ["cell", "n", "p2", "p1"])

    # The table of cells is bounded by the steps, whatever the input.
    found = _with_answers(blocks.where("weighing"), answered.where("block % 2 = 1"), cells, "cell long, n long, p2 double, p1 double")
    rows = found.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1")).orderBy("cell").toArrow()
    cell, n, p2, p1 = (rows.column(x).to_numpy() for x in ("cell", "n", "p2", "p1"))
    mixed = weights(np.column_stack([cell >> 20, n, p2 / n, p1 / n]), 1 / (types + 1))
    total = counted + weighing

    def scores(pack_: pa.Table, answer: pa.Table) -> pa.Table:
        import numpy as np

        one = Block(pack_.column("data")[0].as_buffer())
        p = Likelihoods(one, answer, total, all_counts=True)
        w = mixed[p.bucket]
        model = np.log10(w[:, 0] * p.two + w[:, 1] * p.one + w[:, 2] / (all_types + 1))
        base = np.log10((p.count + 0.5) / (total + 0.5 * (all_types + 1)))
        first = np.cumsum(one.sizes) - one.sizes
        columns = [one.doc_id, pa.array(one.role == SCORED), pa.array(one.sizes.astype(np.int64)), pa.array(np.add.reduceat((p.count > 0).astype(np.int64), first)), pa.array(np.full(len(one.sizes), total, np.int64)), pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(model, first))]
        return pa.Table.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return _with_answers(blocks, answered, scores, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
