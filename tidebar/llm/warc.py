"""A deterministic sharded WARC writer and the reader of its archives.

Records are range-sorted by id and a hash of their payload. The bounds of the ranges are quantiles, by bytes, of records
that a hash of their own chooses, so they follow from the table, not from how it is dealt. A range's records are gzip
members one record each; a new file starts with each range and where the compressed size would pass a limit. Headers and
digests are made anew; a file is written under a temporary name and renamed to its place. Names and bytes so follow from
the input alone, whatever the cluster, and a task that runs again after a loss puts the same files in place. The manifest, one row
a file, is written last by Spark's committer; the reader takes only files that it names.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm.common import join_skewed, kept, parallelism

#: Compressed bytes of a file at most (one record may be larger).
ROLL_BYTES = 256 << 20
#: Bytes of payload of a range: four files' worth, of small tables less so that some tasks have work.
RANGE_BYTES, LEAST_RANGE, SMALL_RANGES = 4 * ROLL_BYTES, 8 << 20, 64
#: Records for each range that are looked at to find the bounds.
LOOK = 16
LEVEL = 6
DATE = "2020-01-01T00:00:00Z"
MANIFEST = "file string, part long, n_bytes long, n_records long, first_id long, last_id long, sha256 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, file string"


def filesystem(uri: str):
    """The file system of a URI and the path in it, as tasks see it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "file:///" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str, repeat: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{repeat}')}>"


def _member(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Date", DATE), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # a gzip header without time or name
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: tuple[int | None] | None, repeat: int) -> bytes:
    """The response, or where refers_to holds the id of another one's record the revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = "".join(c for c in url or "" if c > " ")
    fields = [("WARC-Record-ID", record_id(page_id, digest, repeat)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response"), ("Page-Id", "" if page_id is None else str(page_id))]
    if refers_to is None:
        return _member("response", fields, http + payload)
    fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to[0], digest, 0)), ("Refers-To-Page-Id", "" if refers_to[0] is None else str(refers_to[0]))]
    return _member("revisit", fields, http)


def range_bounds(rows: DataFrame, range_bytes: int | None = None) -> list[tuple[bool, int, int]]:
    """(page_id, mix, n_bytes) -> where each range but the first begins, as `place` gives it; ranges hold some `range_bytes`.

    Records are chosen by a hash of id and mix, some LOOK for each range, so the driver holds no more, and the same ones
    whatever the partitions.
    """
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    ranges = -(-size // range_bytes) if range_bytes else max(-(-size // RANGE_BYTES), min(SMALL_RANGES, size // LEAST_RANGE))
    if ranges < 2:
        return []
    one_in = max(1, n // (LOOK * ranges))
    some = rows.where(F.pmod(F.xxhash64("page_id", "mix", F.lit("bounds")), F.lit(one_in)) == 0)
    some = some.groupBy("page_id", "mix").agg(F.sum("n_bytes").alias("n_bytes")).collect()
    weighed = sorted((place(r["page_id"], r["mix"]), r["n_bytes"]) for r in some)
    each, upto, bounds = sum(x for _, x in weighed) / ranges, 0, []
    for at, weight in weighed:
        if upto >= each * (len(bounds) + 1):
            bounds.append(at)
        upto += weight
    return bounds


def place(page_id: int | None, mix: int) -> tuple[bool, int, int]:
    """By which records are in order; null ids come first."""
    return page_id is not None, page_id or 0, mix


def with_range(rows: DataFrame, bounds: list[tuple[bool, int, int]]) -> DataFrame:
    """(page_id, mix, ...) -> with `range`, the number of its range."""
    if not bounds:
        return rows.withColumn("range", F.lit(0).cast("long"))
    sent = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.arrow_udf("long")
    def number(page_id: pa.Array, mix: pa.Array) -> pa.Array:
        return pa.array([bisect_right(sent.value, place(a, b)) for a, b in zip(page_id.to_pylist(), mix.to_pylist())], pa.int64())

    return rows.withColumn("range", number("page_id", "mix"))


def write_warc(pages: DataFrame, path: str, min_bytes: int = 0, roll_bytes: int = ROLL_BYTES, range_bytes: int | None = None) -> DataFrame:
    """pages (page_id, url, html) -> archives under path; returns the manifest.

    Of records with equal payloads of at least `min_bytes` bytes the one of the largest page_id is the response, the
    others revisit it. A null html is an empty payload, a null page_id is smaller than all, repeated rows are records of
    their own (of one id and payload all but one are revisits; these ties are told apart by their number). A very long
    payload is one record, alone in its file if it is larger than `roll_bytes`. An empty table gives an empty manifest.
    Other columns are not written. `range_bytes`: payload of a range (by default RANGE_BYTES, less in small tables).
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("mix", F.xxhash64("payload"))
    ids = kept(rows.select("page_id", "mix", F.octet_length("payload").alias("n_bytes"), F.sha1("payload").alias("digest")), "digests")
    bounds = range_bounds(ids, range_bytes)
    ids = ids.where(F.col("n_bytes") >= min_bytes).drop("n_bytes")
    same = ids.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("stays")).where("n > 1").withColumn("repeats", F.lit(True))
    marks = kept(join_skewed(ids, kept(same, "same"), ["digest"], "n", ids.count()).where("repeats").select("page_id", "mix", "digest", "stays").distinct(), "marks")
    # A page's marks and its payload meet by the sort: one shuffle of payloads, no join.
    both = marks.select("page_id", "mix", F.lit(0).alias("kind"), "digest", "stays", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    both = both.unionByName(rows.select("page_id", "mix", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("stays"), "url", "payload"))
    n = max(1, min(len(bounds) + 1, 4 * parallelism(pages)))
    dealt = with_range(both, bounds).repartitionById(n, (F.col("range") % n).cast("int")).sortWithinPartitions("range", "page_id", "mix", "kind", "digest", "url")
    dealt = dealt.select("range", "page_id", "mix", "kind", "digest", "stays", "url", "payload")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(path)
        done, out, part, files = [], None, None, 0
        names = {x.name: x.type for x in pa.schema([("file", pa.string()), ("part", pa.int64()), ("n_bytes", pa.int64()), ("n_records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])}

        def start():
            name = f"part-{part:06d}-{files:05d}.warc.gz"
            temporary = f"{root}/_temporary/{name}.{task.taskAttemptId()}"
            info = _member("warcinfo", [("WARC-Record-ID", record_id(None, name, 0)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
            row = {"file": name, "part": part, "n_bytes": 0, "n_records": 0, "first_id": None, "last_id": None}
            return put((fs.open_output_stream(temporary, compression=None), temporary, row, hashlib.sha256()), info)

        def put(at, member: bytes):
            at[0].write(member)
            at[3].update(member)
            at[2]["n_bytes"] += len(member)
            return at

        def finish(at) -> None:
            at[0].close()
            fs.move(at[1], f"{root}/data/{at[2]['file']}")
            done.append(at[2] | {"sha256": at[3].hexdigest()})

        fs.create_dir(f"{root}/_temporary")
        fs.create_dir(f"{root}/data")
        page, marked, seen = object(), {}, {}
        for b in batches:
            for number, key, mix, kind, digest, stays, url, payload in zip(*(b.column(i).to_pylist() for i in range(8))):
                if number != part:
                    if out:
                        finish(out)
                    out, part, files = None, number, 0
                if (key, mix) != page:
                    page, marked, seen = (key, mix), {}, {}
                if kind == 0:
                    marked[digest] = stays
                    continue
                raw = hashlib.sha1(payload).digest()
                name, repeat = base64.b32encode(raw).decode(), seen.get(raw, 0)
                seen[raw] = repeat + 1
                stays = marked.get(raw.hex(), key)
                other = raw.hex() in marked and (stays != key or repeat > 0)
                member = page_record(key, url, payload, name, (stays,) if other else None, repeat)
                if out and out[2]["n_records"] and out[2]["n_bytes"] + len(member) > roll_bytes:
                    finish(out)
                    out, files = None, files + 1
                out = put(out or start(), member)
                out[2]["n_records"] += 1
                out[2]["first_id"] = key if out[2]["n_records"] == 1 else out[2]["first_id"]
                out[2]["last_id"] = key
        if out:
            finish(out)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in names.items()], list(names))

    dealt.mapInArrow(write, MANIFEST).write.json(f"{path}/manifest")
    fs, root = filesystem(path)
    if fs.get_file_info(f"{root}/_temporary").type.name == "Directory":
        fs.delete_dir(f"{root}/_temporary")
    return manifest(pages.sparkSession, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The unpacked gzip members of a stream, one at a time."""
    packed = stream.read(size)
    while packed:
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not packed and not (packed := stream.read(size)):
                raise ValueError("the file ends inside a record")
            out.append(unpack.decompress(packed))
            packed = unpack.unused_data if unpack.eof else b""
        packed = packed or stream.read(size)
        yield b"".join(out)


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields and block; the block digest is checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block digest differs")
    return fields, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """The page records of the files that the manifest names; payload_bytes and payload_digest are of the full payload."""
    files = manifest(spark, path)
    dealt = files.repartition(max(1, min(files.count(), 4 * parallelism(files))), "file").select("file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        number = lambda x: int(x) if x else None
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary()]
        names = [*(x.split()[0] for x in RECORD.split(", ")), "payload"]
        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[tuple] = []
                size = 0
                with fs.open_input_stream(f"{root}/data/{file}", compression=None) as stream:
                    for record in members(stream):
                        fields, block = parse(record)
                        if (kind := fields["WARC-Type"]) == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (len(payload) != length or sha1_base32(payload) != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']}: the payload differs")
                        rows.append((number(fields["Page-Id"]), fields["WARC-Target-URI"], kind, length, digest, number(fields.get("Refers-To-Page-Id")), fields["WARC-Record-ID"], file, payload if with_payload and kind == "response" else None))
                        size += len(payload) if with_payload else 0
                        if len(rows) == 4096 or size > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

    out = dealt.mapInArrow(read, RECORD + ", payload binary")
    return out if with_payload else out.drop("payload")
