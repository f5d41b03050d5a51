"""WARC archives (operator 1): a writer, and a reader that splits at byte ranges.

Writing: each partition becomes one `.warc.gz` file, one gzip member per record.
A task writes under a name of its own attempt and returns that name; the manifest
(written by Spark, so only of tasks that committed) says which files count.
Losing an executor leaves at most a file that no manifest names.

Reading: archives are cut into byte ranges. A task scans its range for the gzip
magic, decodes the beginning of each candidate member, accepts it when a WARC
header comes out, and owns every record whose member starts inside its range,
reading past the end of the range to finish the last one. Ranges need no index
and no agreement between tasks.

Records with equal payloads of at least `min_bytes` bytes are stored once: the
row with the smallest id is the response, the others are revisits that name it.

Edge cases: a null payload is an empty one. Payloads under `min_bytes` are all
responses. Rows that share id and payload are equal; where the shared id is the
smallest, all of them are responses. A null id sorts after all others and is
written as an id of its own kind. An empty table gives an empty manifest. Only
id, url and payload are read, so that other columns can't clash.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAGIC = b"\x1f\x8b\x08"
MIN_BYTES = 100
RANGE_BYTES = 32 << 20
#: Reading tasks at most; more ranges than that share tasks.
MOST_TASKS = 200_000
_WINDOW = 1 << 20
_PROBE = 4096
MANIFEST = "path string, bytes long, records long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _filesystem(uri: str):
    """(pyarrow file system, path) of a URI that executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def _id(page_id: int | None) -> str:
    return "<urn:page:null>" if page_id is None else f"<urn:page:{page_id}>"


def _header(page_id, url, kind, refers_to, digest, n_payload, n_block) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_id(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {n_payload}", "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: {_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {n_block}"]) + "\r\n\r\n").encode()


def encode(page_id, url, payload: bytes, kind: str = "response", refers_to=None) -> bytes:
    """One record as a gzip member; a revisit has no block of its own."""
    digest = hashlib.sha256(payload).hexdigest()
    block = payload if kind == "response" else b""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return b"".join([packer.compress(_header(page_id, url, kind, refers_to, digest, len(payload), len(block))), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def classify(pages: DataFrame, key: str, payload: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Revisits only: (key, digest, refers_to). Thin rows; groups are aggregated before they move."""
    body = F.coalesce(F.col(payload), F.lit(""))
    thin = pages.select(F.col(key).alias("k"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).alias("n")).where(F.col("n") >= min_bytes)
    first = thin.groupBy("digest").agg(F.min("k").alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = thin.join(first, "digest").where(F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first")))
    return again.select("k", "digest", F.col("first").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, to: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes archives below `to` (a URI all nodes share); returns the manifest."""
    spark = pages.sparkSession
    again = classify(pages, key, payload, min_bytes)
    rows = pages.select(F.col(key).alias("k"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    marked = rows.join(again.select(F.col("k").alias("k2"), F.col("digest").alias("d2"), "refers_to"), F.col("k").eqNullSafe(F.col("k2")) & (F.col("digest") == F.col("d2")), "left")
    marked = marked.select("k", "url", F.col("payload").cast("binary").alias("payload"), "refers_to")
    from pyarrow import fs

    place, folder = _filesystem(to)
    place.create_dir(folder, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, size, n = None, None, 0, 0
        store, base = _filesystem(to)
        for batch in batches:
            for k, u, body, ref in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if sink is None:
                    path = f"{base}/part-{uuid.uuid4().hex}.warc.gz"
                    sink = store.open_output_stream(path, compression=None)
                record = encode(k, u, body, "response" if ref is None else "revisit", ref)
                sink.write(record)
                size, n = size + len(record), n + 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path.rsplit("/", 1)[1]], "bytes": [size], "records": [n]})

    marked.mapInArrow(write, MANIFEST).write.parquet(f"{to}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{to}/manifest")


class _Source:
    """A file read in windows; at(start, n) gives up to n bytes from there."""

    def __init__(self, handle):
        self.handle, self.begin, self.data = handle, 0, b""

    def at(self, start: int, n: int) -> bytes:
        if not (self.begin <= start and start + n <= self.begin + len(self.data)):
            self.handle.seek(start)
            self.begin, self.data = start, self.handle.read(max(n, _WINDOW))
        return self.data[start - self.begin : start - self.begin + n]


def _looks_like_record(source: _Source, start: int) -> bool:
    """Decodes the beginning of a candidate member; a WARC version line has to come out."""
    unpacker = zlib.decompressobj(31)
    try:
        return unpacker.decompress(source.at(start, _PROBE), 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _member(source: _Source, start: int) -> tuple[bytes, int]:
    """The whole member at start, its checksum verified, and where it ends."""
    unpacker, parts, at = zlib.decompressobj(31), [], start
    while not unpacker.eof:
        got = source.at(at, 1 << 16)
        if not got:
            raise EOFError(f"the archive ends within the member at {start}")
        parts.append(unpacker.decompress(got))
        at += len(got)
    return b"".join(parts), at - len(unpacker.unused_data)


def parse(record: bytes) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])]
    if len(payload) != int(fields["Content-Length"]):
        raise ValueError(f"the block of {fields['WARC-Record-ID']} is cut short")
    number = lambda x: None if x == _id(None) else int(x.removeprefix("<urn:page:").removesuffix(">"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(fields["X-Payload-Length"])):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest or length")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"), "record_type": kind,
        "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload_digest": digest,
        "payload_bytes": int(fields["X-Payload-Length"]), "payload": payload if kind == "response" else None,
    }


def records_in(handle, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in [start, end) of an open archive."""
    source, at = _Source(handle), start
    while at < end:
        # members follow each other, so that the magic is mostly right here
        window = source.at(at, len(MAGIC))
        if window != MAGIC:
            window = source.at(at, min(_WINDOW, end - at) + len(MAGIC) - 1)
        found = window.find(MAGIC)
        if found < 0:
            at += max(1, len(window) - len(MAGIC) + 1) if window else end - at
            continue
        at += found
        if at >= end:
            return
        if not _looks_like_record(source, at):
            at += 1
            continue
        record, at = _member(source, at)
        yield parse(record)


def read_archives(spark: SparkSession, base: str, manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of all archives of a manifest: ranges are numbered, and each is a task of its own up to MOST_TASKS."""
    count = F.ceil(F.col("bytes") / range_bytes).cast("long")
    # one row per archive, not per record or range, goes through this window
    numbered = manifest.where("bytes > 0").select("path", "bytes", (F.sum(count).over(Window.orderBy("path")) - count).alias("first"))
    starts = F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("at", "start")
    ranges = numbered.select("path", "bytes", "first", starts)
    tasks = min(MOST_TASKS, manifest.agg(F.sum(count)).first()[0] or 1)
    ranges = ranges.repartitionById(tasks, F.pmod(F.col("first") + F.col("at"), F.lit(tasks)).cast("int")).select("path", "bytes", "start")
    schema = RECORDS if payloads else RECORDS.rsplit(",", 1)[0]
    names = [x.split()[0] for x in schema.split(", ")]
    types = pa.schema([(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _filesystem(base)
        for batch in batches:
            for path, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with store.open_input_file(f"{folder}/{path}") as handle:
                    held, room = [], 0
                    for r in records_in(handle, start, min(start + range_bytes, size)):
                        held.append({n: r[n] for n in names})
                        room += len(r["payload"] or b"") if payloads else 100
                        if room > 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=types)
                            held, room = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=types)

    return ranges.mapInArrow(read, schema)
