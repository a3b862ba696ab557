"""WARC archives of web pages: a deduplicating writer and a splittable reader.

Writer: every task appends one gzip member per record to files of its own name;
the list of finished files is a table that Spark commits, so files of lost or
repeated attempts are never read.  Payloads that occur several times are stored
once, as the response with the largest page id; the others become revisit
records.  Reader: files are cut into byte ranges of any size; a task looks for
the gzip magic in its range, accepts a place only if a member that begins there
decodes to WARC headers, and owns the records that start inside its range,
reading past the end of the range for the last one.

Defined results: a null html is an empty payload; equal payloads with one page
id, or without any, are all responses; null page ids rank below all others; an
empty table writes no file and reads no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from busweave.session import scratch_path, settle

RANGE_BYTES = 16 << 20
FILE_BYTES = 256 << 20
MOST_TASKS = 50_000

# Fixed values of the formats.
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1.1"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "1970-01-01T00:00:00Z"

_BLOCK = 1 << 20
RECORD = (
    "path string, record_start long, record_end long, page_id long, url string, "
    "record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value) -> str:
    return " ".join(str(value).split())


def _record(page_id, url, payload: bytes, refers_to, revisit: bool) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", _DATE),
        ("WARC-Payload-Digest", f"sha1:{_digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
        ("X-Payload-Length", len(payload)),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if revisit:
        headers.append(("WARC-Profile", _PROFILE))
        headers.append(("X-Refers-To-Page-ID", refers_to))
    head = "".join(f"{name}: {value}\r\n" for name, value in headers).encode()
    return _VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def _write(root: str, file_bytes: int):
    def run(batches):
        store, base = fs.FileSystem.from_uri(root)
        store.create_dir(base, recursive=True)
        out, size, made = None, 0, []

        def close():
            out.close()
            made.append((path, size))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "response_id", "revisit")]
            for page_id, url, payload, response_id, revisit in zip(*columns, strict=True):
                if out is None:
                    path, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                member = _member(_record(page_id, url, payload, response_id, revisit))
                out.write(member)
                size += len(member)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict(
            {"path": pa.array([m[0] for m in made], pa.string()), "bytes": pa.array([m[1] for m in made], pa.int64())}
        )

    return run


def write_archives(
    pages: DataFrame, root: str, page: str = "page_id", url: str = "url", html: str = "html",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write one record per row below ``root``; returns the table (path, bytes) of files.

    The newest page of each payload is a small table joined back by the digest;
    both sides are plain shuffles, so a payload of very many pages is split.
    """
    rows = pages.select(
        F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    newest = settle(
        rows.groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
        .filter("n > 1").select(F.col("digest").alias("repeated"), "response_id"),
        "warc-newest",
    )
    revisit = F.coalesce(
        F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id")), F.lit(False)
    )
    joined = rows.join(newest, F.col("digest") == F.col("repeated"), "left").select(
        "page_id", "url", "payload", "response_id", revisit.alias("revisit")
    )
    return settle(joined.mapInArrow(_write(root, file_bytes), "path string, bytes long"), "warc-files")


def _headers(text: bytes) -> dict:
    lines = text.decode("utf-8", "replace").split("\r\n")
    pairs = (line.partition(":") for line in lines[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _open_member(source, at: int):
    """(record bytes, end) of the gzip member at ``at``, or None if it is no record."""
    unpacker, out, first = zlib.decompressobj(31), [], True
    source.seek(at)
    while not unpacker.eof:
        block = source.read(4096 if first else _BLOCK)
        if not block:
            return None
        try:
            out.append(unpacker.decompress(block))
        except zlib.error:
            return None
        at += len(block)
        if first and not (b"".join(out)[: len(_VERSION) - 1] == _VERSION[:-1]):
            return None
        first = first and not out[0]
    return b"".join(out), at - len(unpacker.unused_data)


def _parse(record: bytes):
    head, _, rest = record.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    revisit = headers["warc-type"] == "revisit"
    payload = None if revisit else block.partition(b"\r\n\r\n")[2]
    number = lambda name: int(headers[name]) if name in headers else None
    if revisit:
        size, digest = number("x-payload-length"), headers["warc-payload-digest"].partition(":")[2]
    else:
        size, digest = len(payload), _digest(payload)
        if headers["warc-payload-digest"] != f"sha1:{digest}":
            raise ValueError("payload digest does not match")
    return (
        number("x-page-id"), headers.get("warc-target-uri"), headers["warc-type"],
        number("x-refers-to-page-id"), payload, size, digest,
    )


def _scan(source, low: int, high: int):
    """Records that start in [low, high): (start, end, record)."""
    at = low
    while at < high:
        found = -1
        block_at = at
        while found < 0 and block_at < high:
            source.seek(block_at)
            block = source.read(min(_BLOCK, high - block_at) + len(_MAGIC) - 1)
            place = block.find(_MAGIC)
            found = block_at + place if place >= 0 else -1
            block_at += _BLOCK
        if found < 0 or found >= high:
            return
        member = _open_member(source, found)
        if member is None:
            at = found + 1
            continue
        yield found, member[1], member[0]
        at = member[1]


def _read(root: str):
    names = [c.split()[0] for c in RECORD.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in RECORD.split(", ")])

    def run(batches):
        store, _ = fs.FileSystem.from_uri(root)
        for batch in batches:
            for row in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(row["path"]) as source:
                    for start, end, record in _scan(source, row["low"], row["high"]):
                        rows.append((row["path"], start, end, *_parse(record)))
                        held += len(record)
                        if held > _BLOCK:
                            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    return run


def read_archives(files: DataFrame, root: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """All records of the files (path, bytes), each read by the range it starts in."""
    low = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = files.filter("bytes > 0").select("path", low.alias("low"))
    ranges = ranges.select("path", "low", (F.col("low") + range_bytes).alias("high"))
    # the table of ranges is small, but each stands for much reading: one task for every few
    tasks = min(max(ranges.count(), 1), MOST_TASKS)
    return ranges.repartition(tasks).mapInArrow(_read(root), RECORD)


def without_nested(records: DataFrame) -> DataFrame:
    """Drop records inside another one's bytes (an archive stored as a payload).

    Windows run per archive, whose size the writer bounds.
    """
    before = "max(record_end) OVER (PARTITION BY path ORDER BY record_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return records.withColumn("__reach", F.expr(before)).filter(
        "__reach IS NULL OR record_start >= __reach"
    ).drop("__reach")


def _qualified(spark, root: str) -> str:
    """The path with its file system, the cluster's default one if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    uri = files.makeQualified(path).toString()
    return "file://" + uri.removeprefix("file:") if uri.startswith("file:/") and not uri.startswith("file://") else uri


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = scratch_path(spark, "warc")
    root = _qualified(spark, root)
    records = read_archives(write_archives(pages, root), root).drop("payload")
    return without_nested(records).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {"op7_warc": op7_warc}
