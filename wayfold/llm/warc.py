"""WARC archives as a chunked record table.

``write_archives`` turns pages into gzip WARC files (one member a record, one file a task, named anew by each attempt, so
that a retried task leaves no half-written file in the manifest). It gets (record, chunk_no) rows too: the payload is cut
before it leaves Spark, and compressed, hashed and written chunk by chunk. ``read_archives`` streams archives back as rows of
(file, record_no, chunk_no): a payload of any size becomes several rows of at most ``chunk_bytes``, each with the number of
bytes and the SHA-1 digest of the payload up to and including it, so the last row of a record has the digest of the whole
and no task ever holds a whole record.

Records with equal payloads of at least ``min_bytes`` are stored once: the one with the largest page id is a ``response``,
the others are ``revisit`` records that refer to it. Shorter payloads, and groups whose page ids are all null, are
responses. Null html is an empty payload; a null url leaves out the target; a row with a null page id beside rows with ids
is a revisit; repeated rows with the largest id are all responses. An empty table gives no archives and no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import file_system, scratch_path, table

MIN_BYTES = 1000
CHUNK_BYTES = 1 << 20
ROLL_BYTES = 1 << 30
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "path string, record_no long, record_id string, record_type string, target string, refers_to string, chunk_no int, chunk binary, payload_bytes long, digest string, declared_bytes long, declared_digest string, is_last boolean"


def plan_records(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Each page with its payload, digest and what its record will be: record_type, refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha1("payload"))
    keep = (
        base.filter(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1 and kept is not null")
        .select("digest", "kept")
    )
    again = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return base.join(keep, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("kept")).alias("refers_to")
    )


def chunked(planned: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The rows of ``plan_records`` cut into chunks: a row for each (record, chunk_no), the chunks of a record one after another
    in one partition. Records without a body (revisits, empty payloads) have one empty chunk."""
    size = F.octet_length("payload").cast("long")
    body = F.when(F.col("record_type") == "response", size).otherwise(0)
    cut = planned.withColumn("size", size).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(body / chunk_bytes) - 1).cast("int"))))
    chunk = F.when(F.col("record_type") == "response", F.expr(f"substring(payload, chunk_no * {chunk_bytes} + 1, {chunk_bytes})")).otherwise(F.lit(b""))
    return cut.select("page_id", "url", "size", "digest", "record_type", "refers_to", "chunk_no", chunk.alias("chunk"))


def _head(page_id, url, size: int, digest: str, kind: str, refers_to) -> tuple[bytes, int]:
    """The head of a record (WARC and HTTP fields), and the length of the body that follows it."""
    http, body = _HTTP % size, size if kind == "response" else 0
    fields = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"] if kind == "revisit" else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + body}",
    ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http, body


def write_archives(planned: DataFrame, path: str, owner: str = "query", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the records of ``plan_records`` below ``path``, chunk by chunk; the manifest (path, records) of the files that
    count. The digest grows with the chunks and must end as the planned one."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        fs.create_dir(root, recursive=True)
        out, name, count, done = None, "", 0, []
        left, press, sha = 0, None, None
        for batch in batches:
            chunks = batch.column("chunk")
            for i, (*fixed, k) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "size", "digest", "record_type", "refers_to", "chunk_no")), strict=True)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, count = fs.open_output_stream(f"{root}/{name}", compression=None), 0
                parts = []
                if k == 0:
                    head, left = _head(*fixed)
                    press, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    parts.append(press.compress(head))
                chunk = chunks[i].as_buffer()
                left -= chunk.size
                sha.update(chunk)
                parts.append(press.compress(chunk))
                if left == 0:
                    if fixed[4] == "response" and sha.hexdigest() != fixed[3]:
                        raise ValueError(f"{path}/{name}: the chunks of record {count} don't give its digest")
                    parts += [press.compress(b"\r\n\r\n"), press.flush()]
                    count += 1
                out.write(b"".join(parts))
                if left == 0 and out.tell() >= ROLL_BYTES:
                    out.close()
                    done.append((f"{path}/{name}", count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{path}/{name}", count))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "records": [x[1] for x in done]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return table(chunked(planned, chunk_bytes).mapInArrow(write, "path string, records long"), "warc-manifest", owner)


def _fields(stream) -> dict[str, str] | None:
    """Header fields up to the empty line; None at the end of the archive."""
    line = stream.readline()
    while line == b"\r\n":
        line = stream.readline()
    if not line:
        return None
    found = {"": line.decode().strip()}
    while (line := stream.readline()) not in (b"\r\n", b""):
        key, _, value = line.decode().partition(":")
        found[key.strip().lower()] = value.strip()
    return found


def _stream(path: str, chunk_bytes: int) -> Iterator[tuple]:
    fs, at = file_system(path)
    with fs.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
        number = 0
        while (head := _fields(stream)) is not None:
            left, declared = int(head["content-length"]), None
            if "http" in head.get("content-type", ""):
                line = stream.readline()
                left -= len(line)
                while line not in (b"\r\n", b""):
                    if line.lower().startswith(b"content-length:"):
                        declared = int(line.split(b":")[1])
                    line = stream.readline()
                    left -= len(line)
            sha, seen, k = hashlib.sha1(), 0, 0
            fixed = (path, number, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"))
            told = head.get("warc-payload-digest", "")
            told = base64.b32decode(told.partition(":")[2]).hex() if told.startswith("sha1:") else None
            while True:
                chunk = stream.read(min(chunk_bytes, left)) if left else b""
                if left and not chunk:
                    raise EOFError(f"{path}: record {number} is cut off")
                left -= len(chunk)
                seen += len(chunk)
                sha.update(chunk)
                yield (*fixed, k, chunk, seen, sha.hexdigest(), declared, told, left == 0)
                k += 1
                if not left:
                    break
            number += 1


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table (``CHUNKS``) of the archives in the column ``path``."""
    spark = manifest.sparkSession
    files = manifest.count()  # a row a file: small
    tasks = max(1, min(files, 8 * spark.sparkContext.defaultParallelism, 100_000))
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in CHUNKS.split(", ")])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)), schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for row in _stream(path, chunk_bytes):
                    rows.append(row)
                    held += len(row[7])
                    if held >= 4 * chunk_bytes or len(rows) >= 4096:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    return manifest.select("path").repartition(tasks).mapInArrow(read, CHUNKS)


def archive_pages(pages: DataFrame, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK_BYTES, owner: str = "query") -> DataFrame:
    """Write an archive of ``pages`` and read it back as the chunked record table."""
    path = scratch_path(pages.sparkSession, "warc", owner)
    return read_archives(write_archives(plan_records(pages, min_bytes), path, owner, chunk_bytes), chunk_bytes)


def records(chunks: DataFrame) -> DataFrame:
    """One row a record, from the last chunk of each: what its payload weighs and hashes to, and what it refers to."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1)
    revisit = F.col("record_type") == "revisit"
    return chunks.filter("is_last").select(
        F.expr("try_cast(nullif(regexp_extract(record_id, '^<urn:page:(-?[0-9]+)>$', 1), '') as bigint)").alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type",
        F.when(revisit, number("refers_to").cast("long")).alias("refers_to"),
        (revisit | (F.col("digest") == F.col("declared_digest"))).alias("digest_ok"),
    )
