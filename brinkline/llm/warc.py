"""WARC archives: writing captures, and transaction assembly when reading.

Writing: each page becomes three records (request, response or revisit,
metadata), tied together by ``WARC-Concurrent-To``.  Of captures with equal
payloads the one with the smallest id is the response and the others revisit
it.  Records are text, so Spark's own text writer puts them, compressed, in
any store it can reach; a capture's records stand together in one row, so a
task that is run again rewrites them whole.  Captures are written by classes
of size, with fewer of them to a file the longer they are, so a file holds
``file_bytes`` before compression at most, or a single capture.

Reading: files are parsed as a stream of records by their lengths; request
and metadata records are then joined to their capture through the
concurrent-to identifier, and one nested row per capture comes out.  A task
holds one compressed file and decompresses it piece by piece.

Defined results: null payloads are empty; a null URL gives no target header;
rows without an id revisit others but are never revisited while a row with
an id holds the payload; a record's identifier names the row's id and its
place in the table, so repeated ids are separate captures with records of
their own (all responses if they hold the smallest id; others revisit one of
these); the payload of a revisit is null, it stands with the response; an
empty table gives an empty archive and no row; a request or metadata record
whose capture is missing gives no row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .common import dropped, new_path, small_batches, tidy, with_row_key, written

CRLF = "\r\n"
FILE_BYTES = 128 << 20
ROWS_PER_FILE = 2000
STEP = 8  # a class of sizes holds captures up to 8 times as long as the one before
CLASSES = 12
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "type string, id string, concurrent_to string, refers_to string, uri string, digest string, payload_bytes long, fields string, payload binary"


def digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1."""
    sha = F.sha1(payload.cast("binary"))
    chunk = lambda k: F.lpad(F.conv(F.substring(sha, 1 + 10 * k, 10), 16, 32), 8, "0")
    return F.translate(F.concat(*map(chunk, range(4))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def revisits(rows: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``sha, first``: of each payload that several rows hold, the smallest id with its row's key.

    Only ids, keys and digests are shuffled, counted before the shuffle.  The
    table is written, so that the join with it is a plain one that Spark broadcasts
    if its size allows and else splits where a payload is very frequent.
    """
    rows = rows.filter(F.octet_length("payload") >= min_bytes)
    rows = rows.select(F.when(F.col("id").isNotNull(), F.struct("id", "key")).alias("first"), F.sha1(F.col("payload").cast("binary")).alias("sha"))
    return written(rows.groupBy("sha").agg(F.min("first").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first"), "warc-first")


def size_class(file_bytes: int) -> Column:
    """0 for captures of which ``ROWS_PER_FILE`` fit a file, then one more for each ``STEP`` times the size."""
    edges = [file_bytes // ROWS_PER_FILE * STEP**k for k in range(CLASSES - 1)]
    # what the headers of the three records take is counted as 2,000 bytes and the URL three times, escaped threefold
    size = F.octet_length("payload") + F.coalesce(F.octet_length("url"), F.lit(0)) * 9 + 2000
    return sum((F.when(size > edge, 1).otherwise(0) for edge in edges), F.lit(0))


def header(fields: list[tuple[str, Column | str]]) -> Column:
    parts: list[Column] = [F.lit("WARC/1.1" + CRLF)]
    for name, value in fields:
        value = F.lit(value) if isinstance(value, str) else value
        parts.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit("")))
    return F.concat(*parts, F.lit(CRLF))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write the archive under ``path`` (gzip files, any store Spark reaches), in one folder for each class of
    sizes that occurs.  Classes are counted in the same scan that finds equal payloads."""
    rows = with_row_key(pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload")), "key")
    sizes = Observation()
    counts = [F.count_if(F.col("class") == k).alias(f"n{k}") for k in range(CLASSES)]
    first = revisits(rows.withColumn("class", size_class(file_bytes)).observe(sizes, *counts), min_bytes)
    found = [k for k in range(CLASSES) if sizes.get.get(f"n{k}")]
    for k in found or [0]:
        put(rows.filter(size_class(file_bytes) == k), first, f"{path}/size-{k}", max(1, ROWS_PER_FILE // STEP**k))
    dropped(first)


def put(rows: DataFrame, first: DataFrame, path: str, per_file: int) -> None:
    """Write the captures of one class of sizes, ``per_file`` of them to a file at most."""
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).join(first, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("first.id").eqNullSafe(F.col("id"))
    urn = lambda id_, key: F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("none")), F.lit(":"), F.lower(F.hex(key)), F.lit(">"))
    name = urn(F.col("id"), F.col("key"))
    rows = rows.withColumns({"name": name, "digest": F.concat(F.lit("sha1:"), digest(F.col("payload"))), "again": again})
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    date = "2000-01-01T00:00:00Z"
    size = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size.cast("string"), F.lit(CRLF * 2))
    block = F.concat(http, F.when(F.col("again"), "").otherwise(F.col("payload")))
    ask = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(f" HTTP/1.1{CRLF}{CRLF}"))
    about = F.concat(F.lit("fetched-by: brinkline" + CRLF + "payload-bytes: "), size.cast("string"), F.lit(CRLF))
    record = lambda fields, body: F.concat(header([*fields, ("Content-Length", F.octet_length(body).cast("string"))]), body, F.lit(CRLF * 2))
    part = lambda kind: F.concat(F.lit("<urn:part:" + kind + ":"), F.uuid(), F.lit(">"))
    request = record([("WARC-Type", "request"), ("WARC-Record-ID", part("request")), ("WARC-Concurrent-To", F.col("name")), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=request")], ask)
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", part("metadata")), ("WARC-Concurrent-To", F.col("name")), ("WARC-Target-URI", uri), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], about)
    refers = F.when(F.col("again"), urn(F.col("first.id"), F.col("first.key")))
    profile = F.when(F.col("again"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    capture = record([("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), ("WARC-Record-ID", F.col("name")), ("WARC-Target-URI", uri), ("WARC-Date", date), ("WARC-Payload-Digest", F.col("digest")), ("WARC-Profile", profile), ("WARC-Refers-To", refers), ("Content-Type", "application/http; msgtype=response")], block)
    whole = F.concat(request, capture, meta)
    rows.select(F.left(whole, F.length(whole) - 1).alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse(stream: io.BufferedIOBase):
    """(header fields in lower case, block) of each record of an archive file."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        length = int(fields["content-length"])
        block = stream.read(length)
        if len(block) != length:
            raise ValueError(f"record {fields.get('warc-record-id')} is cut short")
        yield fields, block


def split_http(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split(CRLF)[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}, body


def records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archive files under ``path`` and its folders."""
    small_batches(spark)
    schema = pa.schema([("type", pa.string()), ("id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("uri", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("fields", pa.string()), ("payload", pa.binary())])

    def rows(data: pa.Buffer):
        stream = pa.BufferReader(data)  # no copy of the file
        if data[:2].to_pybytes() == b"\x1f\x8b":
            stream = gzip.GzipFile(fileobj=stream)
        for f, block in parse(io.BufferedReader(stream, 1 << 16)):
            kind = f.get("warc-type")
            size = payload = sha = fields = None
            if kind == "response":
                _, body = split_http(block)
                size, sha, payload = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), body
            elif kind == "revisit":
                http, _ = split_http(block)
                size, sha = int(http.get("content-length", 0)), f.get("warc-payload-digest", "").removeprefix("sha1:")
            else:
                fields = block.decode("utf-8", "replace")
            yield kind, f.get("warc-record-id"), f.get("warc-concurrent-to"), f.get("warc-refers-to"), f.get("warc-target-uri"), sha, size, fields, payload if with_payload else None

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                out, held = [], 0
                for row in rows(data.as_buffer()):
                    out.append(row)
                    held += len(row[8] or b"") + 200
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(tidy(run), RECORD)


def captures(found: DataFrame) -> DataFrame:
    """Transaction assembly: one nested row per response or revisit record, joined through the
    concurrent-to identifier with its request and metadata records."""
    parts = found.filter(F.col("type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    parts = parts.groupBy(F.col("concurrent_to").alias("key")).agg(F.collect_list(F.struct("type", "id", "uri", "fields")).alias("parts"))
    whole = F.struct("type", "id", "uri", "refers_to", "digest", "payload_bytes", "payload").alias("capture")
    joined = found.filter(F.col("type").isin("response", "revisit")).select(F.col("id").alias("key"), whole).join(parts, "key", "left")
    of = lambda kind: F.filter(F.coalesce("parts", F.array().cast(joined.schema["parts"].dataType)), lambda p: p["type"] == kind)
    return joined.select("capture", of("request").alias("requests"), of("metadata").alias("metadata"))


def page_id(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+):[0-9a-f]+>$", 1).try_cast("long")


def archive(spark: SparkSession, pages: DataFrame, with_payload: bool = True, **options: str | int) -> DataFrame:
    """Write ``pages`` to the shared folder and assemble what is read back; payloads are always read, for their
    digests, and stand in the rows unless ``with_payload`` is false."""
    path = new_path(spark, "warc")
    write(pages, path, **options)
    found = written(records(spark, path, with_payload), "warc-records")  # parsed once for both sides of the join
    out = written(captures(found), "captures")
    dropped(found)
    return out
