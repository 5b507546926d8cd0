"""WARC archives written from, and read back as, a chunked record table.

A page becomes rows ``(record, chunk_no, chunk)`` before it leaves the JVM: the
numbers of its chunks are exploded and each chunk is cut out as it is handed on,
so the JVM holds a record once, as it read it, and neither writer nor reader
ever holds a payload that is longer than one chunk.
The writer streams the rows of a partition into one ``.warc.gz`` (a gzip member
per record) while an incremental SHA-1 runs along; the reader streams members
back into chunk rows that carry the digest of the payload so far. Payloads
already stored elsewhere become revisit records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from datetime import datetime, timezone
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, filesystem, fresh_path, small_side, stored

CHUNK = 1 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNK_SCHEMA = (
    "part string, record long, chunk_no int, last boolean, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, sha1_so_far string, payload_digest string, chunk binary"
)


def record_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, sha1, payload_bytes)`` of each page."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    return rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def repeated_payloads(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``(sha1_, first_id)`` of payloads of ``min_bytes`` or more that several
    pages have, with the smallest id; grouped without the payloads."""
    sizes = records.select("page_id", "sha1", "payload_bytes").where(F.col("payload_bytes") >= min_bytes)
    return stored(
        sizes.groupBy(F.col("sha1").alias("sha1_")).agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1").select("sha1_", "first_id"),
        "repeated",
    )


HEAD = ("page_id", "url", "sha1", "payload_bytes")


def chunk_rows(records: DataFrame, repeated: DataFrame, chunk: int = CHUNK, broadcast: bool | None = None) -> DataFrame:
    """The chunked record table: the rows of a record follow each other. Of
    pages with equal payloads the one with the smallest id is the response, the
    others revisit it and store no chunk.

    If the repeated payloads' digests are small they are broadcast, and nothing
    is exchanged. Else chunks, never whole records, are: to meet the digests,
    where skew handling may split a payload that many pages have, and again to
    follow each other.
    """
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    parts = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk)).cast("int")
    piece = F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)).alias("chunk")
    side = small_side(repeated) if broadcast is None else F.broadcast(repeated) if broadcast else repeated
    same = F.col("sha1") == F.col("sha1_")
    if side is not repeated:
        rows = records.join(side, same, "left").withColumn("revisit", revisit)
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.when(F.col("revisit"), 0).otherwise(parts - 1))).alias("chunk_no")).select(*HEAD, "first_id", "revisit", "chunk_no", piece)
    else:
        rows = records.select("*", F.monotonically_increasing_id().alias("row"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("chunk_no")).select(*HEAD, "row", "chunk_no", piece)
        rows = rows.join(side, same, "left").withColumn("revisit", revisit).where(~F.col("revisit") | (F.col("chunk_no") == 0))
        rows = rows.repartition("row").sortWithinPartitions("row", "chunk_no")
    last = F.when(F.col("revisit"), 0).otherwise(F.greatest(F.lit(0), F.ceil(F.col("payload_bytes") / chunk) - 1)).cast("int")
    return rows.select(
        *HEAD, "revisit", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "chunk_no", last.alias("last_chunk"),
        F.when(~F.col("revisit"), F.col("chunk")).alias("chunk"),
    )


def _name(page_id: int | None, sha1: str) -> str:
    """The record id of a page's response, which its revisits refer to."""
    return f"urn:x-page:{'null' if page_id is None else page_id}:{sha1}"


def _header(row: dict, block: int, place: str, date: str) -> bytes:
    """Repeated rows of a response are one record, written as often."""
    own = _name(row["page_id"], row["sha1"])
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if row['revisit'] else 'response'}", f"WARC-Record-ID: <{own}{':revisit:' + place if row['revisit'] else ''}>",
        f"WARC-Date: {date}", f"X-Page-Id: {'null' if row['page_id'] is None else row['page_id']}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(row['sha1'])).decode()}", f"X-Payload-Bytes: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
    ]
    if row["url"] is not None:
        plain = quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~-._")
        lines.append("WARC-Target-URI: " + plain)
        if plain != row["url"]:
            lines.append("X-Page-Url: " + json.dumps(row["url"]))
    if row["revisit"]:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{_name(row['refers_to'], row['sha1'])}>"]
    return ("\r\n".join(lines) + f"\r\nContent-Length: {block}\r\n\r\n").encode()


def write_archives(chunks: DataFrame, folder: str, date: str | None = None) -> DataFrame:
    """Write a table of ``chunk_rows`` as one archive per partition, dated
    ``date`` or now; returns ``(part, records)``.

    A part is written under a name of its attempt and then moved to its final
    name, so a repeated or speculative task leaves one whole file.
    """
    bounded_batches(chunks.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        fs, base = filesystem(folder)
        task = TaskContext.get()
        name = f"{base}/part-{task.partitionId():06d}.warc.gz"
        temp = f"{base}/_{task.partitionId():06d}-{task.taskAttemptId()}"
        out, packer, sha, n = None, None, None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    fs.create_dir(base, recursive=True)
                    out = fs.open_output_stream(temp, compression=None)
                if row["chunk_no"] == 0:
                    packer, sha = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                    block = len(HTTP_HEAD) + (0 if row["revisit"] else row["payload_bytes"])
                    out.write(packer.compress(_header(row, block, f"{task.partitionId()}-{n}", date) + HTTP_HEAD))
                if not row["revisit"]:
                    sha.update(row["chunk"])
                    out.write(packer.compress(row["chunk"]))
                if row["chunk_no"] == row["last_chunk"]:
                    if not row["revisit"] and sha.hexdigest() != row["sha1"]:
                        raise ValueError(f"digest of page {row['page_id']} differs from its chunks")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
        if out is not None:
            out.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"part": [name], "records": [n]}, schema=pa.schema([("part", pa.string()), ("records", pa.int64())]))

    return stored(chunks.mapInArrow(run, "part string, records long"), "parts")


def _b32(sha) -> str:
    return base64.b32encode(sha.digest()).decode()


def read_records(stream, part: str, chunk: int, with_payload: bool):
    """Chunk rows of one archive."""
    reader, record = gzip.GzipFile(fileobj=stream), 0
    while line := reader.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"{part}: record {record} begins with {line[:40]!r}")
        head = {}
        while (line := reader.readline()).strip():
            key, _, value = line.decode().partition(":")
            head[key] = value.strip()
        left = int(head["Content-Length"])
        while left > 0:  # the HTTP head
            line = reader.readline()
            left -= len(line)
            if not line.strip():
                break
        kind, sha, no = head["WARC-Type"], hashlib.sha1(), 0
        stated = head["WARC-Payload-Digest"].removeprefix("sha1:")
        refers = head.get("WARC-Refers-To", "").removeprefix("<urn:x-page:").partition(":")[0]
        size, page = int(head["X-Payload-Bytes"]), head["X-Page-Id"]
        while True:
            data = reader.read(min(chunk, left))
            if left and not data:
                raise ValueError(f"{part}: record {record} is cut short")
            left -= len(data)
            sha.update(data)
            if kind == "response" and not left and _b32(sha) != stated:
                raise ValueError(f"{part}: record {record} has another digest than stated")
            yield {
                "part": part, "record": record, "chunk_no": no, "last": not left, "page_id": None if page == "null" else int(page),
                "url": json.loads(head["X-Page-Url"]) if "X-Page-Url" in head else head.get("WARC-Target-URI"), "record_type": kind, "refers_to": int(refers) if refers else None, "payload_bytes": size,
                "sha1_so_far": sha.hexdigest(), "payload_digest": stated, "chunk": data if with_payload else None,
            }
            no += 1
            if not left:
                break
        reader.readline(), reader.readline()
        record += 1


def read_archives(parts: DataFrame, folder: str, chunk: int = CHUNK, with_payload: bool = True) -> DataFrame:
    """The chunked record table of archives; ``parts.part`` names the files."""
    spark: SparkSession = parts.sparkSession
    bounded_batches(spark)

    def run(batches):
        types = {"record": pa.int64(), "chunk_no": pa.int32(), "last": pa.bool_(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "chunk": pa.binary()}
        schema = pa.schema([(c.split()[0], types.get(c.split()[0], pa.string())) for c in CHUNK_SCHEMA.split(", ")])
        fs, _ = filesystem(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(part, compression=None) as stream:
                    for row in read_records(stream, part, chunk, with_payload):
                        rows.append(row)
                        held += 300 + len(row["chunk"] or b"")
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return parts.select("part").mapInArrow(run, CHUNK_SCHEMA)


def archive_pages(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write ``pages`` as archives in ``folder``, read them back, and return per
    page: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    A null payload counts as empty; equal payloads include empty ones. Repeated
    rows of the smallest id are responses each, repeated rows of others revisit
    it. A page with a null id revisits any with an id; if none has, each is a
    response. A null url gives no target header. A very long payload passes in
    chunks. Extra columns are ignored. An empty table gives no file and an
    empty result.
    """
    folder = folder or fresh_path(pages.sparkSession, "warc")
    records = record_rows(pages)
    parts = write_archives(chunk_rows(records, repeated_payloads(records, min_bytes), chunk), folder)
    return read_archives(parts, folder, chunk, with_payload=False).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"
    )
