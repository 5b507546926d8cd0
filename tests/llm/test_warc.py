import base64
import gzip
import hashlib
import os
import re
import subprocess
import sys

from pyspark.sql import functions as F

from lumisift.llm import warc
from lumisift.llm.common import fresh_path
from lumisift.llm.queries import op8_warc

PAGES = "page_id long, url string, html string"
ROWS = [
    (3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, "http://b/é\r\nX: 1", "same"), (1, "http://a/y", "same"), (4, None, None), (5, "http://c", ""),
    (None, "http://d", "same"), (None, "http://d", "lonely"), (9, "http://e", "ü" * 5000), (10, "http://e", "WARC/1.1\r\n\r\n" * 300),
]


def brute(rows):
    data = [(i, (h or "").encode()) for i, h in rows]
    least, copies = {}, {}
    for i, p in data:
        copies[p] = copies.get(p, 0) + 1
        if i is not None:
            least[p] = min(i, least.get(p, i))
    out = []
    for i, p in data:
        revisit = copies[p] > 1 and p in least and i != least[p]
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", least[p] if revisit else None))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in df.collect())


def test_query_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html").collect()]
    assert got(op8_warc(spark, small)) == brute(rows)


def test_odd_rows_in_small_chunks(spark):
    pages = spark.createDataFrame(ROWS, PAGES).withColumns({c: F.lit("clash") for c in ("sha1", "payload", "first_id", "chunk_no", "revisit")})
    assert got(warc.archive_pages(pages, chunk=16)) == brute([(i, h) for i, _, h in ROWS])
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_chunk_table_carries_incremental_digests(spark):
    folder = fresh_path(spark, "warc-test")
    records = warc.record_rows(spark.createDataFrame(ROWS, PAGES).repartition(1))
    parts = warc.write_archives(warc.chunk_rows(records, warc.repeated_payloads(records), chunk=100), folder)
    rows = warc.read_archives(parts, folder, chunk=64).collect()
    want = {(i, (h or "").encode()) for i, _, h in ROWS}
    seen = {}
    for r in sorted(rows, key=lambda r: (r.part, r.record, r.chunk_no)):
        so_far = seen.get((r.part, r.record), b"") + bytes(r.chunk)
        assert len(r.chunk) <= 64 and r.sha1_so_far == hashlib.sha1(so_far).hexdigest()
        seen[r.part, r.record] = so_far
        if r.last and r.record_type == "response":
            assert (r.page_id, so_far) in want
    assert {r.url for r in rows} == {u for _, u, _ in ROWS}
    whole = b"".join(gzip.open(part).read() for part in {r.part for r in rows})
    named = set(re.findall(rb"WARC-Record-ID: (<[^>]*>)", whole))
    assert {x for x in re.findall(rb"WARC-Refers-To: (<[^>]*>)", whole)} <= named and b"WARC-Refers-To" in whole
    for part in {r.part for r in rows}:
        whole = gzip.open(part).read()
        assert whole.startswith(b"WARC/1.1\r\n") and b"\r\nX: 1" not in whole


def test_shuffled_chunks_give_the_same(spark):
    records = warc.record_rows(spark.createDataFrame(ROWS, PAGES).repartition(3))
    out = []
    for broadcast in (True, False):
        folder = fresh_path(spark, "warc-test")
        chunks = warc.chunk_rows(records, warc.repeated_payloads(records), 16, broadcast)
        assert ("Exchange" in chunks._jdf.queryExecution().toString().split("Physical Plan")[1]) or broadcast
        rows = warc.read_archives(warc.write_archives(chunks, folder), folder, 16).where("last")
        out.append(got(rows))
    assert out[0] == out[1] == brute([(i, h) for i, _, h in ROWS])


def test_broadcast_way_exchanges_no_payload(spark, small):
    records = warc.record_rows(spark.read.parquet(f"{small}/pages.parquet"))
    plan = warc.chunk_rows(records, warc.repeated_payloads(records))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == plan.count("BroadcastExchange") == 1


LARGE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from lumisift.llm import warc
spark = (SparkSession.builder.master("local[1]").config("spark.driver.memory", "1g").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", {tmp!r})
    .config("spark.checkpoint.dir", "file://" + {tmp!r}).getOrCreate())
pages = spark.range(2).select(F.col("id").alias("page_id"), F.lit("http://x").alias("url"), F.repeat(F.lit("0123456789"), F.when(F.col("id") == 0, {n}).otherwise(1)).alias("html"))
print("FOUND", sorted((r.page_id, r.payload_bytes, r.payload_digest) for r in warc.archive_pages(pages).collect()))
"""


def test_a_payload_of_300_mb_in_a_heap_of_one_gb(tmp_path):
    n = 30 << 20
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", LARGE.format(repo=repo, tmp=str(tmp_path), n=n)], capture_output=True, text=True, timeout=600, cwd=repo)
    sha = hashlib.sha1()
    for _ in range(30):
        sha.update(b"0123456789" * (1 << 20))
    assert f"(0, {10 * n}, '{base64.b32encode(sha.digest()).decode()}')" in done.stdout, done.stderr[-2000:]
