import re
import struct
import zlib
from collections import Counter

import pytest
import xxhash

from lumisift.llm.sharding import ROUNDS, shard_documents
from lumisift.llm.queries import op10_sharding


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def mix(a, b):
    first = xxhash.xxh64_intdigest(struct.pack("<q", a), seed=42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), seed=first))


def permuted(x, n, seed):
    if n <= 1:
        return 0
    bits = max(2, (n - 1).bit_length())
    low, high = bits // 2, bits - bits // 2
    while True:
        left, right = x >> low, x & ((1 << low) - 1)
        for r in range(ROUNDS):
            mask = (1 << (high if r % 2 == 0 else low)) - 1
            left, right = right, left ^ (mix(right, seed * ROUNDS + r) & mask)
        x = left << low | right
        if x < n:
            return x


def brute(rows, n_shards, seed=20240501):
    digest = []
    for doc_id, text in rows:
        data = (text or "").encode()
        digest.append((doc_id, len(data) + 16, zlib.crc32(data)))
    digest.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    out = []
    for i, (doc_id, size, crc) in enumerate(digest):
        p = permuted(i, len(digest), seed)
        out.append((doc_id, size, crc, "rows", p % n_shards, p // n_shards, None))
    return sorted(map(repr, out))


COLUMNS = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def got(df):
    return sorted(repr(tuple(r)) for r in df.select(COLUMNS).collect())


def test_query_matches_brute_force(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    df = op10_sharding(spark, small)
    assert got(df) == brute(rows, 40)
    counts = Counter(r.shard for r in df.collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r.slot for r in df.where(df.shard == shard).collect()) == list(range(n))
        break


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_rows(spark, odd, shards):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert got(shard_documents(odd, shards)) == brute(rows, shards)


def test_empty_and_single(spark, empty, odd):
    assert shard_documents(empty).count() == 0
    assert got(shard_documents(odd.limit(1), 5)) == brute([tuple(odd.select("doc_id", "text").first())], 5)


def test_only_builtin_functions(spark, small):
    plan = op10_sharding(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
