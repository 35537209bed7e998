from __future__ import annotations

import zlib

import pytest

from tablelink.llm.sharding import find_splitters, histogram_sort, shard_documents


def check(rows, got, shards):
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (i, len((t or "").encode()) + 16, None if t is None else zlib.crc32(t.encode())) for i, t in rows
    )
    for shard in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_near_equal_bytes(documents):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k} " * (k % 9)) for k in range(3000)]
    got = shard_documents(documents(rows), shards=10).collect()
    check(rows, got, 10)
    sizes = [sum(r["size"] for r in got if r["shard"] == n) for n in range(10)]
    assert max(sizes) < 1.02 * sum(sizes) / 10 and min(sizes) > 0.98 * sum(sizes) / 10
    # Equal texts are neighbours: the hot one spans consecutive shards.
    hot = sorted({r["shard"] for r in got if r["text_crc32"] == zlib.crc32(b"hot text")})
    assert hot == list(range(hot[0], hot[-1] + 1))


def test_edges(documents):
    long = "x" * 300_000
    rows = [(1, None), (2, ""), (2, ""), (None, "a"), (None, "a"), (3, long), (-4, "é")]
    got = shard_documents(documents(rows), shards=4).collect()
    known = [(i, t) for i, t in rows if i is not None]
    check(known, [r for r in got if r["doc_id"] is not None], 0)
    assert len(got) == len(rows)
    for shard in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_empty_table(documents):
    assert shard_documents(documents([])).collect() == []


@pytest.mark.parametrize("tolerance", [0.0, 0.05])
def test_splitters_count_exactly(spark, tolerance):
    keys = [(k * k * 7919 % 2**61) - 2**60 for k in range(400)]
    df = spark.createDataFrame([(k, 1) for k in keys], "key bigint, size bigint")
    splitters = find_splitters(df, "key", "size", 8, tolerance)
    below = [sum(k < s for k in keys) for s in splitters]
    assert all(abs(n - 50 * (at + 1)) <= max(1, 50 * tolerance) for at, n in enumerate(below))


def test_extra_columns_stay(spark):
    df = spark.createDataFrame([(5, 10, "a", 99), (6, 10, "b", 99)], "key bigint, size bigint, name string, slot int")
    got = histogram_sort(df, "key", "size", shards=2)
    assert sorted((r["name"], r["shard"], r["slot"]) for r in got.collect()) == [("a", 0, 0), ("b", 1, 0)]
