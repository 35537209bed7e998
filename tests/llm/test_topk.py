from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tablelink.llm.topk import top_k

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int"


def brute(rows, k):
    given = {}
    for i, vector in rows:
        if i is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [math.floor(64 * x) for x in vector]
        given[i] = min(given.get(i, whole), whole)
    out = []
    for q, query in given.items():
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(query, v)), i) for i, v in given.items() if i != q)
            out += [(q, at, i, -score) for at, (score, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block_queries", [(1000, 1000), (40, 3)])
def test_against_all_pairs(spark, shard_rows, block_queries):
    dice = random.Random(1)
    rows = [(i, [dice.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)]  # many ties
    rows = [(i, [float(F_) for F_ in v]) for i, v in rows]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    given = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got = top_k(df, F.col("vec_id") % 20 == 0, k=7, shard_rows=shard_rows, block_queries=block_queries)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == brute(given, 7)


def test_edges(spark):
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]),
        (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [1.0]), (2, []), (3, [-0.001, 0.0]), (100, []),
    ]
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], SCHEMA)
    got = top_k(df, F.col("vec_id") % 20 == 0, k=3)
    assert sorted(map(tuple, got.collect())) == [
        (0, 1, 1, 4096), (0, 2, 2, 0), (0, 3, 100, 0),
        (100, 1, 0, 0), (100, 2, 1, 0), (100, 3, 2, 0),
    ]


def test_large_components(spark):
    df = spark.createDataFrame([(0, [1e9, 1.0], 0, 1), (1, [1e9, 1.0], 0, 1), (2, [-1e9, 3.0], 0, 1)], SCHEMA)
    got = sorted(map(tuple, top_k(df, F.col("vec_id") % 20 == 0).collect()))
    assert [(r[2], r[3]) for r in got] == [(1, 64000000000**2 + 64**2) if 64000000000**2 + 64**2 < 2**63 else (1, 2**63 - 1), (2, max(-(2**63) + 1, -(64000000000**2) + 64 * 192))]


def test_empty_and_alone(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert top_k(empty, F.col("vec_id") % 20 == 0).collect() == []
    alone = spark.createDataFrame([(0, [1.0], 0, 1)], SCHEMA)
    assert top_k(alone, F.col("vec_id") % 20 == 0).collect() == []
