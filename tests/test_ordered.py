from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink.operators import ordered
from tablelink.operators.ordered import (
    first_k,
    joined_pieces,
    joined_text,
    order_bits_of,
    position,
    running_total,
)


def skewed(n=600):
    """A third of the rows in one group, order values with gaps, shuffled."""
    rng = random.Random(5)
    orders = rng.sample(range(100_000), n)
    return [("hot" if i % 3 == 0 else f"k{i % 40}", order, rng.randint(-5, 9)) for i, order in enumerate(orders)]


def brute(rows):
    out = []
    for key in {r[0] for r in rows}:
        total = 0
        for place, row in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            total += row[2]
            out.append((key, row[1], total, place))
    return out


def test_running_total_and_position(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, at bigint, v int").repartition(7)
    got = running_total(df, F.col("v"), keys=["key"], order="at", out="total", run_bits=8, order_bits=24)
    got = position(got, keys=["key"], order="at", out="place", run_bits=6, order_bits=24)
    assert values(got, "key", "at", "total", "place") == sorted(brute(rows), key=repr)


def test_running_total_without_keys(spark):
    rows = [("all", at, v) for _, at, v in skewed(200)]
    df = spark.createDataFrame(rows, "key string, at bigint, v int")
    got = running_total(df, F.col("v"), keys=[], order="at", out="total", run_bits=10, order_bits=20)
    assert values(got, "at", "total") == sorted([(r[1], r[2]) for r in brute(rows)], key=repr)


def test_negative_order_values(spark):
    df = spark.createDataFrame([("a", o, 1) for o in (-300, -1, 0, 5, 300)], "key string, at bigint, v int")
    got = position(df, keys=["key"], order="at", out="place", run_bits=4, order_bits=12)
    assert values(got, "at", "place") == sorted([(-300, 1), (-1, 2), (0, 3), (5, 4), (300, 5)], key=repr)


@pytest.mark.parametrize("keys", [[], ["key"]])
def test_hash_like_order_values(spark, keys):
    """Any 64-bit numbers: no window of the plan covers them all."""
    rng = random.Random(9)
    rows = [("a", rng.randrange(-(2**63), 2**63), 1) for _ in range(500)] + [("a", 2**63 - 1, 1), ("a", -(2**63), 1)]
    df = spark.createDataFrame(rows, "key string, at bigint, v int").repartition(5)
    got = running_total(df, F.col("v"), keys=keys, order="at", out="total")
    assert values(got, "at", "total") == sorted(
        ((at, n) for n, at in enumerate(sorted(r[1] for r in rows), 1)), key=repr
    )


def test_joined_text(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "key string, at bigint, v int").repartition(5)
    text = F.concat(F.col("at").cast("string"), F.lit(","))
    got = joined_text(df, text, keys=["key"], order="at", out="text")
    expected = [
        (key, "".join(f"{r[1]}," for r in sorted(rows, key=lambda r: r[1]) if r[0] == key))
        for key in {r[0] for r in rows}
    ]
    assert values(got, "key", "text") == sorted(expected, key=repr)


@pytest.mark.parametrize("batch", [1, 2, 7, 10_000])
def test_joined_text_makes_no_list_of_rows(spark, monkeypatch, batch):
    """Groups over several batches, null keys, places and texts, long texts that wait."""
    rows = [
        (None if k == 3 else k % 9, None if k % 4 == 0 else f"h{k % 2}", None if k % 13 == 0 else k * 7 % 50,
         None if k % 11 == 0 else f"é{k} " * (300 if k % 9 == 5 else 1))
        for k in range(120)
    ]
    df = spark.createDataFrame(rows, "a int, b string, at bigint, v string").repartition(3)
    expected = {}
    for a, b, _, v in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[3] is not None, r[3] or "")):
        expected[a, b] = expected.get((a, b), "head|") + (v or "")
    monkeypatch.setattr(ordered, "_LONG", 5000)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = joined_text(df, F.col("v"), keys=["a", "b"], order="at", out="text", head="head|")
        assert "collect_list" not in got._jdf.queryExecution().executedPlan().toString()
        assert {(r["a"], r["b"]): r["text"] for r in got.collect()} == expected
        assert got.count() == len(expected) and joined_text(df.limit(0), F.col("v"), keys=["a"], order="at", out="t").count() == 0
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_joined_text_of_groups_that_are_needed(spark, monkeypatch, batch):
    """Those whose first row has a value in the column, which is not handed on; short and long."""
    rows = [(a, k, "x" if k == 0 and a % 3 == 0 else None, f"{a}{k} " * (a + 1)) for a in range(12) for k in range(a % 4 + 1)]
    df = spark.createDataFrame(rows, "a int, at bigint, mark string, v string").repartition(3)
    monkeypatch.setattr(ordered, "_LONG", 30)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = joined_text(df, F.col("v"), keys=["a"], order="at", out="text", carried=["at", "mark"], needed="mark")
        assert got.columns == ["a", "at", "text"]
        assert values(got) == sorted(
            ((a, 0, "".join(r[3] for r in rows if r[0] == a)) for a in range(0, 12, 3)), key=repr
        )
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_first_k_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(skewed(), "key string, at bigint, v int")
    got = first_k(df, 3, keys=["key"], order=["at"], out="n")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    rows = skewed()
    for key in ("hot", "k1"):
        expected = sorted(r[1] for r in rows if r[0] == key)[:3]
        assert [r["at"] for r in got.where(F.col("key") == key).orderBy("n").collect()] == expected


def test_order_bits(spark):
    df = spark.createDataFrame([(5,), (-300,), (None,)], "at bigint")
    assert order_bits_of(df, "at") == 10 and order_bits_of(df.limit(0), "at") == 1
    assert order_bits_of(spark.createDataFrame([(2**63 - 1,), (-(2**63),)], "at bigint"), "at") == 64


@pytest.mark.parametrize("piece_chars", [1, 7, 50, 10_000])
def test_joined_pieces(spark, piece_chars):
    """The pieces in order are the whole text; each begins where it says."""
    rng = random.Random(8)
    rows = [("hot" if i % 3 else f"k{i % 4}", rng.randrange(200), "ab é"[: rng.randrange(5)] + str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "key string, at bigint, v string").repartition(5)
    whole = dict(joined_text(df, F.col("v"), keys=["key"], order="at", out="text").collect())
    pieces = joined_pieces(
        df, F.col("v"), keys=["key"], order="at", out="text", piece_chars=piece_chars, run_bits=4, order_bits=12
    ).collect()
    for key, text in whole.items():
        of_key = sorted((p["piece"], p["start"], p["text"]) for p in pieces if p["key"] == key)
        assert "".join(t for _, _, t in of_key) == text
        assert all(text[start : start + len(t)] == t and start // piece_chars == n for n, start, t in of_key)
        longest = max(len(v) for _, _, v in rows) * 9  # rows of one place are one text
        assert max(len(t) for _, _, t in of_key) < piece_chars + longest
    assert joined_pieces(df.limit(0), F.col("v"), keys=["key"], order="at", out="text", piece_chars=5).collect() == []


def test_joined_pieces_moves_the_texts_twice(spark):
    """Once to their run and once to their piece; the sums of runs are shuffled besides."""
    df = spark.createDataFrame(skewed(50), "key string, at bigint, v int").repartition(3)
    text = F.col("v").cast("string")
    got = joined_pieces(df, text, keys=["key"], order="at", out="text", piece_chars=9, run_bits=10, order_bits=20)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list") == 1
    tied = spark.createDataFrame([("a", 1, "x"), ("a", 1, None), ("a", 1, "yy"), ("a", 2, None), ("a", 3, "z")], "key string, at bigint, v string")
    got = joined_pieces(tied, F.col("v"), keys=["key"], order="at", out="text", piece_chars=1, run_bits=1, order_bits=4)
    assert values(got, "piece", "start", "text") == [(0, 0, "xyy"), (3, 3, "z")]
    one = joined_pieces(tied, F.col("v"), keys=["key"], order="at", out="text", piece_chars=2, run_bits=8, order_bits=4)
    assert values(one, "piece", "start", "text") == [(0, 0, "xyy"), (1, 3, "z")]


def test_texts_that_nobody_needs_are_not_made():
    """Rows of a group over many batches go by, if its first row has no value."""
    import pyarrow as pa

    from tablelink.operators.ordered import texts_joined

    def batches(*rows):
        for part in rows:
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("g", "runs", "text", "_number"), row)) for row in part],
                schema=pa.schema([("g", pa.int64()), ("runs", pa.list_(pa.int32())), ("text", pa.string()), ("_number", pa.int32())]),
            )

    rows = (
        [(1, [0], "a", 1), (1, None, "b", 2), (2, None, "c", 1)], [(2, None, "d", 2)],
        [(2, None, "e", 3), (3, [1], "f", 1)], [(3, None, "g", 2), (4, None, "h", 1)], [(4, None, "i", 2)],
    )
    got = [row for batch in texts_joined(batches(*rows), needed="runs") for row in batch.to_pylist()]
    assert [(row["g"], row["text"]) for row in got] == [(1, "ab"), (3, "fg")]
    got = [row for batch in texts_joined(batches(*rows)) for row in batch.to_pylist()]
    assert [(row["g"], row["text"]) for row in got] == [(1, "ab"), (2, "cde"), (3, "fg"), (4, "hi")]
