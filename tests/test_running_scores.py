from __future__ import annotations

import random

import pytest

from table_values import values
from tablelink import schemas
from tablelink.operators.scoring import run_scores, score_rows
from tablelink.sources.sinks import write_runs
from tablelink.streaming.scores import RunningScores, follow_scores

RESULTS = "dataset string, config string, iter int, `group` bigint, gold string, pred string"


def results(n=200):
    dice = random.Random(4)
    ids = ["0", "Q1", "Q2", "Q3 ", "Q4", None]
    return [("D", dice.choice("ab"), i % 3, i * 1000 - 500, dice.choice(ids), dice.choice(ids)) for i in range(n)]


def rounded(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in values(df)]


def test_any_order_and_repeats(spark, tmp_path, seed=1):
    rows = results()
    dice = random.Random(seed)
    parts = [[], [], []]
    for row in rows:
        parts[dice.randrange(3)].append(row)
    parts[2] += parts[0][:20] + parts[2][:5]  # counted already, and twice in one batch
    state = RunningScores(spark, str(tmp_path / "state"))
    assert state.scores().collect() == []
    for number, part in enumerate(parts):
        for _ in range(2):  # a batch that is made again changes nothing
            state.add(spark.createDataFrame(part, RESULTS).repartition(3), number)
    whole = spark.createDataFrame(rows, RESULTS)
    assert rounded(state.scores()) == rounded(run_scores(score_rows(whole)))


def test_stopped_batch_is_made_again(spark, tmp_path, monkeypatch):
    rows = results(60)
    state = RunningScores(spark, str(tmp_path / "state"))
    state.add(spark.createDataFrame(rows[:30], RESULTS), 0)
    monkeypatch.setattr("tablelink.streaming.scores.merged_bitmaps", lambda _: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        state.add(spark.createDataFrame(rows[30:], RESULTS), 1)
    monkeypatch.undo()
    assert rounded(state.scores()) == rounded(run_scores(score_rows(spark.createDataFrame(rows[:30], RESULTS))))
    state.add(spark.createDataFrame(rows[30:], RESULTS), 1)
    assert rounded(state.scores()) == rounded(run_scores(score_rows(spark.createDataFrame(rows, RESULTS))))


def test_following_results(spark, tmp_path):
    path, state = str(tmp_path / "runs"), str(tmp_path / "state")
    full = [(d, c, n, "T", f"T {g} 0", g, "p", "o", gold, pred) for d, c, n, g, gold, pred in results(40)]
    for part in (full[:15], full[15:]):
        write_runs(spark.createDataFrame(part, schemas.RUNS).coalesce(1), path)
        follow_scores(spark, path, state, str(tmp_path / "log"), files_per_batch=2).awaitTermination()
    want = run_scores(score_rows(spark.read.schema(schemas.RUNS).parquet(path)))
    assert rounded(RunningScores(spark, state).scores()) == rounded(want)


def test_rows_without_a_group_each_count(spark, tmp_path):
    state = RunningScores(spark, str(tmp_path / "state"))
    rows = [("D", "a", 0, None, "Q1", "Q1"), ("D", "a", 0, None, "Q1", "Q1"), ("D", "a", 0, 5, "Q1", "Q2")]
    state.add(spark.createDataFrame(rows, RESULTS), 7)
    assert state.scores().first()["n"] == 3
