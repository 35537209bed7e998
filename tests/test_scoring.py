from __future__ import annotations

import random

import pytest

from table_values import values
from tablelink.operators.scoring import (
    config_means,
    confusion,
    error_counts,
    error_pairs,
    error_rows,
    preview,
    report,
    run_accuracy,
    run_scores,
    score_rows,
)

SCHEMA = "dataset string, config string, iter int, `group` bigint, gold string, pred string"


def frame(spark, rows):
    return spark.createDataFrame(
        [("D", "c", 0, n, gold, pred) for n, (gold, pred) in enumerate(rows)], SCHEMA
    )


def weighted_f1(rows):
    total = 0.0
    for entity in {g for g, _ in rows}:
        support = sum(g == entity for g, _ in rows)
        predicted = sum(p == entity for _, p in rows)
        hits = sum(g == p == entity for g, p in rows)
        total += support * 2 * hits / (support + predicted)
    return total / len(rows)


PAIRS = [("Q1", "Q1"), ("Q1", "Q2"), ("Q2", "Q2"), ("0", "0"), ("0", "Q7"), ("Q3", "0"), ("Q4", "Q4"), (" Q4", "Q4 ")]


def test_scores(spark):
    scored = score_rows(frame(spark, PAIRS))
    trimmed = [(g.strip(), p.strip()) for g, p in PAIRS]
    row = run_scores(scored).first()
    right = sum(g == p for g, p in trimmed)
    assert (row["n"], row["accuracy"]) == (len(PAIRS), pytest.approx(right / len(PAIRS)))
    assert row["f1_all"] == pytest.approx(weighted_f1(trimmed))
    assert row["f1_non_nil"] == pytest.approx(weighted_f1([(g, p) for g, p in trimmed if g != "0"]))
    errors = error_rows(scored).count()
    assert row["accuracy"] == pytest.approx(1 - errors / len(PAIRS))
    assert run_accuracy(scored).first()["accuracy"] == row["accuracy"]
    assert error_counts(scored).first()["errors"] == errors
    assert error_pairs(scored).columns == ["gold", "pred"]
    assert sum(r["n"] for r in confusion(scored).collect()) == len(PAIRS)


def test_missing_sides_are_errors(spark):
    scored = score_rows(frame(spark, [(None, None), ("Q1", None), (None, "Q1"), ("Q1", "Q1")]))
    assert sorted(r["result"] for r in scored.collect()) == [0, 0, 0, 1]
    assert run_scores(scored).first()["n"] == 4


def test_only_nil_rows(spark):
    row = run_scores(score_rows(frame(spark, [("0", "0"), ("0", "Q1")]))).first()
    assert row["f1_all"] == pytest.approx(2 / 3) and row["f1_non_nil"] is None


def test_matches_spark_ml(spark):
    evaluation = pytest.importorskip("pyspark.ml.evaluation")
    rng = random.Random(1)
    pairs = [(f"Q{rng.randint(0, 5)}", f"Q{rng.randint(0, 7)}") for _ in range(500)]
    ours = run_scores(score_rows(frame(spark, pairs))).first()
    numbers = spark.createDataFrame(
        [(float(g[1:]), float(p[1:])) for g, p in pairs], "label double, prediction double"
    )
    for name, metric in (("f1_all", "f1"), ("accuracy", "accuracy")):
        theirs = evaluation.MulticlassClassificationEvaluator(metricName=metric).evaluate(numbers)
        assert ours[name] == pytest.approx(theirs)


def test_means_and_report(spark):
    rows = [("D", "a", n, g, "Q1", p) for n, preds in enumerate((["Q1", "Q1"], ["Q1", "Q2"])) for g, p in enumerate(preds)]
    rows += [("D", "b", 0, 0, "Q1", "Q2")]
    scores = run_scores(score_rows(spark.createDataFrame(rows, SCHEMA)))
    means = {r["config"]: r for r in config_means(scores).collect()}
    assert (means["a"]["runs"], means["a"]["accuracy"], means["b"]["accuracy"]) == (2, 0.75, 0.0)
    lines = {r["config"]: r for r in report(scores).collect()}
    assert [lines["a"][c] for c in ("run_1", "run_2", "run_3", "mean_accuracy")] == [1.0, 0.5, None, 0.75]


def test_partitions_do_not_matter(spark):
    df = frame(spark, PAIRS * 20)
    first = values(run_scores(score_rows(df.repartition(1))), "n", "accuracy", "f1_all")
    assert first == values(run_scores(score_rows(df.repartition(9, "pred"))), "n", "accuracy", "f1_all")


def test_preview(spark):
    df = frame(spark, [(f"Q{n}", "0") for n in range(20)]).repartition(5)
    assert [r["group"] for r in preview(df, "group").collect()] == [0, 1, 2, 3, 4]


def test_report_of_any_number_of_runs(spark):
    from tablelink.plans.pipelines import score_runs

    rows = [("D", "c", n, g, f"Q{g}", f"Q{g}" if n > g else "0") for n in range(5) for g in range(4)]
    runs = spark.createDataFrame(rows, "dataset string, config string, iter int, `group` bigint, gold string, pred string")
    line = score_runs(runs)[3].first()
    assert [line[f"run_{n}"] for n in range(1, 6)] == [0.0, 0.25, 0.5, 0.75, 1.0] and line["mean_accuracy"] == 0.5
    assert "run_3" not in score_runs(runs, 2)[3].columns
