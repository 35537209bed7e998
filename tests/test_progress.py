from __future__ import annotations

import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from table_values import values
from tablelink.config import LinkConfig
from tablelink.operators.answer_store import not_stored, prompt_digest, with_stored_answers
from tablelink.operators.calls import Calls, call_model, length_batches
from tablelink.operators.progress import finished_bitmaps, merged_bitmaps, pending_by_bitmaps
from tablelink.plans import pipelines
from tablelink.sources.files import read_runs

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONFIG = LinkConfig("D", "c", runs=2)
PROMPTS = "`group` bigint, tableName string, key string, gold string, prompt string"


@pytest.fixture(scope="module")
def prompts(spark):
    rows = [(g, "T", f"T {g} 0", f"Q{g}", f"which {g}?" + "x" * (g % 7)) for g in range(1, 31)]
    return spark.createDataFrame(rows, PROMPTS).repartition(3)


def echo(**_):
    return lambda asked: [f"<Q{p.split()[1].split('?')[0]}>" for p in asked]


def every(groups=range(1, 31)):
    return sorted(((run, g, f"Q{g}") for g in groups for run in range(2)), key=repr)


# --- calls ------------------------------------------------------------------


def test_batches_hold_similar_lengths_within_the_budget():
    lengths = [5, 100, 7, 3, 40, 41, 1000, 6]
    batches = list(length_batches(lengths, most=3, budget=120))
    assert sorted(at for batch in batches for at in batch) == list(range(8))
    for batch in batches:
        assert len(batch) == 1 or (len(batch) <= 3 and len(batch) * max(lengths[at] for at in batch) <= 120)
    assert [lengths[at] for batch in batches for at in batch] == sorted(lengths)
    assert list(length_batches([], 3, 10)) == []


@pytest.mark.parametrize("most, in_flight", [(1, 1), (4, 3), (100, 2)])
def test_a_failing_prompt_costs_no_other_answer(most, in_flight):
    asked, lock, running, peak = [], threading.Lock(), [0], [0]

    def predict(batch):
        with lock:
            running[0] += 1
            peak[0] = max(peak[0], running[0])
            asked.extend(batch)
        try:
            if any("bad" in p for p in batch):
                raise RuntimeError("no answer")
            return [p.upper() for p in batch]
        finally:
            with lock:
                running[0] -= 1

    given = [f"p{n}" if n % 5 else f"bad {n}" for n in range(20)] + [None]
    answers, errors = call_model(predict, given, Calls(most=most, in_flight=in_flight, attempts=2))
    for prompt, answer, error in zip(given, answers, errors):
        if prompt is None:
            assert (answer, error) == (None, "no prompt")
        elif "bad" in prompt:
            assert (answer, error) == (None, "RuntimeError: no answer")
        else:
            assert (answer, error) == (prompt.upper(), None)
    assert peak[0] <= in_flight


def test_second_attempts_and_wrong_counts():
    tries = {}

    def flaky(batch):
        for p in batch:
            tries[p] = tries.get(p, 0) + 1
        if len(batch) > 1:
            return ["one answer too few"] * (len(batch) - 1)
        if tries[batch[0]] < 4:
            raise ValueError("busy")
        return ["done"]

    answers, errors = call_model(flaky, ["a", "b"], Calls(attempts=4))
    assert answers == ["done", "done"] and errors == [None, None] and tries == {"a": 4, "b": 4}


# --- bitmaps ----------------------------------------------------------------


def test_pending_by_bitmaps(spark):
    groups = [0, 1, 7, 8, 32767, 32768, 32769, 70_000, 10**12, -1, -5, -40_000, None]
    done = [(g, run) for g in groups if g is not None for run in range(3) if (g + run) % 2 == 0]
    rows = spark.createDataFrame([("D", "c", run, g) for g, run in done], "dataset string, config string, iter int, `group` bigint")
    parts = [finished_bitmaps(rows.where("`group` % 3 = 0")), finished_bitmaps(rows.where("`group` % 3 <> 0")), finished_bitmaps(rows)]
    bits = merged_bitmaps(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    mentions = spark.createDataFrame([(g, "x") for g in groups], "`group` bigint, name string")
    got = pending_by_bitmaps(mentions, bits, 3)
    assert got.columns == ["group", "name", "iter"]
    want = [(g, run) for g in groups for run in range(3) if (g, run) not in done]
    assert values(got, "group", "iter") == sorted(want, key=repr)
    assert pending_by_bitmaps(mentions, bits.limit(0), 2).count() == 2 * len(groups)


# --- log --------------------------------------------------------------------


def test_batches_read_the_log_and_no_result(spark, prompts, tmp_path, monkeypatch):
    path, opened = str(tmp_path / "runs"), []
    read = pipelines._read_if_there

    def noted(session, place, schema):
        opened.append(place)
        return read(session, place, schema)

    pipelines.run_linking(prompts.where("`group` <= 10"), CONFIG, echo, path)
    monkeypatch.setattr(pipelines, "_read_if_there", noted)
    pipelines.run_linking(prompts, CONFIG, echo, path, batches=3)
    assert set(opened) == {f"{path}-progress"}
    assert values(read_runs(spark, path), "iter", "group", "pred") == every()


@pytest.mark.parametrize("lost", ["begin", "write", "end"])
def test_stopped_at_any_point(spark, prompts, tmp_path, monkeypatch, lost):
    """Nothing is lost or repeated, wherever the second of three batches stops."""
    path, calls = str(tmp_path / "runs"), []
    owner, name = {
        "begin": (pipelines.ProgressLog, "begin"), "write": (pipelines, "write_runs"), "end": (pipelines.ProgressLog, "end"),
    }[lost]
    real = getattr(owner, name)

    def stop(*args, **kwargs):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return real(*args, **kwargs)

    with monkeypatch.context() as patch:
        patch.setattr(owner, name, stop)
        with pytest.raises(RuntimeError):
            pipelines.run_linking(prompts, CONFIG, echo, path, batches=3)
    pipelines.run_linking(prompts, CONFIG, echo, path, batches=2)
    assert values(read_runs(spark, path), "iter", "group", "pred") == every()


def test_results_without_a_log(spark, prompts, tmp_path):
    path = str(tmp_path / "runs")
    some = pipelines.link(prompts.where("`group` <= 12"), CONFIG, echo)
    pipelines.write_runs(some, path)
    pipelines.run_linking(prompts, CONFIG, echo, path)
    assert values(read_runs(spark, path), "iter", "group", "pred") == every()


def test_failed_prompts_stay_pending(spark, prompts, tmp_path):
    path = str(tmp_path / "runs")

    def fragile(broken):
        def predict(asked):
            if any(f"which {g}?" in p for p in asked for g in broken):
                raise RuntimeError("down")
            return echo()(asked)
        return predict

    calls = Calls(most=8, attempts=1)
    pipelines.run_linking(prompts, CONFIG, fragile, path, options={"broken": [3, 17]}, calls=calls)
    kept = [g for g in range(1, 31) if g not in (3, 17)]
    assert values(read_runs(spark, path), "iter", "group", "pred") == every(kept)
    failed = spark.read.parquet(f"{path}-failed")
    assert values(failed, "group", "iter", "error") == sorted(
        ((g, run, "RuntimeError: down") for g in (3, 17) for run in range(2)), key=repr
    )
    pipelines.run_linking(prompts, CONFIG, fragile, path, options={"broken": []}, calls=calls)
    assert values(read_runs(spark, path), "iter", "group", "pred") == every()


# --- stored answers -----------------------------------------------------------


def test_digests(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), (None, 0)], "prompt string, iter int")

    def digests(model="m", options=None, repeat=F.col("iter")):
        return [r[0] for r in rows.select(prompt_digest(F.col("prompt"), model, options, repeat)).collect()]

    base = digests()
    assert len(set(base)) == 4
    assert digests(options={"x": 1, "y": 2}) == digests(options={"y": 2, "x": 1})
    assert set(digests("n")) & set(base) == set() and set(digests(options={"x": 1})) & set(base) == set()
    assert digests(repeat=None)[0] == digests(repeat=None)[1]


def test_answers_come_from_the_store(spark, prompts, tmp_path):
    store, log = str(tmp_path / "answers"), tmp_path / "asked"
    log.write_text("")
    name = str(log)

    def counting(**_):
        def predict(asked):
            with open(name, "a") as out:
                out.write("".join(p + "\n" for p in asked))
            return echo()(asked)
        return predict

    same = prompts.unionByName(prompts.withColumn("group", F.col("group") + 100))  # equal prompts
    first = pipelines.link_from_store(same.where("`group` % 100 <= 10"), CONFIG, counting, store, "m")
    assert first.count() == 40 and len(log.read_text().splitlines()) == 20
    second = pipelines.link_from_store(same, CONFIG, counting, store, "m", calls=Calls())
    assert second.count() == 120 and len(log.read_text().splitlines()) == 60
    again = pipelines.link_from_store(same, CONFIG, counting, store, "m")
    assert values(again.drop("processed_at")) == values(second.drop("processed_at"))
    assert len(log.read_text().splitlines()) == 60
    assert values(again.where("`group` <= 100"), "iter", "group", "pred") == every()


def test_store_with_two_answers(spark):
    store = spark.sql(
        "SELECT 'd' AS digest, output, at AS answered_at FROM VALUES "
        "('late', timestamp'2020-01-02'), ('early', timestamp'2020-01-01'), (null, timestamp'2020-01-01') AS v(output, at)"
    )
    rows = spark.createDataFrame([(1, "d", "p"), (2, "e", "p"), (3, "e", "p"), (4, "f", None)], "n int, digest string, prompt string")
    assert values(with_stored_answers(rows, store), "n", "output") == [(1, "early")]
    assert values(not_stored(rows, store)) == [("e", "p")]
