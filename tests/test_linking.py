from __future__ import annotations

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from table_values import values
from tablelink import schemas
from tablelink.config import LinkConfig, fine_tuned_config
from tablelink.operators.calls import Calls
from tablelink.operators.candidates import render_candidates
from tablelink.operators.context import expand_runs
from tablelink.operators.linking import answer_prompts, pending_runs
from tablelink.operators.ordered import joined_text
from tablelink.plans import pipelines
from tablelink.plans.queries import QUERIES
from tablelink.sources.files import read_run_prompts, read_runs
from tablelink.streaming.progress import follow_prompts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CONFIG = LinkConfig("D", "c", runs=3)


def length_answers(closing=">"):
    return lambda prompts: [f"<Q{len(p)}{closing}" if p != "bad" else None for p in prompts]


@pytest.fixture
def prompts(spark):
    rows = [(n, "T", f"T {n} 0", f"Q{n}", "x" * n if n % 4 else "bad") for n in range(1, 21)]
    return spark.createDataFrame(rows, "`group` bigint, tableName string, key string, gold string, prompt string")


def expected(runs=3):
    out = []
    for n in range(1, 21):
        out += [(run, n, f"Q{n}" if n % 4 else "0") for run in range(runs)]
    return sorted(out, key=repr)


def test_all_runs(prompts):
    results = pipelines.link(prompts, CONFIG, length_answers, partitions=3)
    assert values(results, "iter", "group", "pred") == expected()
    assert results.columns[:4] == ["dataset", "config", "iter", "tableName"]
    assert results.where("processed_at is null").count() == 0


def test_model_is_made_once_per_task_with_options(spark, tmp_path):
    log = str(tmp_path / "made")

    def make(limit, penalty):
        with open(log, "a") as out:
            out.write(f"{os.getpid()} {limit} {penalty}\n")
        return lambda prompts: ["Q1"] * len(prompts)

    df = spark.range(0, 50_000, 1, 2).select(
        F.col("id").alias("group"), F.lit(0).alias("iter"), F.lit("p").alias("prompt")
    )
    answered = answer_prompts(df, make, {"limit": 100, "penalty": 1.15})
    assert answered.count() == 50_000
    lines = open(log).read().splitlines()
    assert len(lines) == 2 and all(line.endswith(" 100 1.15") for line in lines)


def test_pending(spark):
    mentions = spark.createDataFrame([(1,), (2,), (3,)], "`group` bigint")
    done = spark.createDataFrame([(1, 0), (1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (9, 1)], "`group` bigint, iter int")
    assert values(pending_runs(mentions, done, 3), "group", "iter") == [
        (1, 1), (3, 0), (3, 1), (3, 2),
    ]


def test_marker_is_cut(prompts):
    config = fine_tuned_config("D", "t", runs=1)

    def make():
        return lambda prompts: [f"Q999> ### Answer: {'Q5' if len(p) % 2 else 'none'}" for p in prompts]

    results = pipelines.link(prompts, config, make)
    assert values(results.select("pred").distinct()) == [("0",), ("Q5",)]


@pytest.mark.parametrize("batches", [1, 4])
def test_stopped_run_is_resumed(spark, prompts, tmp_path, batches):
    path = str(tmp_path / "runs")
    first = prompts.where("`group` % 3 = 0")
    pipelines.run_linking(first, CONFIG, length_answers, path)
    assert read_runs(spark, path).count() == 18
    seconds = pipelines.run_linking(prompts, CONFIG, length_answers, path, batches=batches)
    assert len(seconds) == batches
    assert values(read_runs(spark, path), "iter", "group", "pred") == expected()
    pipelines.run_linking(prompts, CONFIG, length_answers, path)
    assert read_runs(spark, path).count() == 60


def test_failed_batch_leaves_finished_ones(spark, prompts, tmp_path):
    path = str(tmp_path / "runs")

    def make(broken):
        def predict(batch):
            if broken and any(len(p) == 17 for p in batch):
                raise RuntimeError("model lost")
            return [f"Q{len(p)}>" if p != "bad" else None for p in batch]

        return predict

    with pytest.raises(Exception, match="model lost"):
        pipelines.run_linking(prompts, CONFIG, make, path, batches=5, options={"broken": True})
    stored = read_runs(spark, path).count() if os.path.exists(path) else 0
    assert 0 < stored < 60
    pipelines.run_linking(prompts, CONFIG, make, path, batches=5, options={"broken": False})
    assert values(read_runs(spark, path), "iter", "group", "pred") == expected()


def test_other_configuration_is_not_finished(spark, prompts, tmp_path):
    path = str(tmp_path / "runs")
    pipelines.run_linking(prompts, CONFIG, length_answers, path)
    pipelines.run_linking(prompts, LinkConfig("D", "other", runs=1), length_answers, path)
    assert values(read_runs(spark, path).groupBy("config").count()) == [("c", 60), ("other", 20)]


def test_following_a_folder(spark, prompts, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("prompts", "runs", "state"))

    def run():
        query = follow_prompts(spark, source, out, state, CONFIG, length_answers, files_per_batch=1)
        query.awaitTermination()

    prompts.where("`group` <= 8").repartition(2).write.parquet(source)
    run()
    assert read_runs(spark, out).count() == 24
    prompts.where("`group` > 8").write.mode("append").parquet(source)
    run()
    run()
    assert values(read_runs(spark, out), "iter", "group", "pred") == expected()


@pytest.mark.parametrize("stream_first", [True, False])
def test_both_ways_into_one_folder(spark, prompts, tmp_path, stream_first):
    """No result is lost and none is asked for twice."""
    source, out, state, log = (str(tmp_path / name) for name in ("prompts", "runs", "state", "log"))
    some = prompts.where("`group` <= 8")
    some.write.parquet(source)

    def counting(**_):
        answer = length_answers()

        def predict(batch):
            with open(log, "a") as asked:
                asked.write("x" * len(batch))
            return answer(batch)

        return predict

    def follow():
        follow_prompts(spark, source, out, state, CONFIG, counting).awaitTermination()

    if stream_first:
        follow()
        pipelines.run_linking(prompts, CONFIG, counting, out)
    else:
        pipelines.run_linking(prompts.where("`group` > 3"), CONFIG, counting, out)
        follow()
        pipelines.run_linking(prompts, CONFIG, counting, out)
    assert values(read_runs(spark, out), "iter", "group", "pred") == expected()
    assert os.path.getsize(log) == read_runs(spark, out).count() == 60


def test_progress_by_default(spark, prompts, tmp_path):
    seconds = pipelines.run_linking(prompts, CONFIG, length_answers, str(tmp_path / "r"), batch_prompts=6)
    assert len(seconds) == 4 and read_runs(spark, str(tmp_path / "r")).count() == 60


def test_prompts_end_to_end(spark):
    candidates = spark.createDataFrame(
        [("T", "T 1 0", 1, "Q5", "Oslo", None, "[]", 1, 1), ("T", "T 1 0", 1, "Q6", "oslo 2", "d", "[]", 0, 2),
         ("T", "T 9 0", 2, "Q7", "x", "d", "[]", 1, 1), ("T", "T 2 0", 3, "Q8", "y", "d", "[]", 1, 1)],
        schemas.CANDIDATES,
    )
    rows = spark.createDataFrame(
        [("T", 1, ["city", "n"], ["Oslo", "7"]), ("T", 2, ["city", "n"], ["Rome", None])], schemas.TABLE_ROWS
    )
    meta = spark.createDataFrame([("T ", "Cities", None, 1)], "tableName string, title string, summary string, pos int")
    entities = spark.createDataFrame([("Q5", "oslo", "capital", "[]", 1)], schemas.ENTITIES)
    allow = spark.createDataFrame([("D", "T 1 0"), ("D", "T 9 0"), ("E", "T 2 0")], schemas.ALLOW_LIST)

    def built(**options):
        config = LinkConfig("D", "c", "{title}|{summary}|{row}|{cand}|{wiki}|{mention}", **options)
        prompts = pipelines.build_prompts(config, candidates, rows, meta, entities, allow)
        return {r["group"]: (r["prompt"], r["gold"]) for r in prompts.collect()}

    cand = "<[ID] Q5 Oslo [DESCRIPTION] nan [TYPE] None>,<[ID] Q6 oslo 2 [DESCRIPTION] d [TYPE] None>,"
    wiki = '"Result Q5:\\nLabel: oslo\\nDescription: capital"'
    row = "col: | city | n |   row 1: | Oslo | 7 |  "
    missing = "<[ID] Q7 x [DESCRIPTION] d [TYPE] None>,"
    appended = built(policy="append")
    assert appended == {
        1: (f"Cities|nan|{row}|{cand}|{wiki}|Oslo", "Q5"),
        2: (f"Cities|nan|nan|{missing}||nan", "Q7"),
    }
    assert built(policy="replace", guard="as_written")[1][0] == f"Cities|nan|{row}|{cand}|{cand}|Oslo"
    assert built(policy="replace")[2][0] == f"Cities|nan|nan|{missing}|{missing}|nan"
    short = built(policy="append", candidate_limit=1)[1][0]
    assert short == f"Cities|nan|{row}|{cand.split('>,')[0]}>,|{wiki}|Oslo"
    fixed = LinkConfig("D", "c", "{title}/{mention}")
    prompts = pipelines.build_prompts(fixed, candidates, rows, ("one", "s"), tables=None)
    assert {r["prompt"] for r in prompts.collect()} == {"one/Oslo", "one/nan", "one/Rome"}


@pytest.mark.parametrize("template", ["{cand}", "{cand}<{title}", "{mention}>{cand}", "{mention}>{cand}<{wiki}"])
@pytest.mark.parametrize("layout", ["tagged", "pipe"])
def test_prompts_around_candidates(spark, template, layout):
    """The same prompts as with the text of all candidates as one column, but no join of it."""
    candidates = spark.createDataFrame(
        [("T", f"T {g} 0", g, f"Q{g}{k}", "n", None, "[]", k % 2, None if k == 2 else -k)
         for g in (1, 2, 3) for k in range(3 * g)] + [("T", "T 1 0", None, "Q1", "n", None, "[]", 1, 1)],
        schemas.CANDIDATES,
    )
    rows = spark.createDataFrame([("T", 1, ["c"], ["Oslo"]), ("T", 2, ["c"], [None])], schemas.TABLE_ROWS)
    entities = spark.createDataFrame([("Q5", "oslo", "capital", "[]", 1)], schemas.ENTITIES)

    def built(template):
        config = LinkConfig("D", "c", template, policy="append", layout=layout)
        return pipelines.build_prompts(config, candidates, rows, ("one", "s"), entities)

    got, twice = built(template), built(template + "|{cand}")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan.split("MapInArrow")[0]
    cands = {r["group"]: r["cand"] for r in render_candidates(candidates, layout).collect()}
    expected = [
        (r["group"], r["tableName"], r["key"], r["gold"], r["prompt"][: -1 - len(cands[r["group"]])])
        for r in twice.collect()
    ]
    assert len(expected) == 3 and sorted(map(tuple, got.collect())) == sorted(expected)


@pytest.mark.parametrize(
    "name", ["link_cand_wiki", "sft_infer", "title_cand_idonly", "title_cand_wiki", "title_cand_wiki_what"]
)
def test_no_step_copies_a_joined_prompt(spark, tiny, name):
    """What joins the prompts gives the rows of the query; a filter or projection after it would
    hold a long prompt once more."""
    got = QUERIES[f"prompt_{name}"](spark, tiny)
    assert got.columns == ["group", "key", "gold", "prompt"]
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("MapInArrow")


def test_plans_fetch_only_what_the_template_names(spark, tiny):
    from tablelink.plans import bindings as b

    config = LinkConfig("D", "c", "title_cand_idonly")
    prompts = pipelines.build_prompts(
        config, b.candidates(spark, tiny), b.table_rows(spark, tiny), b.meta(spark, tiny), entities=None
    )
    assert "WindowGroupLimit" not in prompts._jdf.queryExecution().optimizedPlan().toString()
    assert prompts.count() == 200


def test_candidates_are_rendered_only_where_a_prompt_shows_them(spark, monkeypatch):
    """Where retrieval replaces the candidates, the text of a large mention is not made."""
    cands = spark.createDataFrame(
        [("T", f"T {n} 0", n, f"Q{n}{pos}", "c", None, "[]", 0, pos) for n in (1, 2) for pos in range(1, 4)], schemas.CANDIDATES
    )
    rows = spark.createDataFrame(
        [("T", n, ["name"], [name]) for n, name in ((1, "known"), (2, "unknown"))],
        "table_name string, row_no int, col_names array<string>, cells array<string>",
    )
    entities = spark.createDataFrame(
        [("Q7", "known", None, "[]", 1)], "id string, label string, description string, types string, rank int"
    )
    made = []
    render = pipelines.render_candidates
    monkeypatch.setattr(pipelines, "render_candidates", lambda df, layout: made.append(df) or render(df, layout))
    config = LinkConfig("D", "c", "{mention}: {wiki}", policy="replace")
    got = dict(pipelines.build_prompts(config, cands, rows, entities=entities).select("group", "prompt").collect())
    assert {r["group"] for r in made[0].select("group").collect()} == {2}
    assert "Q7" in got[1] and "<[ID]" not in got[1] and got[2].count("<[ID]") == 3
    written = LinkConfig("D", "c", "{mention}: {wiki}", policy="replace", guard="as_written")
    got = dict(pipelines.build_prompts(written, cands, rows, entities=entities).select("group", "prompt").collect())
    assert {r["group"] for r in made[1].select("group").collect()} == {1, 2}
    assert all(text.count("<[ID]") == 3 for text in got.values())


def parts_and_prompts(spark, template="{mention}>{cand}<{wiki}", **options):
    candidates = spark.createDataFrame(
        [("T", f"T {g} 0", g, f"Q{g}{k}", "n", "é" * g, "[]", k % 2, -k) for g in (1, 2, 3) for k in range(3 * g)],
        schemas.CANDIDATES,
    )
    rows = spark.createDataFrame([("T", 1, ["c"], ["Oslo"]), ("T", 2, ["c"], [None])], schemas.TABLE_ROWS)
    entities = spark.createDataFrame([("Q5", "oslo", "capital", "[]", 1)], schemas.ENTITIES)
    config = LinkConfig("D", "c", template, policy="append", runs=3, **options)
    made = [f(config, candidates, rows, ("one", "s"), entities) for f in (pipelines.prompt_parts, pipelines.build_prompts)]
    return config, *made


def echoing(log=None):
    def answer(prompts):
        if log:
            with open(log, "a") as out:
                out.write("x" * len(prompts))
        return [None if p.startswith("Rome") else f"{p} ### Answer:  <[ID] Q{len(p)}> " for p in prompts]

    return answer


def same_results(from_parts, from_prompts):
    """Result rows of parts are those of prompts, with the length in place of the prompt."""
    whole = from_prompts.withColumn("prompt_length", F.length("prompt")).drop("prompt", "processed_at")
    got = from_parts.drop("processed_at")
    assert "prompt" not in from_parts.columns and set(got.columns) == set(whole.columns)
    assert values(got.select(*whole.columns)) == values(whole)
    return got


@pytest.mark.parametrize("marker", [None, "### Answer:", "elsewhere"])
def test_parts_are_joined_where_the_model_is_asked(spark, marker):
    """The same results as from whole prompts, but no prompt leaves the task that asks."""
    config, parts, prompts = parts_and_prompts(spark, marker=marker)
    got = pipelines.link(parts, config, echoing)
    assert same_results(got, pipelines.link(prompts, config, echoing)).count() == 9
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan
    done = spark.createDataFrame([(1, 0), (1, 2), (2, 0), (2, 1), (2, 2), (9, 1)], "`group` bigint, iter int")
    rest = pipelines.link(parts, config, echoing, finished=done)
    same_results(rest, pipelines.link(prompts, config, echoing, finished=done))
    assert values(rest, "group", "iter") == [(1, 1), (3, 0), (3, 1), (3, 2)]


def test_rows_of_prompts_hold_no_lists(spark):
    """Spark's writer of Arrow batches takes time by the square of their rows for a column of lists
    that is null in most of them; the runs to make go along as a text."""
    _, parts, _ = parts_and_prompts(spark)
    runs = parts.mentions.withColumn("runs", F.expr("array_repeat(1, int(`group` - 1)) || array(0)"))
    runs = runs.unionByName(runs.limit(1).select("*").withColumns({"group": F.lit(9).cast("bigint"), "runs": F.expr("cast(array() as array<int>)")}))
    rows = pipelines._parts_in_order(parts, runs)
    assert dict(rows.dtypes)["runs"] == "string"
    assert sorted((r["group"], r["runs"]) for r in rows.where("runs is not null").collect()) == [
        (1, "0"), (2, "1,0"), (3, "1,1,0")
    ]
    assert 9 not in {r["group"] for r in rows.collect()}


def test_runs_of_a_long_prompt_are_asked_one_after_another(spark, tmp_path):
    log = str(tmp_path / "calls")

    def make():
        def answer(prompts):
            with open(log, "a") as out:
                out.write(f"{len(prompts)} ")
            return ["Q1>"] * len(prompts)

        return answer

    config, parts, _ = parts_and_prompts(spark)
    one = pipelines.PromptParts(parts.mentions.where("`group` = 3"), parts.candidates)
    assert values(pipelines.link(one, config, make), "group", "iter") == [(3, 0), (3, 1), (3, 2)]
    assert open(log).read().split() == ["1"] * 3


def test_only_templates_with_all_candidates_have_parts(spark):
    for wrong in ({"candidate_limit": 2}, {"prompt_budget": 50}, {"template": "{cand}{cand}"}, {"template": "{wiki}"}):
        with pytest.raises(ValueError, match="names all candidates once"):
            parts_and_prompts(spark, **wrong)


def test_parts_and_a_store(spark, tmp_path):
    """Digests of parts are those of prompts: either finds the answers of the other."""
    config, parts, prompts = parts_and_prompts(spark)
    log = str(tmp_path / "asked")
    for first, then in ((parts, prompts), (prompts, parts)):
        store = str(tmp_path / f"answers-{first is parts}")
        open(log, "w").close()
        made = pipelines.link_from_store(first, config, echoing, store, "m", options={"log": log}, calls=Calls())
        asked = made.count(), os.path.getsize(log)
        again = pipelines.link_from_store(then, config, echoing, store, "m", options={"log": log})
        assert asked == (9, 9) and again.count() == 9 and os.path.getsize(log) == 9
        same_results(*((made, again) if first is parts else (again, made)))


@pytest.mark.parametrize("piece_rows", [1, 2, 128])
@pytest.mark.parametrize("calls", [None, Calls()])
def test_stored_runs_of_parts(spark, tmp_path, monkeypatch, piece_rows, calls):
    """The same results as of whole prompts, over two calls into one folder. No stored row holds a
    whole prompt, but its pieces beside the results make it up."""
    monkeypatch.setattr(pipelines, "_PIECE_ROWS", piece_rows)
    config, parts, prompts = parts_and_prompts(spark, marker="### Answer:")
    log, path, other = (str(tmp_path / name) for name in ("asked", "runs", "others"))
    some = pipelines.PromptParts(parts.mentions.where("`group` <> 2"), parts.candidates)
    pipelines.run_linking(some, config, echoing, path, options={"log": log}, calls=calls)
    assert os.path.getsize(log) == 6
    pipelines.run_linking(parts, config, echoing, path, options={"log": log}, batches=2, calls=calls)
    assert os.path.getsize(log) == 9
    pipelines.run_linking(prompts, config, echoing, other)
    same_results(read_runs(spark, path, lengths=True), read_runs(spark, other))
    assert values(read_runs(spark, other, lengths=True).drop("processed_at")) == values(
        read_runs(spark, path, lengths=True).drop("processed_at")
    )
    assert "prompt" not in spark.read.parquet(path).columns
    pieces = read_run_prompts(spark, path)
    got = joined_text(pieces, F.col("text"), keys=["iter", "group"], order="piece", out="prompt")
    assert values(got) == values(expand_runs(prompts.select("group", "prompt"), 3).select("iter", "group", "prompt"))
    assert pieces.where("`group` = 3 and iter = 0").count() == -(-11 // piece_rows)


def test_failed_runs_of_parts_stay_pending(spark, tmp_path):
    config, parts, _ = parts_and_prompts(spark)
    path = str(tmp_path / "runs")

    def fragile(broken):
        def predict(asked):
            if any(p.startswith(broken) for p in asked):
                raise RuntimeError("down")
            return [f"<Q{len(p)}>" for p in asked]

        return predict

    calls = Calls(attempts=1)
    for broken, groups in (("Oslo", {2, 3}), ("nowhere", {1, 2, 3})):
        pipelines.run_linking(parts, config, fragile, path, options={"broken": broken}, calls=calls)
        got = read_runs(spark, path, lengths=True)
        assert {r["group"] for r in got.collect()} == groups and got.count() == 3 * len(groups)
    failed = spark.read.parquet(f"{path}-failed")
    assert values(failed, "group", "iter", "error") == [(1, run, "RuntimeError: down") for run in range(3)]
    # Asked twice, read once.
    assert read_run_prompts(spark, path).where("`group` = 1").count() == 3


def test_pieces_of_mentions_only(spark, monkeypatch):
    """Candidates of no mention are in no piece, wherever they stand in a batch."""
    monkeypatch.setattr(pipelines, "_PIECE_ROWS", 2)
    _, parts, prompts = parts_and_prompts(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for batch in (1, 3, 10_000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            for groups in ("(1)", "(2)", "(1, 3)"):
                some = pipelines.PromptParts(parts.mentions.where(f"`group` in {groups}"), parts.candidates)
                pieces = pipelines.prompt_pieces(some)
                got = joined_text(pieces, F.col("text"), keys=["group"], order="piece", out="prompt", carried=["tableName", "key", "gold"])
                want = prompts.where(f"`group` in {groups}")
                assert values(got.select(*want.columns)) == values(want)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_equal_questions_of_parts_are_asked_once(spark, tmp_path):
    config, parts, _ = parts_and_prompts(spark, template="{cand}")
    twice = pipelines.PromptParts(
        parts.mentions.unionByName(parts.mentions.withColumn("group", F.col("group") + 100)),
        parts.candidates.unionByName(parts.candidates.withColumn("group", F.col("group") + 100)),
    )
    log = str(tmp_path / "asked")
    got = pipelines.link_from_store(twice, config, echoing, str(tmp_path / "answers"), "m", options={"log": log})
    assert got.count() == 18 and os.path.getsize(log) == 9


def test_failed_questions_of_parts_are_not_stored(spark, tmp_path):
    config, parts, _ = parts_and_prompts(spark)

    def fragile(broken):
        def predict(asked):
            if any(p.startswith(broken) for p in asked):
                raise RuntimeError("down")
            return ["Q1>"] * len(asked)

        return predict

    store = str(tmp_path / "answers")
    for broken, groups in (("Oslo", {2, 3}), ("nowhere", {1, 2, 3})):
        options, calls = {"broken": broken}, Calls(attempts=1)
        got = pipelines.link_from_store(parts, config, fragile, store, "m", options=options, calls=calls)
        assert {r["group"] for r in got.select("group").collect()} == groups
