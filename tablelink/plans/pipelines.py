"""The composed calls: mentions, context, prompts, runs, scores, comparisons."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelink import schemas
from tablelink.config import LinkConfig
from tablelink.functions.prompts import render, template_fields
from tablelink.operators.answer_store import (
    ANSWERS,
    first_not_stored,
    not_stored,
    prompt_digest,
    with_stored_answers,
)
from tablelink.operators.calls import Calls
from tablelink.operators.candidates import HEADS, candidate_text, joined_candidates, render_candidates
from tablelink.operators.comparing import compare_runs, wrong_groups, wrong_mentions
from tablelink.operators.context import (
    attach_metadata,
    attach_rows,
    constant_metadata,
    expand_runs,
)
from tablelink.operators.examples import (
    Tokens,
    length_histogram,
    with_input_ids,
    with_length,
    with_text,
    word_tokens,
)
from tablelink.operators.fuzzy import fuzzy_entities
from tablelink.operators.joins import many_to_one
from tablelink.operators.linking import (
    Predict,
    answer_joined,
    answer_prompts,
    pending_runs,
    read_answers,
    result_rows,
    with_runs_left,
)
from tablelink.operators.mentions import (
    allowed_keys,
    allowed_tables,
    bounded_candidates,
    budgeted_candidates,
    mention_table,
    with_key_parts,
)
from tablelink.operators.ordered import joined_text, rows_in_order, text_parts
from tablelink.operators.progress import BITMAPS, finished_bitmaps, merged_bitmaps, pending_by_bitmaps, runs_left
from tablelink.operators.retrieval import Find, retrieve, retrieved
from tablelink.operators.scoring import config_means, error_rows, report, run_scores, score_rows
from tablelink.operators.search import build_index, search_entities
from tablelink.session import shared_folder, stored
from tablelink.sources.files import read_runs
from tablelink.sources.sinks import write_groups, write_runs, write_sheet


def search(mentions: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Text search with an index made for this call, below the session's shared folder."""
    return search_entities(mentions, build_index(entities, k, keep=stored), k, keep=stored)


FINDERS: dict[str, Find | None] = {"label": None, "search": search, "fuzzy": fuzzy_entities}


def allowed_candidates(
    candidates: DataFrame,
    allow: DataFrame | None = None,
    tables: DataFrame | None = None,
    dataset: str | None = None,
) -> DataFrame:
    if allow is not None:
        candidates = allowed_keys(candidates, allow, dataset)
    if tables is not None:
        candidates = allowed_tables(candidates, tables)
    return candidates


def build_mentions(
    candidates: DataFrame,
    allow: DataFrame | None = None,
    tables: DataFrame | None = None,
    *,
    dataset: str | None = None,
    dashed: bool = False,
) -> DataFrame:
    """Allowed candidates to one row per mention with its gold id and place."""
    rows = allowed_candidates(candidates, allow, tables, dataset)
    return with_key_parts(mention_table(rows), dashed=dashed)


def build_context(
    mentions: DataFrame,
    table_rows: DataFrame,
    meta: DataFrame | tuple[str, str] | None = None,
    order: str = "pos",
    with_text: bool = True,
) -> DataFrame:
    """Add cell, row text and, with `meta` (a table, or one title and summary
    for all), title and summary."""
    out = attach_rows(mentions, table_rows, with_text)
    if isinstance(meta, tuple):
        return constant_metadata(out, *meta)
    return out if meta is None else attach_metadata(out, meta, order)


@dataclass(frozen=True)
class PromptParts:
    """Prompts that are not joined yet, for runs over mentions with very many candidates.

    mentions    one row per mention: group, tableName, key, gold, and the texts that stand
                `before` and `after` its candidates
    candidates  one row per candidate: group, cand_pos, text; those of no mention do not count
    """

    mentions: DataFrame
    candidates: DataFrame


def prompt_parts(
    config: LinkConfig,
    candidates: DataFrame,
    table_rows: DataFrame,
    meta: DataFrame | tuple[str, str] | None = None,
    entities: DataFrame | None = None,
    allow: DataFrame | None = None,
    tables: DataFrame | None = None,
    *,
    order: str = "pos",
    dashed: bool = False,
) -> PromptParts:
    """The prompts of `build_prompts` in parts, for a template that names all candidates once.

    `link` and `link_from_store` join them in the tasks that put them to the model, so
    that no table holds a prompt; result rows have its length.
    """
    if not _named_once(config):
        raise ValueError("only a template that names all candidates once has parts")
    rows, context = _rows_and_context(config, candidates, table_rows, meta, entities, allow, tables, order, dashed)
    return _parts_around(config, context, rows)


def _named_once(config: LinkConfig) -> bool:
    replaced = "wiki" in template_fields(config.template_text) and config.policy == "replace"
    bounded = config.candidate_limit is not None or config.prompt_budget is not None
    return config.template_text.count("{cand}") == 1 and not replaced and not bounded


def _rows_and_context(
    config, candidates, table_rows, meta, entities, allow, tables, order, dashed
) -> tuple[DataFrame, DataFrame]:
    """Allowed candidates, and mentions with the columns the template names."""
    fields = template_fields(config.template_text)
    rows = allowed_candidates(candidates, allow, tables, config.dataset)
    context = build_context(
        with_key_parts(mention_table(rows), dashed=dashed),
        table_rows,
        meta if fields & {"title", "summary"} else None,
        order,
        with_text="row" in fields,
    )
    if "wiki" in fields:
        context = retrieve(context, entities, config.retrieval_limit, FINDERS[config.retrieval])
    return rows, context


def build_prompts(
    config: LinkConfig,
    candidates: DataFrame,
    table_rows: DataFrame,
    meta: DataFrame | tuple[str, str] | None = None,
    entities: DataFrame | None = None,
    allow: DataFrame | None = None,
    tables: DataFrame | None = None,
    *,
    order: str = "pos",
    dashed: bool = False,
    tokens: Tokens = word_tokens,
    named: Sequence[str] = ("tableName", "key", "gold"),
) -> DataFrame:
    """One row per mention: group, what is `named` of tableName, key and gold, and prompt.

    Only the inputs the template names are joined. The short columns of a
    mention go through the lookups first; the candidates join last, as rows between
    those of what stands before and after them where the template names them once.

    With a `prompt_budget`, the tokens of everything else are counted first, and the
    candidates that still fit are chosen by their own counts, before any text is put
    together. A prompt without candidates may be over the budget and stays as it is.
    """
    fields = template_fields(config.template_text)
    rows, context = _rows_and_context(config, candidates, table_rows, meta, entities, allow, tables, order, dashed)
    replaced = "wiki" in fields and config.policy == "replace"
    if _named_once(config):
        return _joined_prompts(_parts_around(config, context, rows), named)
    if "cand" in fields or replaced:
        if config.candidate_limit is not None:
            rows = bounded_candidates(rows, config.candidate_limit, "cand_pos")
        if config.prompt_budget is not None:
            rest = {name: F.col(name) for name in fields} | {"cand": F.lit("")}
            if "wiki" in fields:
                rest["wiki"] = retrieved(config.policy, config.guard, F.lit("") if replaced else None)
            left = F.lit(config.prompt_budget) - F.size(tokens(render(config.template_text, rest)))
            text = F.col("text")
            rows = budgeted_candidates(
                rows.select("group", "cand_pos", candidate_text(config.layout).alias("text")),
                context.select("group", left.alias("allowed")), text, F.size(tokens(text)), config.prompt_budget,
            )
            texts = joined_candidates(rows, text, config.layout)
            context = context.join(texts, "group", "left").withColumn("cand", F.coalesce("cand", F.lit("")))
        else:
            joined = "inner"
            if "cand" not in fields and config.candidate_limit is None:
                # Where retrieval found something, the prompt has no candidates in it.
                found = retrieved(config.policy, config.guard, F.lit(None).cast("string"))
                rows = many_to_one(rows, context.where(found.isNull()).select("group"), ["group"], "left_semi")
                joined = "left"
            context = context.join(render_candidates(rows, config.layout), "group", joined)
    if "wiki" in fields:
        wiki = retrieved(config.policy, config.guard, F.col("cand") if replaced else None)
        context = context.withColumn("wiki", wiki)
    prompt = render(config.template_text, {name: F.col(name) for name in fields})
    return context.select("group", *named, prompt.alias("prompt"))


def _parts_around(config: LinkConfig, context: DataFrame, rows: DataFrame) -> PromptParts:
    """What stands before, between and after the candidates of a template that names them once."""
    used = template_fields(config.template_text) - {"cand"}
    if "wiki" in used:
        context = context.withColumn("wiki", retrieved(config.policy, config.guard))
    fields = {name: F.col(name) for name in used}
    before, after = (render(part, fields) for part in config.template_text.split("{cand}"))
    head = F.lit(HEADS.get(config.layout, ""))
    return PromptParts(
        context.select(
            "group", "tableName", "key", "gold", F.concat(before, head).alias("before"), after.alias("after")
        ),
        rows.where(F.col("group").isNotNull()).select(
            "group", "cand_pos", candidate_text(config.layout).alias("text")
        ),
    )


def _part_rows(parts: PromptParts, carried: Sequence[str]) -> DataFrame:
    """What stands before and after the candidates as rows like theirs, so that no text of all
    candidates is made and joined. The rows before (part 0) carry columns of the mentions."""
    ends = F.array(
        F.struct(F.lit(0).alias("part"), F.col("before").alias("text")),
        F.struct(F.lit(2).alias("part"), F.col("after").alias("text")),
    )
    around = parts.mentions.select("group", *carried, F.inline(ends))
    place = dict(parts.candidates.dtypes)["cand_pos"]
    between = parts.candidates.withColumn("part", F.lit(1))
    return around.withColumn("cand_pos", F.lit(None).cast(place)).unionByName(between, allowMissingColumns=True)


def _joined_prompts(parts: PromptParts, named: Sequence[str]) -> DataFrame:
    """The rows before the candidates say that there is a mention. The tasks that join leave out
    the other groups, so that a long prompt is copied by no step after them."""
    rows = _part_rows(parts, named).withColumn("mentioned", F.when(F.col("part") == 0, True))
    return joined_text(
        rows, F.col("text"), keys=["group"], order=["part", "cand_pos"], out="prompt",
        carried=[*named, "mentioned"], needed="mentioned",
    )


def _parts_in_order(parts: PromptParts, runs: DataFrame) -> DataFrame:
    """The rows of prompts for `answer_joined`. `runs` are mentions of the parts with the list
    of runs to make; the rows after the candidates carry none, in case a mention has no others.

    The list goes along as a text: after each row Spark looks at the size of the Arrow batch, and
    for a column of lists that takes as long as the batch has rows that are null."""
    carried = ["tableName", "key", "gold", "runs"]
    asked = runs.where(F.size("runs") > 0).withColumn("runs", _listed("runs"))
    rows = _part_rows(PromptParts(asked, parts.candidates), carried)
    rows = rows.withColumn("runs", F.when(F.col("part") == 0, F.col("runs")))
    return rows_in_order(
        rows, F.col("text"), keys=["group"], order=["part", "cand_pos"], out="prompt", carried=carried
    )


def _listed(runs: str) -> Column:
    """A list of runs as `answer_joined` reads it."""
    return F.concat_ws(",", F.col(runs).cast("array<string>"))


# Candidates in a piece of a stored prompt. Parquet is read 4096 rows at a time, so pieces of a
# megabyte would not do.
_PIECE_ROWS = 128


def prompt_pieces(parts: PromptParts) -> DataFrame:
    """Prompts in parts as rows that can be stored: group, tableName, key, gold, piece (from 1),
    text. The texts of the pieces, one after another, are the prompt; names are in the first."""
    named = ("tableName", "key", "gold")
    rows = _part_rows(parts, named).withColumn("mentioned", F.when(F.col("part") == 0, True))
    return text_parts(
        rows, F.col("text"), keys=["group"], order=["part", "cand_pos"], out="text", rows=_PIECE_ROWS,
        carried=[*named, "mentioned"], needed="mentioned",
    )


def _read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


class ProgressLog:
    """Which mentions of a results folder are finished, in a folder beside it.

    A batch is noted before it starts, and with the bitmaps of its mentions when its
    results are written. So a run knows what is finished from the log alone. Only where a
    batch was started and not ended (its results may be there or not), or results are
    there without a log, are the results themselves read, once, to set the log right.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.results = spark, path
        self.path = f"{path.rstrip('/')}-progress"
        self.schema = f"token STRING, ended BOOLEAN, {BITMAPS}"

    def _append(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def begin(self) -> str:
        token = uuid.uuid4().hex
        blank = (token, False, None, None, None, None, None)
        self._append(self.spark.createDataFrame([blank], self.schema).coalesce(1))
        return token

    def end(self, token: str, finished: DataFrame) -> None:
        """Note the rows (dataset, config, iter, group) of a batch as finished."""
        bitmaps = finished_bitmaps(finished)
        blank = self.spark.createDataFrame([(token, True, None, None, None, None, None)], self.schema)
        named = bitmaps.select(F.lit(token).alias("token"), F.lit(True).alias("ended"), *bitmaps.columns)
        self._append(blank.unionByName(named).coalesce(1))

    def set_right(self) -> bool:
        """Read the results if the log does not tell about them; whether it did."""
        log = _read_if_there(self.spark, self.path, self.schema)
        open_tokens = [None]
        if log is not None:
            states = log.groupBy("token").agg(F.max("ended").alias("ended"))
            open_tokens = [row["token"] for row in states.where(~F.col("ended")).collect()]
            if not open_tokens:
                return False
        results = _read_if_there(self.spark, self.results, schemas.RUNS)
        if results is None and log is None:
            return False
        nothing = self.spark.createDataFrame([], schemas.RUNS)
        for number, token in enumerate(open_tokens):
            found = results if number == 0 and results is not None else nothing
            self.end(token or uuid.uuid4().hex, found.select("dataset", "config", "iter", "group"))
        return True

    def bitmaps(self, config: LinkConfig) -> DataFrame:
        """What is finished of a dataset and configuration, as it is now."""
        log = _read_if_there(self.spark, self.path, self.schema)
        if log is None:
            return self.spark.createDataFrame([], BITMAPS)
        known = (F.col("dataset") == config.dataset) & (F.col("config") == config.config)
        return stored(merged_bitmaps(log.where(known).select("dataset", "config", "iter", "bucket", "bits")))


def link(
    prompts: DataFrame | PromptParts,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    *,
    finished: DataFrame | None = None,
    options: dict[str, Any] | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Result rows of all runs that are not finished, one per mention and run.

    Prompts in parts are joined by the tasks that call the model, as many as a shuffle has;
    their result rows have `prompt_length` in place of the prompt.
    """
    if isinstance(prompts, PromptParts):
        rows = _parts_in_order(prompts, with_runs_left(prompts.mentions, finished, config.runs))
        answers = read_answers(answer_joined(rows, make_predict, options, marker=config.marker))
        return result_rows(answers, config.dataset, config.config)
    if finished is None:
        pending = expand_runs(prompts, config.runs)
    else:
        pending = pending_runs(prompts, finished, config.runs)
    answers = read_answers(
        answer_prompts(pending, make_predict, options, partitions), config.marker
    )
    return result_rows(answers, config.dataset, config.config)


def store_results(
    prompts: DataFrame,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    path: str,
    *,
    finished: DataFrame,
    options: dict[str, Any] | None = None,
    partitions: int | None = None,
    calls: Calls | None = None,
) -> None:
    """Answer the prompts of which the bitmaps `finished` have no bit, append the results
    to `path` and note them in its log.

    With `calls`, mentions whose prompt failed have no result and stay unfinished; they
    are appended to the folder `path` + "-failed", with the error. The answers are then
    stored once before they are told apart, so no prompt is put to the model twice.

    Prompts may be `prompt_pieces`. They are joined by the tasks that call the model; what is
    asked is appended in pieces to the folder `path` + "-prompts", once for all runs, and the
    results have `prompt_length` in place of the prompt.
    """
    log = ProgressLog(prompts.sparkSession, path)
    token, marker = log.begin(), config.marker
    if "piece" in prompts.columns:
        # They are cut where they are made.
        marker = None
        pending, answers = _answered_pieces(prompts, config, make_predict, path, finished, options, partitions, calls)
    else:
        pending = pending_by_bitmaps(prompts, finished, config.runs)
        answers = answer_prompts(pending, make_predict, options, partitions, calls)
    done = pending
    if calls is not None:
        answers = stored(answers)
        failed = answers.where(F.col("error").isNotNull()).drop("output")
        named = failed.select(F.lit(config.dataset).alias("dataset"), F.lit(config.config).alias("config"), "*")
        if not named.isEmpty():
            named.write.mode("append").parquet(f"{path.rstrip('/')}-failed")
        answers = done = answers.where(F.col("error").isNull()).drop("error")
    write_runs(result_rows(read_answers(answers, marker), config.dataset, config.config), path)
    log.end(
        token,
        done.select(F.lit(config.dataset).alias("dataset"), F.lit(config.config).alias("config"), "iter", "group"),
    )


def _answered_pieces(
    pieces: DataFrame,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    path: str,
    finished: DataFrame,
    options: dict[str, Any] | None,
    partitions: int | None,
    calls: Calls | None,
) -> tuple[DataFrame, DataFrame]:
    """Mentions and runs that are not finished, and the answers to them."""
    left = runs_left(pieces, finished, config.runs).where(F.size("runs") > 0)
    names = [F.lit(config.dataset).alias("dataset"), F.lit(config.config).alias("config")]
    asked = left.select(*names, "group", "runs", "piece", "text", F.current_timestamp().alias("asked_at"))
    asked.write.mode("append").partitionBy("dataset", "config").parquet(f"{path.rstrip('/')}-prompts")
    runs = F.when(F.col("piece") == 1, _listed("runs")).alias("runs")
    rows = left.select("group", "tableName", "key", "gold", runs, F.col("text").alias("prompt"), F.col("piece").alias("_number"))
    near = rows.repartition("group") if partitions is None else rows.repartition(partitions, "group")
    answers = answer_joined(near.sortWithinPartitions("group", "_number"), make_predict, options, calls, config.marker)
    return left.where(F.col("piece") == 1).select("group", F.explode("runs").alias("iter")), answers


def run_linking(
    prompts: DataFrame | PromptParts,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    path: str,
    *,
    batches: int | None = None,
    batch_prompts: int = 20_000,
    task_prompts: int = 250,
    work: str | None = None,
    options: dict[str, Any] | None = None,
    partitions: int | None = None,
    calls: Calls | None = None,
) -> list[float]:
    """Answer what is not stored yet and append it; the seconds of each batch.

    A stopped call leaves its finished batches, and the next call makes the rest. The
    prompts are rendered once into `work` (unless named, a new folder below the
    session's shared one) and read per batch. What is finished is read from the log of
    `path` once, at the start; no batch reads results. A batch has about `batch_prompts`
    prompts and a task about `task_prompts` calls, whatever the input size, unless the
    numbers of batches or partitions are given. `calls` is as in `store_results`.

    Prompts in parts are rendered and read as `prompt_pieces`, and no step but the tasks that
    call the model has a prompt as one value.
    """
    if isinstance(prompts, PromptParts):
        prompts = prompt_pieces(prompts)
    spark, pieces = prompts.sparkSession, "piece" in prompts.columns
    work = work or f"{shared_folder(spark)}/prompts-{config.dataset}-{config.config}-{time.time_ns()}"
    prompts.write.mode("error").parquet(f"{work}/all")
    rendered = spark.read.schema(prompts.schema).parquet(f"{work}/all")
    n = rendered.where(F.col("piece") == 1).count() if pieces else rendered.count()
    batches = batches or max(1, -(-n // batch_prompts))
    batched = rendered.withColumn(
        "batch", F.pmod(F.xxhash64("group"), F.lit(batches)).cast("int")
    )
    tasks = max(batches, -(-n // task_prompts))
    place = F.xxhash64("group", *(["piece"] if pieces else []), F.lit("task"))
    spread = batched.repartitionByRange(tasks, "batch", place)
    spread.write.mode("error").partitionBy("batch").parquet(f"{work}/batches")
    batched = spark.read.schema(batched.schema).parquet(f"{work}/batches")
    partitions = partitions or max(1, -(-n * config.runs // (batches * task_prompts)))
    log = ProgressLog(spark, path)
    log.set_right()
    # Batches have different mentions, so what one finishes does not matter to the next.
    finished = log.bitmaps(config)
    seconds = []
    for batch in range(batches):
        started = time.monotonic()
        store_results(
            batched.where(F.col("batch") == batch).drop("batch"),
            config,
            make_predict,
            path,
            finished=finished,
            options=options,
            partitions=partitions,
            calls=calls,
        )
        seconds.append(time.monotonic() - started)
    return seconds


def link_from_store(
    prompts: DataFrame | PromptParts,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    store: str,
    model: str,
    *,
    options: dict[str, Any] | None = None,
    partitions: int | None = None,
    calls: Calls | None = None,
) -> DataFrame:
    """Result rows of all runs, with the answers of a stored table where it has them.

    store   folder of answers by what was asked: model, options, run and prompt. What it
            lacks is asked, equal prompts of a run once, and appended to it first.
    A prompt that fails (with `calls`) is not stored and has no result row.

    Prompts in parts are joined twice, for their digests and for the model, and stored
    nowhere; their result rows have `prompt_length` in place of the prompt.
    """
    if isinstance(prompts, PromptParts):
        return _link_parts_from_store(prompts, config, make_predict, store, model, options, calls)
    spark = prompts.sparkSession
    digest = prompt_digest(F.col("prompt"), model, options, F.col("iter"))
    asked = stored(expand_runs(prompts, config.runs).withColumn("digest", digest))
    known = _read_if_there(spark, store, ANSWERS)
    missing = not_stored(asked, spark.createDataFrame([], ANSWERS) if known is None else known)
    answered = answer_prompts(missing, make_predict, options, partitions, calls)
    if calls is not None:
        answered = answered.where(F.col("error").isNull())
    answered.select("digest", "output", F.current_timestamp().alias("answered_at")).write.mode("append").parquet(store)
    answers = with_stored_answers(asked, spark.read.schema(ANSWERS).parquet(store))
    return result_rows(read_answers(answers, config.marker), config.dataset, config.config)


def _link_parts_from_store(
    parts: PromptParts,
    config: LinkConfig,
    make_predict: Callable[..., Predict],
    store: str,
    model: str,
    options: dict[str, Any] | None,
    calls: Calls | None,
) -> DataFrame:
    spark = parts.mentions.sparkSession
    every = _parts_in_order(parts, with_runs_left(parts.mentions, None, config.runs))
    asked = stored(answer_joined(every, None, options, model=model))
    known = _read_if_there(spark, store, ANSWERS)
    missing = first_not_stored(asked, spark.createDataFrame([], ANSWERS) if known is None else known)
    rows = _parts_in_order(parts, parts.mentions.join(missing, "group"))
    answered = answer_joined(rows, make_predict, options, calls, model=model)
    if calls is not None:
        answered = answered.where(F.col("error").isNull())
    answered.select("digest", "output", F.current_timestamp().alias("answered_at")).write.mode("append").parquet(store)
    answers = with_stored_answers(asked, spark.read.schema(ANSWERS).parquet(store))
    return result_rows(read_answers(answers, config.marker), config.dataset, config.config)


def score_runs(
    runs: DataFrame, numbers: int | None = None
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Scored rows, scores per run, means per configuration, report. The report has a
    column for each of `numbers` runs; without it, for each run there is."""
    scored = score_rows(runs)
    scores = run_scores(scored)
    if numbers is None:
        last = runs.agg(F.max("iter")).first()[0]
        numbers = 0 if last is None else last + 1
    return scored, scores, config_means(scores), report(scores, numbers)


def compare(
    runs: DataFrame, numbers: Sequence[int], sheet: str | None = None
) -> DataFrame:
    """The rows of a comparison that some run gets wrong; written when asked."""
    wrong = error_rows(compare_runs(score_rows(runs), numbers))
    if sheet is not None:
        write_sheet(wrong, sheet)
    return wrong


def mine_hard_cases(runs: DataFrame, path: str | None = None) -> DataFrame:
    """Groups that any run of any configuration gets wrong; written when asked."""
    groups = wrong_groups(wrong_mentions(score_rows(runs)))
    if path is not None:
        write_groups(groups, path)
    return groups


def prepare_examples(
    train: DataFrame,
    validation: DataFrame,
    bos,
    eos,
    tokens: Tokens = word_tokens,
    cap: int | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Padded training and validation examples, and the histogram of lengths."""
    options = {} if cap is None else {"cap": cap}
    train, validation = with_text(train), with_text(validation)
    lengths = length_histogram(with_length(train, tokens), with_length(validation, tokens))
    return (
        with_input_ids(train, bos, eos, tokens, **options),
        with_input_ids(validation, bos, eos, tokens, **options),
        lengths,
    )
