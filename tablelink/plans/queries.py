"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelink import schemas
from tablelink.config import LinkConfig, fine_tuned_config
from tablelink.functions.answers import after_marker
from tablelink.functions.prompts import TEMPLATES
from tablelink.functions.text import json_text
from tablelink.operators import comparing, context, examples, mentions, retrieval, scoring
from tablelink.operators.answer_store import prompt_digest
from tablelink.operators.calls import Calls
from tablelink.operators.candidates import candidate_pieces, render_candidates
from tablelink.operators.fuzzy import fuzzy_entities
from tablelink.operators.ordered import position
from tablelink.plans import bindings as b
from tablelink.plans import pipelines
from tablelink.session import shared_folder
from tablelink.sources import catalogue, files, sinks
from tablelink.sources.files import allow_list_rows, parse_tables
from tablelink.streaming.scores import RunningScores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CONST_TITLE = "Parts and their sizes"
CONST_SUMMARY = "One line per part: name, type and size."
_BOUND = 5
SPARSE_STEP, SPARSE_SHIFT = 92_233_720_368, 1 << 50


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- mentions -------------------------------------------------------------


@query
def mentions_allowed(spark, folder):
    allowed = mentions.allowed_keys(b.candidates(spark, folder), b.allow(spark, folder), "D1")
    return allowed.select("group", "key", "cand_pos", "id", "target")


@query
def tables_allowed(spark, folder):
    allowed = mentions.allowed_tables(b.candidates(spark, folder), b.allow_tables(spark, folder))
    return allowed.select("group", "tableName", "cand_pos", "id")


@query
def one_mention(spark, folder):
    return mentions.one_group(b.candidates(spark, folder), 77).select(
        "group", "key", "tableName", "cand_pos", "id", "name", "description", "types", "target"
    )


@query
def key_parts(spark, folder):
    col = F.when(F.col("p_type") == "PROMO", F.lit("x")).otherwise(F.lit("0"))
    key = F.concat(
        F.lit(" "), F.col("table_name"), F.lit("s/+  "), F.col("row_no").cast("string"),
        F.lit(" "), col, F.lit(" "),
    )
    keyed = b.rows(spark, folder).select(F.col("p_partkey").alias("group"), key.alias("key"))
    return mentions.with_key_parts(keyed)


@query
def key_parts_dash(spark, folder):
    row = F.when(F.col("p_type") != "PROMO", F.col("row_no").cast("string"))
    key = F.concat_ws("-", F.col("table_name"), F.lit("a"), row, F.lit("2"))
    keyed = b.rows(spark, folder).select(F.col("p_partkey").alias("group"), key.alias("key"))
    return mentions.with_key_parts(keyed, dashed=True)


@query
def allowlist_explode(spark, folder):
    """Documents of at most 1024 keys each, as several allow-list files hold."""
    documents = (
        b.allow(spark, folder)
        .groupBy("dataset", F.shiftright("group", 10).alias("part"))
        .agg(F.collect_list("key").alias("keys"))
        .select(F.to_json(F.create_map("dataset", "keys")).alias("value"))
    )
    return allow_list_rows(documents)


@query
def gold_ids(spark, folder):
    return mentions.mention_table(b.candidates(spark, folder))


@query
def mention_places(spark, folder):
    built = pipelines.build_mentions(
        b.candidates(spark, folder),
        b.allow(spark, folder),
        b.allow_tables(spark, folder),
        dataset="D1",
    )
    return built.select("group", "key", "gold", "table_name", "row_no", "col_no")


# --- context --------------------------------------------------------------


@query
def row_positions(spark, folder):
    part = b.read(spark, folder, "part").select("p_brand", "p_partkey")
    return position(part, keys=["p_brand"], order="p_partkey", out="row_no")


@query
def row_positions_sparse(spark, folder):
    """As row_positions, by numbers far apart and partly negative."""
    spread = (F.col("p_partkey") * SPARSE_STEP - SPARSE_SHIFT).alias("number")
    part = b.read(spark, folder, "part").select("p_brand", "p_partkey", spread)
    return position(part, keys=["p_brand"], order="number", out="row_no").drop("number")


@query
def meta_missing_running_sparse(spark, folder):
    """As meta_missing_running, by numbers far apart and partly negative."""
    spread = F.col("group") * SPARSE_STEP - SPARSE_SHIFT
    mentions = _with_meta(spark, folder).withColumn("group", spread)
    return context.missing_metadata_running(mentions, 3)


@query
def cell_lookup(spark, folder):
    places = b.places(spark, folder, columns=(0, 1, 3))
    found = context.lookup_cells(places, b.cells(spark, folder))
    return found.select("group", "col_no", "mention", "col_name", "cell_missing")


@query
def row_text(spark, folder):
    """From the long cell table, folded to rows."""
    found = context.attach_rows(
        b.places(spark, folder, columns=(1,)), context.rows_of_cells(b.cells(spark, folder))
    )
    return found.select("group", "mention", "col_name", "cell_missing", "row")


@query
def cells_from_files(spark, folder):
    """CSV files of at most 1000 lines each, written as text and parsed again."""
    quoted = F.transform("cells", lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"')))
    line = F.array_join(quoted, ",")
    table = F.concat_ws("-", "table_name", F.floor((F.col("row_no") - 1) / 1000).cast("string"))
    files = (
        b.table_rows(spark, folder)
        .select(table.alias("table_name"), F.struct(F.col("row_no").alias("at"), line.alias("text")).alias("line"))
        .groupBy("table_name")
        .agg(F.sort_array(F.collect_list("line")).alias("lines"))
        .select(
            "table_name",
            F.concat(F.lit("name,type,size\n"), F.array_join(F.col("lines.text"), "\n"))
            .cast("binary")
            .alias("content"),
        )
    )
    return context.cells_of_rows(parse_tables(files))


def _with_meta(spark, folder):
    places = b.places(spark, folder).select("group", "table_name")
    return context.attach_metadata(places, b.meta(spark, folder), "pos")


@query
def meta_join(spark, folder):
    return _with_meta(spark, folder).select("group", "table_name", "title", "summary", "has_meta")


@query
def meta_const(spark, folder):
    places = b.places(spark, folder).select("group")
    return context.constant_metadata(places, CONST_TITLE, CONST_SUMMARY)


@query
def meta_missing_total(spark, folder):
    return context.missing_metadata(context.expand_runs(_with_meta(spark, folder), 3))


@query
def meta_missing_running(spark, folder):
    return context.missing_metadata_running(_with_meta(spark, folder), 3)


# --- candidates and retrieval ---------------------------------------------


@query
def candidate_text(spark, folder):
    return render_candidates(b.candidates(spark, folder))


@query
def candidate_text_pieces(spark, folder):
    """Candidate texts in pieces of 5000 characters; the hot mention has many."""
    return candidate_pieces(b.candidates(spark, folder), 5000)


@query
def candidate_text_pipe(spark, folder):
    return render_candidates(b.candidates(spark, folder), "pipe")


@query
def candidate_list_bounded(spark, folder):
    """The bounded list: the first candidates of a mention by name and id."""
    kept = mentions.bounded_candidates(b.candidates(spark, folder), _BOUND, "name", "id")
    return kept.select("group", "cand_pos", "id")


def _cell_mentions(spark, folder):
    cells = b.cells(spark, folder)
    return cells.select("table_name", "row_no", "col_no", F.col("value").alias("mention"))


@query
def kb_lookup_topk(spark, folder):
    return retrieval.lookup_entities(_cell_mentions(spark, folder), b.entities(spark, folder))


def searched_mentions(spark, folder):
    """Cell values; names together with the name of their table."""
    cells = b.cells(spark, folder)
    both = F.concat_ws(" ", "value", "table_name")
    mention = F.when(F.col("col_no") == 0, both).otherwise(F.col("value"))
    return cells.select("table_name", "row_no", "col_no", mention.alias("mention"))


@query
def kb_search_topk(spark, folder):
    found = pipelines.search(searched_mentions(spark, folder), b.entities(spark, folder), 5)
    return found.select("table_name", "row_no", "col_no", "mention", "place", "entity_id", "score")


def misspelt_mentions(spark, folder):
    """Names without their third letter, with two letters exchanged, with a letter more,
    or as they are."""
    names = b.cells(spark, folder).where(F.col("col_no") == 0)
    value, kind = F.col("value"), F.col("row_no") % 4

    def part(first, n=100):
        return F.substr(value, F.lit(first), F.lit(n))

    mention = (
        F.when(kind == 0, F.concat(part(1, 2), part(4)))
        .when(kind == 1, F.concat(part(2, 1), part(1, 1), part(3)))
        .when(kind == 2, F.concat(value, F.lit("x")))
        .otherwise(value)
    )
    return names.select("table_name", "row_no", mention.alias("mention"))


@query
def kb_fuzzy_topk(spark, folder):
    found = fuzzy_entities(misspelt_mentions(spark, folder), b.entities(spark, folder), 5)
    return found.select("table_name", "row_no", "mention", "place", "entity_id", "edits")


@query
def retrieval_search(spark, folder):
    found = retrieval.retrieve(
        searched_mentions(spark, folder), b.entities(spark, folder), 5, pipelines.FINDERS["search"]
    )
    wiki = retrieval.retrieved("append").alias("wiki")
    return found.select("table_name", "row_no", "col_no", wiki)


def _retrieved(spark, folder, policy, guard="intended"):
    found = retrieval.retrieve(_cell_mentions(spark, folder), b.entities(spark, folder), k=3)
    other = F.concat(F.lit("candidates of "), F.coalesce("mention", F.lit("nan")))
    wiki = retrieval.retrieved(policy, guard, other)
    return found.select("table_name", "row_no", "col_no", wiki.alias("wiki"))


@query
def retrieval_replace(spark, folder):
    return _retrieved(spark, folder, "replace")


@query
def retrieval_append(spark, folder):
    return _retrieved(spark, folder, "append")


@query
def retrieval_plain(spark, folder):
    return _retrieved(spark, folder, "plain")


@query
def retrieval_replace_as_written(spark, folder):
    return _retrieved(spark, folder, "replace", "as_written")


@query
def retrieval_append_as_written(spark, folder):
    return _retrieved(spark, folder, "append", "as_written")


@query
def json_texts(spark, folder):
    documents = b.read(spark, folder, "documents")
    return documents.select("doc_id", json_text(F.col("text")).alias("json"))


# --- prompts and runs -----------------------------------------------------


def _prompts(spark, folder, config, some="true", **options):
    return pipelines.build_prompts(
        config,
        b.candidates(spark, folder).where(some),
        b.table_rows(spark, folder),
        b.meta(spark, folder),
        b.entities(spark, folder),
        **options,
    )


def _prompt_parts(spark, folder, config):
    return pipelines.prompt_parts(
        config,
        b.candidates(spark, folder),
        b.table_rows(spark, folder),
        b.meta(spark, folder),
        b.entities(spark, folder),
    )


def _prompt_query(template: str) -> Query:
    def run(spark, folder):
        policy = "plain" if template.startswith("sft") else "append" if "cand" in template else "replace"
        config = LinkConfig("D1", template, template, policy=policy, retrieval_limit=3)
        return _prompts(spark, folder, config, named=("key", "gold"))

    return run


for _template in TEMPLATES:
    if _template != "sft_train":
        QUERIES[f"prompt_{_template}"] = _prompt_query(_template)


@query
def prompt_sft_train(spark, folder):
    return examples.with_text(b.examples(spark, folder)).select("conv_id", "turn", "text")


@query
def runs_expanded(spark, folder):
    return context.expand_runs(b.places(spark, folder).select("group", "key"), 3)


def first_id_answers(before: str = "", echo: bool = False):
    """A stand-in for a model: names the first id of the prompt."""
    import re

    def answer(prompt: str) -> str:
        found = re.search("Q[0-9]+", prompt)
        named = f"{before}<[ID] {found.group()}>" if found else "no idea"
        return prompt + named if echo else named

    return lambda prompts: [answer(p) for p in prompts]


@query
def prompt_budgeted(spark, folder):
    """Prompts of at most 120 words, with as many candidates as fit."""
    config = LinkConfig("D1", "budget", "title_cand_wiki", policy="append", retrieval_limit=3, prompt_budget=120)
    return _prompts(spark, folder, config).select("group", "key", "gold", "prompt")


RUN_CONFIG = LinkConfig("D1", "table", "link_cand_wiki", policy="append", retrieval_limit=3)
MARKED_CONFIG = fine_tuned_config("D1", "tuned", retrieval_limit=3)


def _results(linked):
    length = F.length("prompt") if "prompt" in linked.columns else F.col("prompt_length")
    return linked.select(
        "dataset", "config", "iter", "group", "tableName", "key",
        length.alias("prompt_length"), "output", "gold", "pred",
    )


@query
def link_run(spark, folder):
    prompts = _prompt_parts(spark, folder, RUN_CONFIG)
    return _results(
        pipelines.link(prompts, RUN_CONFIG, first_id_answers, options={"before": "It is "})
    )


@query
def link_run_marked(spark, folder):
    prompts = _prompt_parts(spark, folder, MARKED_CONFIG)
    options = {"before": " \n", "echo": True}
    return _results(pipelines.link(prompts, MARKED_CONFIG, first_id_answers, options=options))


@query
def link_stamped(spark, folder):
    """Result rows carry the time of their run."""
    prompts = _prompt_parts(spark, folder, RUN_CONFIG)
    linked = pipelines.link(prompts, RUN_CONFIG, first_id_answers)
    return linked.select("iter", "group", F.col("processed_at").isNotNull().alias("stamped"))


@query
def link_resume(spark, folder):
    """A run over some tables first, then what it left over."""
    prompts = _prompt_parts(spark, folder, RUN_CONFIG)
    options = {"before": "It is "}
    some = replace(prompts, mentions=mentions.allowed_tables(prompts.mentions, b.allow_tables(spark, folder)))
    first = pipelines.link(some, RUN_CONFIG, first_id_answers, options=options)
    done = context.expand_runs(some.mentions.select("group"), RUN_CONFIG.runs)
    rest = pipelines.link(prompts, RUN_CONFIG, first_id_answers, finished=done, options=options)
    return _results(first.unionByName(rest))


@query
def link_from_store(spark, folder):
    """Every second mention was answered before; its answers come from the store."""
    options, store = {"before": "It is "}, f"{_new_folder(spark)}/answers"
    before = context.expand_runs(_prompts(spark, folder, RUN_CONFIG, "`group` % 2 = 0"), RUN_CONFIG.runs)
    known = F.concat(F.lit("Known: <[ID] "), F.regexp_extract("prompt", "Q[0-9]+", 0), F.lit(">"))
    before.select(
        prompt_digest(F.col("prompt"), "first id", options, F.col("iter")).alias("digest"),
        known.alias("output"), F.current_timestamp().alias("answered_at"),
    ).write.parquet(store)
    linked = pipelines.link_from_store(
        _prompt_parts(spark, folder, RUN_CONFIG), RUN_CONFIG, first_id_answers, store, "first id",
        options=options, calls=Calls(in_flight=2),
    )
    return _results(linked)


@query
def link_logged(spark, folder):
    """A run over some tables, then over all, into one folder with its log."""
    prompts = _prompt_parts(spark, folder, RUN_CONFIG)
    path, options = f"{_new_folder(spark)}/runs", {"before": "It is "}
    some = replace(prompts, mentions=mentions.allowed_tables(prompts.mentions, b.allow_tables(spark, folder)))
    pipelines.run_linking(some, RUN_CONFIG, first_id_answers, path, options=options)
    pipelines.run_linking(prompts, RUN_CONFIG, first_id_answers, path, options=options, calls=Calls())
    return _results(files.read_runs(spark, path, lengths=True))


@query
def parse_answer(spark, folder):
    return b.answered_runs(spark, folder).select("group", "iter", "output", "pred")


@query
def parse_marker(spark, folder):
    """Examples, which hold the marker, and raw turns, which do not."""
    marked = examples.with_text(b.examples(spark, folder)).select("conv_id", "turn", "text")
    raw = b.read(spark, folder, "conversations").select("conv_id", "turn", "text")
    return marked.unionByName(raw).select("conv_id", "turn", after_marker(F.col("text")).alias("answer"))


# --- scores ---------------------------------------------------------------


def _scored(spark, folder, configs=b.CONFIGS[:1]):
    return scoring.score_rows(b.answered_runs(spark, folder, configs))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query
def score_rows(spark, folder):
    return _scored(spark, folder).select("group", "iter", "gold", "pred", "result")


@query
def run_accuracy(spark, folder):
    return _rounded(scoring.run_accuracy(_scored(spark, folder, b.CONFIGS)), "accuracy")


_SCORES = ("accuracy", "f1_all", "f1_non_nil")


@query
def run_weighted_f1(spark, folder):
    return _rounded(scoring.run_scores(_scored(spark, folder, b.CONFIGS)), *_SCORES)


@query
def config_means(spark, folder):
    scores = scoring.run_scores(_scored(spark, folder, b.CONFIGS))
    return _rounded(scoring.config_means(scores), *_SCORES)


@query
def report(spark, folder):
    return scoring.report(scoring.run_scores(_scored(spark, folder, b.CONFIGS)))


@query
def error_rows(spark, folder):
    scored = _scored(spark, folder)
    return scoring.error_rows(scored).select("group", "iter", "output", "gold", "pred")


@query
def error_pairs(spark, folder):
    return scoring.error_pairs(_scored(spark, folder))


@query
def error_counts(spark, folder):
    return scoring.error_counts(_scored(spark, folder, b.CONFIGS))


@query
def confusion(spark, folder):
    return scoring.confusion(_scored(spark, folder), keys=())


@query
def preview_first(spark, folder):
    scored = _scored(spark, folder).select("group", "iter", "gold", "pred")
    return scoring.preview(scored, "group", "iter")


# --- comparisons ----------------------------------------------------------


def _compared(spark, folder, numbers: Sequence[int]):
    return pipelines.compare(b.answered_runs(spark, folder), numbers).drop("result")


@query
def compare_one(spark, folder):
    return _compared(spark, folder, (0,))


@query
def compare_two(spark, folder):
    return _compared(spark, folder, (1, 2))


@query
def compare_three(spark, folder):
    return _compared(spark, folder, (0, 1, 2))


@query
def merge_two(spark, folder):
    return comparing.merge_all(b.answered_runs(spark, folder), (1, 2))


@query
def merge_three(spark, folder):
    return comparing.merge_all(b.answered_runs(spark, folder), (0, 1, 2))


@query
def wrong_mentions(spark, folder):
    return comparing.wrong_mentions(_scored(spark, folder, b.CONFIGS))


@query
def hard_cases(spark, folder):
    return pipelines.mine_hard_cases(b.answered_runs(spark, folder, b.CONFIGS))


@query
def hard_case_count(spark, folder):
    return comparing.hard_case_count(_scored(spark, folder, b.CONFIGS))


# --- examples -------------------------------------------------------------


@query
def sft_examples(spark, folder):
    return b.examples(spark, folder)


def _lengths(spark, folder):
    return [examples.with_length(examples.with_text(s)) for s in b.example_sets(spark, folder)]


@query
def sft_lengths(spark, folder):
    train, validation = _lengths(spark, folder)
    return train.unionByName(validation).select("conv_id", "turn", "length")


@query
def sft_sample_count(spark, folder):
    return examples.sample_count(*_lengths(spark, folder))


@query
def sft_length_hist(spark, folder):
    hist = examples.length_histogram(*_lengths(spark, folder))
    return _rounded(hist, "left_edge", "right_edge")


def _padded(spark, folder, cap):
    text = examples.with_text(b.examples(spark, folder))
    return examples.with_input_ids(text, "<s>", "</s>", cap=cap).select(
        "conv_id",
        "turn",
        F.size("input_ids").alias("n"),
        F.array_join("input_ids", " ").alias("input_ids"),
        (F.col("labels") == F.col("input_ids")).alias("same_labels"),
    )


@query
def sft_padded(spark, folder):
    return _padded(spark, folder, 2875)


@query
def sft_truncated(spark, folder):
    return _padded(spark, folder, 40)


@query
def sft_prepared(spark, folder):
    """Training and validation examples as prepared together."""
    train, validation, _ = pipelines.prepare_examples(*b.example_sets(spark, folder), "<s>", "</s>")
    both = train.withColumn("held_out", F.lit(False)).unionByName(
        validation.withColumn("held_out", F.lit(True))
    )
    return both.select(
        "conv_id", "turn", "held_out",
        F.size("input_ids").alias("n"),
        F.array_join("input_ids", " ").alias("input_ids"),
        (F.col("labels") == F.col("input_ids")).alias("same_labels"),
    )


# --- files ----------------------------------------------------------------
# Inputs are written as files from the driver's tables and read again.


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def _write_csv(df, path):
    df.write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)


def _written_candidates(spark, folder, path):
    rows = b.candidates(spark, folder).orderBy("cand_pos", "group")
    _write_csv(rows.select("tableName", "key", "group", "id", "name", "description", "types", "target"), path)


@query
def candidates_from_files(spark, folder):
    path = _new_folder(spark)
    _written_candidates(spark, folder, path)
    return files.read_candidates(spark, path, multi_line=False)


@query
def meta_from_files(spark, folder):
    path = _new_folder(spark)
    _write_csv(b.meta(spark, folder).orderBy("pos").drop("pos"), path)
    return files.read_table_meta(spark, path, multi_line=False)


@query
def dataset_from_catalogue(spark, folder):
    """Candidates per table and titles of the dataset that a catalogue names."""
    path = _new_folder(spark)
    _written_candidates(spark, folder, f"{path}/candidates.csv")
    _write_csv(b.meta(spark, folder).orderBy("pos").drop("pos"), f"{path}/titles.csv")
    known = catalogue.catalogue(spark, [("D1", "candidates.csv", "titles.csv"), ("D2", "none.csv", "none.csv")])
    rows, titles = catalogue.read_dataset(spark, known, "D1", path, multi_line=False)
    counts = rows.groupBy("tableName").agg(F.count("*").alias("n_candidates"))
    return counts.join(titles.withColumn("tableName", F.trim("tableName")), "tableName", "left").select(
        "tableName", "n_candidates", "title"
    )


@query
def table_list_from_files(spark, folder):
    path = _new_folder(spark)
    _write_csv(b.allow_tables(spark, folder), path)
    return files.read_table_list(spark, path)


@query
def examples_from_files(spark, folder):
    path = _new_folder(spark)
    b.examples(spark, folder).select("question", "answer").write.json(path)
    return files.read_examples(spark, path)


@query
def wide_table_from_file(spark, folder):
    """One CSV file with all parts, read in splits."""
    path = _new_folder(spark)
    part = b.read(spark, folder, "part").orderBy("p_partkey").select("p_partkey", "p_name", "p_brand", "p_size")
    _write_csv(part.coalesce(1), path)
    rows = files.read_wide_table(spark, path, "parts")
    return context.cells_of_rows(rows)


def _table_files(spark, folder, path):
    """A CSV file per table, in a folder of its number."""
    rows = b.rows(spark, folder).select(
        F.regexp_extract("table_name", "[0-9]+", 0).cast("int").alias("t"), "row_no", "p_name", "p_type", "p_size"
    )
    _in_order = rows.repartition("t").sortWithinPartitions("t", "row_no").drop("row_no")
    _in_order.write.option("header", True).partitionBy("t").csv(path)


def _numbered_cells(rows):
    number = F.regexp_extract("table_name", "t=([0-9]+)/", 1).cast("int")
    return context.cells_of_rows(rows).select(number.alias("t"), "row_no", "col_no", "col_name", "value")


@query
def tables_from_files(spark, folder):
    path = _new_folder(spark)
    _table_files(spark, folder, path)
    return _numbered_cells(files.read_tables(spark, path, folders=True))


@query
def named_tables_from_files(spark, folder):
    """Only the files of tables with a part of the largest size are opened."""
    path = _new_folder(spark)
    _table_files(spark, folder, path)
    largest = b.rows(spark, folder).where(F.col("p_size") == 50)
    numbers = largest.select(F.regexp_extract("table_name", "[0-9]+", 0).alias("t"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    name = F.regexp_extract("path", r"([^/]+/[^/]+)\.csv$", 1)
    names = listed.select(name.alias("table_name"), F.regexp_extract("path", "/t=([0-9]+)/", 1).alias("t"))
    wanted = names.join(numbers, "t").select("table_name")
    return _numbered_cells(files.read_named_tables(spark, path, wanted, folders=True))


def _run_rows(spark, folder, configs=b.CONFIGS[:1]):
    named = b.places(spark, folder).select("group", F.col("table_name").alias("tableName"), "key")
    prompt = F.concat(F.lit('which of "'), F.col("group").cast("string"), F.lit('"?')).alias("prompt")
    return b.answered_runs(spark, folder, configs).join(named, "group").select(
        "dataset", "config", "iter", "tableName", "key", "group", prompt, "output", "gold", "pred"
    )


@query
def run_from_file(spark, folder):
    """One run as a CSV file in group order."""
    path = _new_folder(spark)
    sinks.write_run_file(_run_rows(spark, folder).where(F.col("iter") == 1), path)
    return files.read_run_file(spark, path, "D1", "table", 1, multi_line=False)


@query
def run_file_order(spark, folder):
    path = _new_folder(spark)
    sinks.write_run_file(_run_rows(spark, folder).where(F.col("iter") == 1), path)
    lines = spark.read.schema(schemas.RUN_FILE).option("header", True).option("escape", '"').csv(path)
    return files.numbered_rows(lines, "pos", per_file=False).select("pos", "group")


@query
def runs_from_folders(spark, folder):
    path = _new_folder(spark)
    for config in b.CONFIGS:
        sinks.write_runs(_run_rows(spark, folder, (config,)), path)
    return files.read_runs(spark, path).select("dataset", "config", "iter", "group", "prompt", "output", "gold", "pred")


@query
def scored_from_files(spark, folder):
    path = _new_folder(spark)
    sinks.write_scored(_scored(spark, folder), path)
    return spark.read.parquet(path).select("group", "iter", "gold", "pred", "result")


@query
def sheet_from_file(spark, folder):
    path = f"{_new_folder(spark)}/sheet"
    columns = pipelines.compare(b.answered_runs(spark, folder), (0, 1, 2), path).schema
    return spark.read.schema(columns).option("header", True).option("escape", '"').csv(path).drop("result")


@query
def groups_from_file(spark, folder):
    """Group list, one per line, with the number of its line."""
    path = f"{_new_folder(spark)}/groups"
    pipelines.mine_hard_cases(b.answered_runs(spark, folder, b.CONFIGS), path)
    lines = files.numbered_rows(spark.read.text(path), "pos", per_file=False)
    return lines.select("pos", F.col("value").cast("bigint").alias("group"))


@query
def running_scores(spark, folder):
    """Scores counted run by run, the first run's results a second time at the end."""
    state = RunningScores(spark, _new_folder(spark))
    rows = b.answered_runs(spark, folder)
    for batch, run in enumerate((2, 0, 1, 2)):
        state.add(rows.where(F.col("iter") == run), batch)
    return _rounded(state.scores(), *_SCORES)
