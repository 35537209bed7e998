"""Readers of the input files."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelink import schemas
from tablelink.functions.formats import NA_TOKENS
from tablelink.operators.joins import many_to_one
from tablelink.operators.ordered import running_total

_ROWS_PER_BATCH = 10_000
# Files have fewer than 2^39 lines; a window holds at most a million of them.
_LINES = {"run_bits": 20, "order_bits": 40}
# Table files up to this size are parsed by one task each, larger ones in splits.
WHOLE_FILE_BYTES = 64 * 1024 * 1024


def _csv(spark: SparkSession, schema: str, path: str, multi_line: bool) -> DataFrame:
    """A CSV scan with doubled quotes. Files with line breaks inside quotes need
    multi_line=True, which reads a file in one task; others are split."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", multi_line)
        .option("escape", '"')
        .csv(path)
    )


def without_missing_marks(df: DataFrame, *keep: str) -> DataFrame:
    """Text columns with the marks of missing values as null, those of `keep` excepted."""
    texts = [name for name, kind in df.dtypes if kind == "string" and name not in keep]
    marks = list(NA_TOKENS)
    return df.withColumns(
        {name: F.when(~F.col(f"`{name}`").isin(marks), F.col(f"`{name}`")) for name in texts}
    )


def numbered_rows(scan: DataFrame, out: str, per_file: bool = True) -> DataFrame:
    """Add the 1-based row number inside each file, or over all files in the order of
    their paths.

    Rows are counted per split in a first pass; the join then matches each row
    with the one small record of its split.
    """
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_n"),
    )
    order = Window.partitionBy("_file").orderBy("_split") if per_file else Window.orderBy("_file", "_split")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    splits = (
        tagged.groupBy("_file", "_split")
        .agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
        .select(
            "_file",
            "_split",
            "_first",
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        )
    )
    return (
        tagged.join(splits, ["_file", "_split"])
        .withColumn(out, F.col("_before") + F.col("_n") - F.col("_first") + 1)
        .drop("_file", "_split", "_n", "_first", "_before")
    )


def read_candidates(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Mention-candidate files; `cand_pos` counts the rows of all files, in the order of
    their paths. Marks of missing values are null."""
    scan = _csv(spark, schemas.CANDIDATES_FILE, path, multi_line)
    return without_missing_marks(numbered_rows(scan, "cand_pos", per_file=False))


def read_table_meta(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Titles and summaries; `pos` counts the rows of all files, in the order of their
    paths. Marks of missing values are null."""
    scan = _csv(spark, schemas.TABLE_META_FILE, path, multi_line)
    return without_missing_marks(numbered_rows(scan, "pos", per_file=False))


def read_allow_list(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """JSON documents {dataset: [key, ...]} to (dataset, key); several files add up."""
    keys = allow_list_rows(spark.read.text(path, wholetext=True))
    return keys if dataset is None else keys.where(F.col("dataset") == dataset)


def read_allow_rows(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """(dataset, key) stored as JSON lines, for lists too long for one document."""
    keys = spark.read.schema(schemas.ALLOW_LIST).json(path)
    return keys if dataset is None else keys.where(F.col("dataset") == dataset)


def allow_list_rows(documents: DataFrame) -> DataFrame:
    """(dataset, key) from the column `value` of JSON documents."""
    parsed = F.from_json("value", "map<string,array<string>>")
    return documents.select(F.explode(parsed).alias("dataset", "_keys")).select(
        "dataset", F.explode("_keys").alias("key")
    )


def read_table_list(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The distinct values of the first column of a CSV file."""
    scan = spark.read.option("header", header).option("escape", '"').csv(path)
    return scan.select(F.col(f"`{scan.columns[0]}`").alias("tableName")).distinct()


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Question/answer pairs, one JSON object per line."""
    return spark.read.schema(schemas.EXAMPLES).json(path)


def read_run_file(
    spark: SparkSession, path: str, dataset: str, config: str, run: int, multi_line: bool = True
) -> DataFrame:
    """One run stored as CSV. All columns are kept as written: ids are read as text, also
    if all of them are 0, and prompts and answers may hold any word."""
    return _csv(spark, schemas.RUN_FILE, path, multi_line).select(
        F.lit(dataset).alias("dataset"),
        F.lit(config).alias("config"),
        F.lit(run).alias("iter"),
        "tableName", "key", "group", "prompt", "output",
        F.col("`correct QID`").alias("gold"),
        F.col("`output QID`").alias("pred"),
    )


def read_run_files(
    spark: SparkSession,
    files: Iterable[tuple[str, str, str, int]],
    datasets: Iterable[str] | None = None,
    multi_line: bool = True,
) -> DataFrame:
    """Many run files as one table: (path, dataset, config, run) each. With `datasets`,
    a name that is not among them is an error before anything is read."""
    files = list(files)
    known = None if datasets is None else set(datasets)
    unknown = sorted({dataset for _, dataset, _, _ in files if known is not None and dataset not in known})
    if unknown:
        raise ValueError(f"unknown datasets: {', '.join(unknown)}")
    if not files:
        return spark.createDataFrame([], schemas.RUNS)
    parts = (
        read_run_file(spark, path, dataset, config, run, multi_line)
        for path, dataset, config, run in files
    )
    return reduce(DataFrame.unionByName, parts)


def read_runs(spark: SparkSession, path: str, lengths: bool = False) -> DataFrame:
    """Results as written by write_runs; filters on dataset, config and iter prune. With
    `lengths` they have `prompt_length`, which results of prompts in parts hold, and no prompt."""
    if not lengths:
        return spark.read.schema(schemas.RUNS + ", processed_at TIMESTAMP").parquet(path)
    runs = spark.read.schema(schemas.RUNS + ", prompt_length INT, processed_at TIMESTAMP").parquet(path)
    return runs.withColumn("prompt_length", F.coalesce("prompt_length", F.length("prompt"))).drop("prompt")


def read_run_prompts(spark: SparkSession, path: str) -> DataFrame:
    """The prompts of results that hold their lengths, in pieces: dataset, config, iter, group,
    piece (from 1), text. Where a run was asked again, those of the last time."""
    of = ["dataset", "config", "iter", "group"]
    asked = spark.read.schema(schemas.RUN_PROMPTS).parquet(f"{path.rstrip('/')}-prompts")
    rows = asked.withColumn("iter", F.explode("runs")).drop("runs")
    last = rows.where(F.col("piece") == 1).groupBy(*of).agg(F.max("asked_at").alias("asked_at"))
    return many_to_one(rows, last, [*of, "asked_at"], "left_semi").select(*of, "piece", "text")


def column_names(header: list[str]) -> list[str]:
    """Header names made unique: empty ones numbered, repeats given a suffix."""
    seen: dict[str, int] = {}
    names = []
    for place, raw in enumerate(header):
        name = raw or f"Unnamed: {place}"
        again = seen.get(name, 0)
        seen[name] = again + 1
        names.append(f"{name}.{again}" if again else name)
    return names


def _shown(names: list[str], row: list[str]) -> tuple[list[str], list[str | None]]:
    """Column names and cells of a row: cells beyond the header get names too, and
    cells that are not there, or marks of missing values, are null."""
    wide = names + [f"Unnamed: {place}" for place in range(len(names), len(row))]
    cells = [None if cell in NA_TOKENS else cell for cell in row]
    return wide, cells + [None] * (len(wide) - len(row))


def _records(name: str, content: bytes) -> Iterator[tuple]:
    lines = (row for row in csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")) if row)
    names = column_names(next(lines, []))
    for row_no, row in enumerate(lines, 1):
        yield name, row_no, *_shown(names, row)


def _frames(rows: Iterable[tuple]) -> Iterator[pd.DataFrame]:
    rows = iter(rows)
    while ready := list(islice(rows, _ROWS_PER_BATCH)):
        yield pd.DataFrame(ready, columns=["table_name", "row_no", "col_names", "cells"])


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(2**31 - 1)
    yield from _frames(
        record
        for batch in batches
        for name, content in zip(batch["table_name"], batch["content"], strict=True)
        for record in _records(name, content)
    )


def parse_tables(files: DataFrame) -> DataFrame:
    """(table_name, content) with the bytes of CSV files to table rows."""
    return files.select("table_name", "content").mapInPandas(_parse, schemas.TABLE_ROWS)


def _parse_lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    csv.field_size_limit(2**31 - 1)

    def fields(text: str) -> list[str]:
        found = list(csv.reader(io.StringIO(text, newline="")))
        if len(found) != 1:
            raise ValueError(f"{len(found)} rows in one record: {text[:200]!r}")
        return found[0]

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for name, row_no, header, text in zip(
                batch["table_name"], batch["row_no"], batch["header"], batch["text"], strict=True
            ):
                yield name, row_no, *_shown(column_names(fields(header)), fields(text))

    yield from _frames(rows())


_ENDS = "from_outside boolean, from_inside boolean"


def _leaves_open(text: str) -> bool:
    """Whether a record is still inside a quoted cell after these characters."""
    return len(list(csv.reader([text, "."]))) == 1


def _quoting(values: pd.Series) -> pd.DataFrame:
    """Whether a line ends inside a quoted cell, if it begins outside and inside of one."""
    csv.field_size_limit(2**31 - 1)
    made = [
        (_leaves_open(value), _leaves_open('"' + value)) if '"' in value else (False, True) for value in values
    ]
    return pd.DataFrame(made, columns=["from_outside", "from_inside"])


def _split_tables(lines: DataFrame) -> DataFrame:
    """Table rows of CSV files given by their lines: path, table_name, line_no, value
    with the line's end.

    Where a line ends, inside or outside of a quoted cell, depends on where it begins,
    and csv says so for both. Lines that end alike from either begin a segment; inside
    it the running count of lines that change sides gives each line's end. Lines that
    end outside end a row, and their running count numbers the rows. All is counted in
    runs, so a file of any size is spread over many tasks, and only the lines of one row
    meet.
    """
    value = F.when(F.col("line_no") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    known = lines.withColumn("value", value).withColumn("_ends", F.pandas_udf(_quoting, _ENDS)("value"))
    outside, inside = F.col("_ends.from_outside"), F.col("_ends.from_inside")
    known = known.withColumns({"_fixed": (outside == inside).cast("bigint"), "_odd": outside.cast("bigint")})
    segments = running_total(
        known.drop("_ends"), F.col("_fixed"), keys=["path"], order="line_no", out="_segment", **_LINES
    )
    counted = running_total(
        segments, F.col("_odd"), keys=["path", "_segment"], order="line_no", out="_upto", **_LINES
    )
    closed = F.col("_upto") % 2 == 0
    # A line without characters begins where it ends.
    ends = closed & (F.regexp_replace("value", r"[\r\n]+\z", "") != "")
    numbered = running_total(
        counted.withColumn("_last", ends.cast("bigint")).where(ends | ~closed),
        F.col("_last"), keys=["path"], order="line_no", out="_row", **_LINES,
    )
    text = F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.struct("line_no", "value"))), lambda line: line["value"]
        ),
        "",
    )
    row_no = F.col("_row") - F.col("_last")
    records = numbered.groupBy("path", "table_name", row_no.alias("row_no")).agg(text.alias("text"))
    headers = records.where(F.col("row_no") == 0).select("path", F.col("text").alias("header"))
    joined = many_to_one(records.where(F.col("row_no") > 0), headers, ["path"], "inner")
    return joined.select("table_name", "row_no", "header", "text").mapInPandas(
        _parse_lines, schemas.TABLE_ROWS
    )


def _named(path: Column, folders: bool) -> Column:
    """The table's name: that of its file, with the folders below the path if asked."""
    name = F.regexp_extract(path, r"([^/]+)\.csv$", 1)
    return F.regexp_extract(path, r"([^/]+/[^/]+)\.csv$", 1) if folders else name


def read_tables(
    spark: SparkSession, path: str, whole_bytes: int = WHOLE_FILE_BYTES, folders: bool = False
) -> DataFrame:
    """CSV files, one per table, to table rows in file order.

    Headers may differ and cells may hold line breaks. Files of up to `whole_bytes` are
    parsed by one task each; larger ones are read in splits, with equal rows. With
    `folders` a table is named by its folder and file, for file names that repeat.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    small = files.where(F.col("length") <= whole_bytes).select(
        _named(F.col("path"), folders).alias("table_name"), "content"
    )
    large = [r["path"] for r in files.where(F.col("length") > whole_bytes).select("path").toLocalIterator()]
    tables = parse_tables(small)
    return tables.unionByName(_read_lines(spark, large, folders)) if large else tables


def read_named_tables(
    spark: SparkSession,
    path: str,
    names: DataFrame,
    whole_bytes: int = WHOLE_FILE_BYTES,
    folders: bool = False,
    paths_per_scan: int = 20_000,
) -> DataFrame:
    """The tables that `names` (column table_name, repeats allowed) names, as
    `read_tables` gives them. Other files are listed but never opened.

    Files are matched by a join of the listing, without content, with the different
    names. The paths that are left come to the driver `paths_per_scan` at a time, each
    time for one scan in which Spark packs small files by their bytes. The driver lists
    every file below `path` for any scan, so this adds no more than it holds anyway.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    wanted = (
        listed.select("path", "length", _named(F.col("path"), folders).alias("table_name"))
        .join(names.select("table_name").distinct(), "table_name", "left_semi")
        .select("path", F.col("length") <= whole_bytes)
    )
    parts: list[DataFrame] = []
    found = wanted.toLocalIterator()
    while chunk := list(islice(found, paths_per_scan)):
        small, large = ([row[0] for row in chunk if row[1] == kind] for kind in (True, False))
        if small:
            files = spark.read.format("binaryFile").load(small)
            parts.append(parse_tables(files.select(_named(F.col("path"), folders).alias("table_name"), "content")))
        if large:
            parts.append(_read_lines(spark, large, folders))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schemas.TABLE_ROWS)


def _read_lines(
    spark: SparkSession, paths: list[str], folders: bool = False, name: str | None = None
) -> DataFrame:
    scan = spark.read.option("lineSep", "\n").text(paths).select("value", "_metadata")
    path = F.col("_metadata.file_path").alias("path")
    table = (_named(path, folders) if name is None else F.lit(name)).alias("table_name")
    # A carriage return alone ends a line, too; it stays with the line, as in a quoted cell.
    parts = F.split("value", r"(?<=\r)(?!\z)")
    pieces = scan.select("_metadata", path, table, F.size(parts).alias("_of"), F.posexplode(parts).alias("_at", "value"))
    lines = numbered_rows(pieces, "line_no").drop("_metadata")
    # Only the last line of a file may have no end; bytes that are no line's are a BOM.
    sizes = scan.groupBy(path).agg(
        (F.sum(F.octet_length("value") + 1) - F.max("_metadata.file_size")).alias("_over")
    )
    counts = lines.groupBy("path").agg(F.max("line_no").alias("_lines")).join(sizes, "path")
    bare = F.col("_lines").eqNullSafe(F.col("line_no")) & F.col("_over").isin(1, -2)
    end = F.when((F.col("_at") + 1 < F.col("_of")) | bare, "").otherwise("\n")
    ended = many_to_one(lines, counts, ["path"], "inner").withColumn("value", F.concat("value", end))
    return _split_tables(ended.select("path", "table_name", "line_no", "value"))


def read_wide_table(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    """One CSV table of any size, read in splits, to the rows that read_tables gives,
    under a given name."""
    return _read_lines(spark, [path], name=table_name)
