"""Schemas of the tables that go in and out."""

from __future__ import annotations

# One row per (mention, candidate). `pos` is the order inside the mention.
CANDIDATES_FILE = (
    "tableName STRING, key STRING, `group` BIGINT, id STRING, name STRING, "
    "description STRING, types STRING, target INT"
)
CANDIDATES = CANDIDATES_FILE + ", cand_pos BIGINT"

# Table corpus: one row per table row, or in long form one row per cell.
TABLE_ROWS = "table_name STRING, row_no BIGINT, col_names ARRAY<STRING>, cells ARRAY<STRING>"
CELLS = "table_name STRING, row_no BIGINT, col_no INT, col_name STRING, value STRING"

TABLE_META_FILE = "tableName STRING, title STRING, summary STRING"
ALLOW_LIST = "dataset STRING, key STRING"
CATALOGUE = "dataset STRING, candidates_file STRING, title_file STRING"
ENTITIES = "id STRING, label STRING, description STRING, types STRING, rank BIGINT"

# Results of a run. The CSV form keeps the two spaced column names.
RUN_FILE = (
    "tableName STRING, key STRING, `group` BIGINT, prompt STRING, output STRING, "
    "`correct QID` STRING, `output QID` STRING"
)
RUNS = (
    "dataset STRING, config STRING, iter INT, tableName STRING, key STRING, "
    "`group` BIGINT, prompt STRING, output STRING, gold STRING, pred STRING"
)
# Prompts in pieces, beside results that hold their lengths.
RUN_PROMPTS = (
    "dataset STRING, config STRING, `group` BIGINT, runs ARRAY<INT>, piece INT, text STRING, asked_at TIMESTAMP"
)

EXAMPLES = "question STRING, answer STRING"
