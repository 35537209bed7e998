from __future__ import annotations

import pytest

from table_values import values
from tablelink import schemas
from tablelink.operators.context import (
    attach_metadata,
    attach_rows,
    cells_of_rows,
    constant_metadata,
    expand_runs,
    lookup_cells,
    missing_metadata,
    missing_metadata_running,
    rows_of_cells,
)


@pytest.fixture
def table_rows(spark):
    return spark.createDataFrame(
        [("T", 1, ["a", "b"], ["x", None]), ("T", 2, ["a", "b"], ["y", "2"])], schemas.TABLE_ROWS
    )


@pytest.fixture
def mentions(spark):
    places = [(1, "T", 1, 0), (2, "T", 1, 1), (3, "T", 0, 0), (4, "T", 99, 0), (5, "T", 2, 2),
              (6, "U", 1, 0), (7, "T", None, 0), (8, "T", 2, -1)]
    return spark.createDataFrame(places, "group bigint, table_name string, row_no bigint, col_no int")


EXPECTED = [
    (1, "x", "a", False), (2, None, "b", False), (3, None, None, True), (4, None, None, True),
    (5, None, None, True), (6, None, None, True), (7, None, None, True), (8, None, None, True),
]


def test_rows_and_cells_agree(mentions, table_rows):
    columns = ("group", "mention", "col_name", "cell_missing")
    assert values(attach_rows(mentions, table_rows), *columns) == EXPECTED
    assert values(lookup_cells(mentions, cells_of_rows(table_rows)), *columns) == EXPECTED


def test_row_text_and_missing_rows(mentions, table_rows):
    text = {r["group"]: r["row"] for r in attach_rows(mentions, table_rows).collect()}
    assert text[1] == "col: | a | b |   row 1: | x | nan |  "
    assert text[5] == "col: | a | b |   row 2: | y | 2 |  "
    assert text[3] is None and text[4] is None


def test_long_and_row_form_round_trip(table_rows):
    again = rows_of_cells(cells_of_rows(table_rows).repartition(3, "value"))
    assert values(again) == values(table_rows)


def test_metadata(spark):
    meta = spark.createDataFrame(
        [(" T ", "second", "s2", 2), ("T", "first", "s1", 1), ("N", None, "s", 1)],
        "tableName string, title string, summary string, pos bigint",
    )
    mentions = spark.createDataFrame([(1, "T"), (2, "N"), (3, "X")], "group bigint, table_name string")
    joined = attach_metadata(mentions, meta, "pos")
    assert values(joined, "group", "title", "summary", "has_meta") == [
        (1, "first", "s1", True), (2, None, "s", True), (3, "None", "None", False),
    ]
    runs = expand_runs(joined, 2)
    assert values(missing_metadata(runs), "iter", "missing") == [(0, 1), (1, 1)]
    running = missing_metadata_running(joined, 2)
    assert values(running, "iter", "group", "missing_so_far") == [
        (0, 1, 0), (0, 2, 0), (0, 3, 1), (1, 1, 0), (1, 2, 0), (1, 3, 1),
    ]
    fixed = constant_metadata(mentions, "t", "s")
    assert values(fixed, "title", "summary") == [("t", "s")] * 3
