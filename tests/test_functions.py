from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink.config import LinkConfig
from tablelink.functions.answers import after_marker, answered_id, entity_id, is_correct
from tablelink.functions.keys import dash_key_parts, key_parts
from tablelink.functions.prompts import TEMPLATES, render, template_fields
from tablelink.functions.text import json_text, row_text, strip
from tablelink.operators.candidates import candidate_text


def one(spark, schema, rows, column):
    df = spark.createDataFrame(list(enumerate(rows)), f"n int, {schema}")
    return [row[0] for row in df.orderBy("n").select(column.alias("out")).collect()]


@pytest.mark.parametrize("key,expected", [
    (" T 3 0 ", ("T", 3, 0)),
    ("T\t 3\n0", ("T", 3, 0)),
    (" T 3 0 ", ("T", 3, 0)),
    ("Ts/+ 3 0", ("T", 3, 0)),
    ("T x 0", ("T", None, 0)),
    ("T", ("T", None, None)),
    (None, (None, None, None)),
])
def test_key_parts(spark, key, expected):
    table, row, col = key_parts(F.col("key"))
    df = spark.createDataFrame([(key,)], "key string").select(table, row, col)
    assert tuple(df.first()) == expected


@pytest.mark.parametrize("key,expected", [
    ("T-a-3-1", ("T-a", 3, 1)),
    ("T-3-1", ("T", 3, 1)),
    ("T-3", (None, None, None)),
    ("T-x-1", (None, None, None)),
])
def test_dash_key_parts(spark, key, expected):
    table, row, col = dash_key_parts(F.col("key"))
    assert tuple(spark.createDataFrame([(key,)], "key string").select(table, row, col).first()) == expected


def test_strip_matches_python(spark):
    texts = [chr(code) + "a b" + chr(code) for code in range(1, 0x3002) if not 0xD800 <= code < 0xE000]
    assert one(spark, "x string", texts, strip(F.col("x"))) == [t.strip() for t in texts]


def test_json_text_matches_python(spark):
    texts = [
        "", "plain", 'a "quoted" text', "back\\slash", "line\nbreak\ttab\rret\b\f", "é", "日本", "😀 and 𝒳",
        "\x7f del", "\x01\x1f", " ", "é", "Result Q1:\nLabel: x",
    ]
    assert one(spark, "x string", texts, json_text(F.col("x"))) == [json.dumps(t) for t in texts]


def test_answered_id(spark):
    answers = ["Q3 then <Q9>", "Q7 only", "FAQ22>", "none", None, "<Q>", "Q5> Q6>", "[Q12>]"]
    assert one(spark, "x string", answers, answered_id(F.col("x"))) == [
        "Q9", "Q7", "Q22", "0", "0", "0", "Q5", "Q12",
    ]


def test_entity_id(spark):
    texts = ["Q12", "http://x/Q7 and Q8", "none", None]
    assert one(spark, "x string", texts, entity_id(F.col("x"))) == ["Q12", "Q7", "0", "0"]


def test_after_marker(spark):
    texts = ["a ### Answer: b\n### Answer: c \n", "### Answer:", "none", "x### Answer:\t é "]
    assert one(spark, "x string", texts, after_marker(F.col("x"))) == [
        "b\n### Answer: c", "", "Marker not found in the string.", "é",
    ]


def test_is_correct(spark):
    df = spark.createDataFrame(
        [("Q1", " Q1 "), ("Q1", "Q2"), (None, "Q1"), ("Q1", None), (None, None), ("0", "0")],
        "gold string, pred string",
    )
    got = [r[0] for r in df.select(is_correct(F.col("gold"), F.col("pred"))).collect()]
    assert got == [1, 0, 0, 0, 0, 1]


def test_row_text_spacing(spark):
    df = spark.createDataFrame(
        [(1, ["col0", "col1"], ["a", "0.07063"]), (2, ["h"], [None])],
        "row_no bigint, col_names array<string>, cells array<string>",
    )
    assert [r[0] for r in df.select(row_text(F.col("row_no"), F.col("col_names"), F.col("cells"))).collect()] == [
        "col: | col0 | col1 |   row 1: | a | 0.07063 |  ",
        "col: | h |   row 2: | nan |  ",
    ]


def test_candidate_layouts(spark):
    df = spark.createDataFrame(
        [
            (1, "Q1", 'the "one"', None, '[{"id": "Q839954", "name": "archaeological site"}]'),
            (2, "Q2", None, 'a "d"', "[]"),
        ],
        "n int, id string, name string, description string, types string",
    ).orderBy("n")
    assert [r[0] for r in df.select(candidate_text("tagged")).collect()] == [
        "<[ID] Q1 the 'one' [DESCRIPTION] nan [TYPE] [{'id': 'Q839954', 'name': 'archaeological site'}]>,",
        "<[ID] Q2 nan [DESCRIPTION] a 'd' [TYPE] None>,",
    ]
    assert [r[0] for r in df.select(candidate_text("pipe")).collect()] == [
        "Q1 | the 'one' | nan | [{id: Q839954, name: archaeological site}],",
        "Q2 | nan | a 'd' | [],",
    ]


def test_rendered_id_is_read_back(spark):
    df = spark.createDataFrame(
        [("Q77", "x", "about Q5", "[]")], "id string, name string, description string, types string"
    )
    assert df.select(answered_id(candidate_text())).first()[0] == "Q77"


def test_templates(spark):
    fields = {
        "title": "T", "summary": "S", "row": "R", "cand": "C", "wiki": "W", "mention": None,
        "question": "q", "answer": "a",
    }
    df = spark.createDataFrame([tuple(fields.values())], ", ".join(f"{f} string" for f in fields))
    for name, text in TEMPLATES.items():
        rendered = df.select(render(text, {f: F.col(f) for f in fields})).first()[0]
        expected = text
        for field, value in fields.items():
            expected = expected.replace("{" + field + "}", "nan" if value is None else value)
        assert rendered == expected, name
    assert df.select(render(TEMPLATES["sft_train"], {f: F.col(f) for f in fields})).first()[0] == (
        "### Question: q\n ### Answer: a"
    )


def test_template_inputs():
    used = {name: template_fields(text) for name, text in TEMPLATES.items()}
    assert used == {
        "link_wiki": {"mention", "row", "wiki"},
        "link_cand_wiki": {"mention", "row", "cand", "wiki"},
        "title_wiki": {"title", "summary", "row", "wiki", "mention"},
        "title_cand_wiki": {"title", "summary", "row", "cand", "wiki", "mention"},
        "title_cand_idonly": {"title", "summary", "row", "cand", "mention"},
        "title_wiki_idonly": {"title", "summary", "row", "wiki", "mention"},
        "title_cand_wiki_what": {"title", "summary", "row", "cand", "wiki", "mention"},
        "sft_infer": {"title", "summary", "row", "cand", "wiki", "mention"},
        "sft_train": {"question", "answer"},
    }
    assert TEMPLATES["sft_infer"].startswith("### Question: ")
    assert TEMPLATES["sft_infer"].endswith(" ### Answer:")


@pytest.mark.parametrize("options", [
    {"policy": "other"}, {"layout": "other"}, {"guard": "other"}, {"runs": 0}, {"template": "other"},
])
def test_config_checks(options):
    with pytest.raises(ValueError):
        LinkConfig("D", "c", **options)
