from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from table_values import values
from tablelink import schemas
from tablelink.operators.context import cells_of_rows
from tablelink.operators.mentions import mention_table
from tablelink.operators.scoring import run_scores, score_rows
from tablelink.sources import files, sinks
from tablelink.sources.catalogue import KNOWN, catalogue, read_dataset, resolve


def test_candidates_file(spark, tmp_path):
    path = tmp_path / "c.csv"
    path.write_text(
        "tableName,key,group,id,name,description,types,target\n"
        'T,T 1 0,7,Q2,"a, ""b""","two\nlines","[{""id"": ""Q1""}]",0\n'
        "T,T 1 0,7,Q3,x,,[],1\n"
        "T,T 1 0,,Q4,x,,[],1\n"
    )
    df = files.read_candidates(spark, str(path))
    rows = df.orderBy("cand_pos").collect()
    assert [r["id"] for r in rows] == ["Q2", "Q3", "Q4"]
    assert rows[0]["name"] == 'a, "b"' and rows[0]["description"] == "two\nlines"
    assert rows[0]["types"] == '[{"id": "Q1"}]' and rows[1]["description"] is None
    assert values(mention_table(df), "group", "gold", "n_candidates") == [(7, "Q3", 2)]


def small_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


@pytest.fixture
def splits(spark):
    small_splits(spark, 512)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_file_order_over_splits(spark, tmp_path, splits):
    for name, n in (("a", 700), ("b", 40)):
        (tmp_path / f"{name}.csv").write_text(
            "tableName,title,summary\n" + "".join(f"{name}{i},t,\n" for i in range(n))
        )
    df = files.read_table_meta(spark, str(tmp_path), multi_line=False)
    assert df.rdd.getNumPartitions() > 8
    for name, n in (("a", 700), ("b", 40)):
        part = df.where(F.col("tableName").startswith(name)).orderBy("pos")
        assert [r["tableName"] for r in part.collect()] == [f"{name}{i}" for i in range(n)]


def test_wide_table_rows_over_splits(spark, tmp_path, splits):
    path = tmp_path / "wide.csv"
    path.write_text(
        "buyer,aug_url\n" + "".join(f"b{i},{'NA' if i % 5 == 0 else f'u{i}'}\n" for i in range(900))
    )
    rows = files.read_wide_table(spark, str(path), "sn").orderBy("row_no").collect()
    assert [r["row_no"] for r in rows] == list(range(1, 901))
    assert [r["cells"] for r in rows] == [
        [f"b{i}", None if i % 5 == 0 else f"u{i}"] for i in range(900)
    ]
    assert rows[0]["table_name"] == "sn" and rows[0]["col_names"] == ["buyer", "aug_url"]


def test_table_corpus(spark, tmp_path):
    (tmp_path / "one table+x%.csv").write_text('a,b\n"line\nbreak",007\n\n,None\nlast\n')
    (tmp_path / "two.csv").write_text("﻿a,a,,b\n1,2,3,4,5\n", encoding="utf-8")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "notes.txt").write_text("a,b\n")
    rows = files.read_tables(spark, str(tmp_path))
    assert values(rows) == sorted([
        ("one table+x%", 1, ["a", "b"], ["line\nbreak", "007"]),
        ("one table+x%", 2, ["a", "b"], [None, None]),
        ("one table+x%", 3, ["a", "b"], ["last", None]),
        ("two", 1, ["a", "a.1", "Unnamed: 2", "b", "Unnamed: 4"], ["1", "2", "3", "4", "5"]),
    ], key=repr)
    assert cells_of_rows(rows).count() == 11


TABLE = (
    "\ufeffid,ID,,a,a\r\n"
    + "".join(f'{i},"x ""{i}""",NA,"two\r\nlines {i}",5,more {i}\r\n' if i % 3 else f"{i},,\n\n" for i in range(400))
    + '"a\n\nb",None,"\n",last'
)


def test_one_answer_for_every_file_size(spark, tmp_path, splits):
    """Whole files and lines in many splits give equal rows."""
    (tmp_path / "t.csv").write_text(TABLE, encoding="utf-8", newline="")
    (tmp_path / "u.csv").write_text("only,header\n")
    whole = values(files.read_tables(spark, str(tmp_path)))
    assert len(whole) == 401 and whole[0][2][:5] == ["id", "ID", "Unnamed: 2", "a", "a.1"]
    assert values(files.read_tables(spark, str(tmp_path), whole_bytes=10)) == whole
    assert values(files.read_wide_table(spark, str(tmp_path / "t.csv"), "t")) == whole


def test_quotes_inside_cells_in_splits(spark, tmp_path, splits):
    """A quote opens a cell only at its start, also in files read in splits."""
    texts = [
        'size,name\n1,5" pipe,x\n2,rod,y\n3,6" bolt,z\n',
        'size,name\n1,5" pipe\n' + "".join(f"{i},rod\n" for i in range(300)),
        'a,b\n"x"y"z,1\n"open"" still\n5" in it",2\n,"3\n',
        "a,b\r1,2\r\n\"3\r4\",5\r",
    ]
    dice = random.Random(5)
    texts += ["h\n" + "".join(dice.choices('",\n\ra', (6, 3, 3, 1, 4), k=60)) for _ in range(12)]
    for at, text in enumerate(texts):
        (tmp_path / f"{at}.csv").write_text(text, newline="")
    whole = values(files.read_tables(spark, str(tmp_path)))
    assert [r[3] for r in whole if r[0] == "0"] == [["1", '5" pipe', "x"], ["2", "rod", "y"], ["3", '6" bolt', "z"]]
    assert values(files.read_tables(spark, str(tmp_path), whole_bytes=0)) == whole


def test_tables_of_one_name_in_two_folders(spark, tmp_path):
    for folder in "ab":
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "t.csv").write_text(f"h\n{folder}\n")
    for size in (0, 1000):
        found = files.read_tables(spark, f"{tmp_path}/*", whole_bytes=size, folders=True)
        assert values(found, "table_name", "cells") == [("a/t", ["a"]), ("b/t", ["b"])]


def test_missing_marks_and_order_over_files(spark, tmp_path):
    for name, ids in (("2", ("Q3", "Q4")), ("1", ("Q1", "Q2"))):
        (tmp_path / f"{name}.csv").write_text(
            "tableName,key,group,id,name,description,types,target\n"
            + "".join(f"T,T 1 0,7,{i},NA,None,[],0\n" for i in ids)
        )
    rows = files.read_candidates(spark, str(tmp_path)).orderBy("cand_pos").collect()
    assert [(r["cand_pos"], r["id"]) for r in rows] == [(1, "Q1"), (2, "Q2"), (3, "Q3"), (4, "Q4")]
    assert {(r["name"], r["description"]) for r in rows} == {(None, None)}
    (tmp_path / "titles").write_text('tableName,title,summary\nT,NA,""\n')
    assert values(files.read_table_meta(spark, str(tmp_path / "titles"))) == [("T", None, None, 1)]


def test_run_files_of_several_configurations(spark, tmp_path):
    runs = spark.createDataFrame(RUN_ROWS, schemas.RUNS)
    sinks.write_run_file(runs, str(tmp_path / "run"))
    listed = [(str(tmp_path / "run"), "D", f"c{n % 2}", n) for n in range(6)]
    scores = run_scores(score_rows(files.read_run_files(spark, listed, datasets=["D"])))
    assert scores.count() == 6
    with pytest.raises(ValueError, match="unknown datasets: E"):
        files.read_run_files(spark, [("nowhere", "E", "c", 0)], datasets=["D"])
    assert files.read_run_files(spark, []).columns == runs.columns


def test_allow_rows(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"dataset": "D", "key": "T 1 0"}\n{"dataset": "E", "key": "U 1 0"}\n')
    assert values(files.read_allow_rows(spark, str(tmp_path / "a.jsonl"), "E")) == [("E", "U 1 0")]


def test_dataset_of_the_catalogue(spark, tmp_path):
    known = catalogue(spark, [("D", "c.csv", "t.csv")])
    (tmp_path / "c.csv").write_text("tableName,key,group,id,name,description,types,target\nT,T 1 0,1,Q1,x,,[],1\n")
    (tmp_path / "t.csv").write_text("tableName,title,summary\nT,a,b\n")
    candidates, meta = read_dataset(spark, known, "D", str(tmp_path))
    assert candidates.count() == meta.count() == 1
    with pytest.raises(ValueError, match="no dataset 'X'"):
        read_dataset(spark, known, "X", "nowhere")


def test_allow_list(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"D": ["T 1 0", "U 2 1"], "E": []}, indent=1))
    (tmp_path / "2.json").write_text(json.dumps({"E": ["V 1 0"]}))
    assert values(files.read_allow_list(spark, str(tmp_path))) == [
        ("D", "T 1 0"), ("D", "U 2 1"), ("E", "V 1 0"),
    ]
    assert values(files.read_allow_list(spark, str(tmp_path), "E"), "key") == [("V 1 0",)]


def test_table_list(spark, tmp_path):
    path = tmp_path / "gt.csv"
    path.write_text("t1,0,1,Q1\nt2,0,1,Q1\nt2,1,1,Q1\n")
    assert values(files.read_table_list(spark, str(path))) == [("t2",)]
    assert values(files.read_table_list(spark, str(path), header=False)) == [("t1",), ("t2",)]


def test_examples_file(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"question": "q1", "answer": "a1"}\n{"question": "q\\n2", "answer": null}\n')
    assert values(files.read_examples(spark, str(path))) == [("q1", "a1"), ("q\n2", None)]


RUN_ROWS = [
    ("D", "c", 0, "T", "T 1 0", 1, 'say "x",\nplease', "out", "0", "0"),
    ("D", "c", 0, "T", "T 2 0", 2, "p", "", "0", "0"),
]


def test_run_files_round_trip(spark, tmp_path):
    runs = spark.createDataFrame(RUN_ROWS, schemas.RUNS)
    sinks.write_run_file(runs, str(tmp_path / "run"))
    header = next((tmp_path / "run").glob("part-*.csv")).read_text().splitlines()[0]
    assert header == "tableName,key,group,prompt,output,correct QID,output QID"
    again = files.read_run_file(spark, str(tmp_path / "run"), "D", "c", 0)
    assert values(again, "group", "prompt", "gold", "pred") == [
        (1, 'say "x",\nplease', "0", "0"), (2, "p", "0", "0"),
    ]
    assert run_scores(score_rows(again)).first()["accuracy"] == 1.0


def test_runs_are_partitioned(spark, tmp_path):
    path = str(tmp_path / "runs")
    runs = spark.createDataFrame(RUN_ROWS, schemas.RUNS).withColumn("processed_at", F.current_timestamp())
    sinks.write_runs(runs, path)
    sinks.write_runs(runs.withColumn("config", F.lit("other")), path)
    assert (tmp_path / "runs/dataset=D/config=c/iter=0").is_dir()
    stored = files.read_runs(spark, path)
    assert stored.count() == 4
    pruned = stored.where("config = 'other'")
    assert "PartitionFilters: [isnotnull(config" in pruned._jdf.queryExecution().executedPlan().toString()
    assert pruned.count() == 2


def test_scored_table_is_never_overwritten(spark, tmp_path):
    scored = score_rows(spark.createDataFrame(RUN_ROWS, schemas.RUNS))
    sinks.write_scored(scored, str(tmp_path / "scored"))
    assert spark.read.parquet(str(tmp_path / "scored")).count() == 2
    with pytest.raises(Exception, match="already exists"):
        sinks.write_scored(scored, str(tmp_path / "scored"))


def test_sheets_and_groups(spark, tmp_path):
    rows = spark.createDataFrame([(3, "Q1"), (20, 'a "b"'), (100, None)], "`group` bigint, gold string")
    sinks.write_sheet(rows, str(tmp_path / "csv"))
    again = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert values(again, "gold") == values(rows, "gold")
    sinks.write_sheet(rows, str(tmp_path / "parquet"), "parquet")
    assert values(spark.read.parquet(str(tmp_path / "parquet"))) == values(rows)
    sinks.write_groups(rows.repartition(3), str(tmp_path / "groups"))
    parts = sorted((tmp_path / "groups").glob("part-*.txt"))
    assert "".join(p.read_text() for p in parts).split() == ["3", "20", "100"]


def test_catalogue(spark):
    known = catalogue(spark)
    assert known.count() == len(KNOWN) == 6
    assert resolve(known, *KNOWN[2])["dataset"] == KNOWN[2][0]
    with pytest.raises(ValueError):
        resolve(known, KNOWN[0][0], KNOWN[1][1], KNOWN[0][2])
    with pytest.raises(ValueError):
        resolve(known, "other", KNOWN[1][1], KNOWN[1][2])


def exchanges(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0].count("Exchange ")


def test_bucketed_tables_are_not_shuffled(spark, tiny):
    from tablelink.operators.candidates import render_candidates
    from tablelink.operators.context import attach_rows
    from tablelink.operators.mentions import mention_table
    from tablelink.plans import bindings as b

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        sinks.save_bucketed(b.table_rows(spark, tiny), "corpus", ["table_name", "row_no"], 4)
        sinks.save_bucketed(b.candidates(spark, tiny), "mention_candidates", ["group"], 4)
        sinks.save_bucketed(b.places(spark, tiny), "places", ["table_name", "row_no"], 4)
        corpus, places = spark.table("corpus"), spark.table("places")
        candidates = spark.table("mention_candidates")
        assert exchanges(attach_rows(places, corpus)) == 0
        assert exchanges(mention_table(candidates)) == 0
        assert exchanges(render_candidates(candidates)) == 0
        expected = render_candidates(b.candidates(spark, tiny))
        assert values(render_candidates(candidates)) == values(expected)
    finally:
        for name in ("corpus", "mention_candidates", "places"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_named_tables_open_no_other_file(spark, tmp_path):
    """Files nobody names are not parsed (a broken one does no harm), large ones are split."""
    for name, text in (("a", "x,y\n1,2\n3,\n"), ("b", 'x\n"line\nbreak"\n'), ("c", 'x\n"never closed')):
        (tmp_path / f"{name}.csv").write_text(text)
    names = spark.createDataFrame([("a",), ("b",), ("a",), ("none",)], "table_name string")
    for whole_bytes, per_scan in ((1000, 100), (1000, 1), (12, 1)):
        got = files.read_named_tables(spark, str(tmp_path), names, whole_bytes, paths_per_scan=per_scan)
        assert {f.rsplit("/", 1)[1] for f in got.inputFiles()} == {"a.csv", "b.csv"}
        assert values(got, "table_name", "row_no", "cells") == [
            ("a", 1, ["1", "2"]), ("a", 2, ["3", None]), ("b", 1, ["line\nbreak"]),
        ]
    nothing = files.read_named_tables(spark, str(tmp_path), names.limit(0))
    assert nothing.collect() == [] and nothing.columns == ["table_name", "row_no", "col_names", "cells"]
