from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import oracle_sql, queries  # noqa: E402
from compare_oracle import connect, differences  # noqa: E402
from tablelink.llm import decontamination  # noqa: E402
from tablelink.llm.oracle import ORACLE  # noqa: E402
from tablelink.llm.queries import QUERIES  # noqa: E402
from tablelink.llm.shared import stored, table  # noqa: E402


def test_registered():
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLE) <= set(oracle_sql())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, tiny, name):
    assert differences(QUERIES[name](spark, tiny), connect(tiny), ORACLE[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op2_top_k", "op7_url_rules", "op10_chat_format", "op13_whitening"}))
def test_one_row_per_document(spark, tiny, name):
    got = QUERIES[name](spark, tiny)
    want = sorted(r[0] for r in table(spark, tiny, "documents").select("doc_id").collect())
    ids = [r[0] for r in got.select("doc_id").collect()]
    assert sorted(set(ids) if name == "op4_pack" else ids) == want


def test_conversations(spark, tiny):
    got = QUERIES["op10_chat_format"](spark, tiny)
    counts = dict(table(spark, tiny, "conversations").groupBy("conv_id").count().collect())
    assert {r["conv_id"]: r["n_turns"] for r in got.collect()} == {**counts, -1: 2}


@pytest.fixture(scope="module")
def steps(spark, tiny):
    """Documents before the first stage and after each."""
    docs = [table(spark, tiny, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], tiny)))
    return docs


def test_stages_keep_the_columns(steps):
    assert {tuple(df.dtypes) for df in steps[:-1]} == {tuple(steps[0].dtypes)}


def test_each_stage_keeps_what_it_should(spark, tiny, steps):
    ids = [[r[0] for r in df.select("doc_id").collect()] for df in steps]
    assert all(set(after) <= set(before) for before, after in zip(ids, ids[1:]))
    assert len(ids[1]) > 0.97 * len(ids[0])
    # One document of each group stays.
    linked = corpus_pipeline.similarity.link_documents(steps[2]).collect()
    assert sorted(ids[3]) == sorted({r["component_id"] for r in linked})
    # Contaminated texts are cut, others are left alone.
    items = table(spark, tiny, "benchmark")
    before = {r["doc_id"]: r for r in decontamination.match_benchmark(steps[3], items).withColumn(
        "dirty", decontamination.is_contaminated()).collect()}
    after = {r["doc_id"]: r for r in steps[4].collect()}
    assert any(r["dirty"] for r in before.values())
    for doc_id, row in before.items():
        if row["dirty"]:
            assert doc_id not in after or after[doc_id]["n_chars"] == len(after[doc_id]["text"]) < len(row["text"])
        else:
            assert after[doc_id]["text"] == row["text"] and after[doc_id]["n_chars"] == row["n_chars"]
    again = decontamination.match_benchmark(steps[4], items)
    assert again.where(decontamination.is_contaminated()).count() == 0
    assert set(ids[5]) == set(ids[4])


def test_empty_and_null_documents(spark, tiny, documents):
    columns = table(spark, tiny, "documents").columns
    for rows in ([], [(None, None), (1, None), (2, ""), (3, "12 34"), (3, "12 34")]):
        docs = documents(rows).select(columns)
        for _, stage in corpus_pipeline.STAGES:
            docs = stored(stage(spark, docs, tiny))
        assert docs.collect() == []
