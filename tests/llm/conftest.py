from __future__ import annotations

import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, label string"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes documents of (doc_id, text) pairs, with further columns of common names."""

    def make(rows):
        full = [(i, t, None, "src", None if t is None else len(t), 7, "x") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


def rows_of(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)
