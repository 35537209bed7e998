from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tablelink.llm import chat

SCHEMA = "tree string, node bigint, parent bigint, role string, text string, score double"
PARTS = st.sampled_from(["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "\\", "\\.", " ", "\n", "a", "ü", "<", "/s>", "["])
TEXT = st.lists(PARTS, max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to<s>ol"]), TEXT), max_size=6))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.read_turns(text) == turns
    assert chat.loss_text(text, spans) == "".join(t for r, t in turns if r == "assistant")


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_no_control_string_inside(text):
    made = chat.escaped(text)
    assert chat.unescaped(made) == text and not any(c in made for c in chat.CONTROL)


def paths(df):
    return sorted(tuple(r) for r in chat.enumerate_paths(df).select("tree", "leaf", "node", "back").collect())


def test_paths_of_trees(spark):
    dice = random.Random(1)
    rows, want = [], []
    for tree in ("a", "b", "c", ""):
        parent = {}
        for node in range(1, 25):
            parent[node] = dice.choice([None, 0, 99, node, *range(1, node)]) if tree != "c" else node - 1
            rows.append((tree, node, parent[node], "user", "t", 0.0))
        ups = {n: p for n, p in parent.items() if p in parent and p < n}
        for leaf in set(parent) - set(ups.values()):
            node, back = leaf, 0
            while node is not None:
                want.append((tree, leaf, node, back))
                node, back = ups.get(node), back + 1
    assert paths(spark.createDataFrame(rows, SCHEMA)) == sorted(want)


def test_branches_are_ranked(spark):
    rows = [
        ("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 1.0), ("t", 3, 1, "assistant", "good", 5.0),
        ("t", 4, 1, "assistant", "same", 5.0), ("t", 5, 2, None, None, None),
    ]
    got = chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["rank"], r["leaf"]) for r in sorted(got)] and sorted((r["rank"], r["leaf"]) for r in got) == [(1, 3), (2, 4), (3, 5)]
    best = chat.format_conversations(spark.createDataFrame(rows, SCHEMA), best=1).collect()
    assert [chat.read_turns(r["formatted"]) for r in best] == [[("user", "q"), ("assistant", "good")]]


@pytest.mark.parametrize("size", [1, 700])
def test_turns_in_order(spark, size):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"t{k}", 0, "x") for k in range(size)]
    rows += [(2, 0, "user", "same", 0, "x")] * 3 + [(None, None, None, None, 0, "x"), (3, 1, "assistant", None, 0, "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, node int, tree string")
    got = {r["tree"]: chat.read_turns(r["formatted"]) for r in chat.format_conversations(chat.turns_in_order(df)).collect()}
    assert got == {
        "1": [(role, text) for _, _, role, text, _, _ in rows[:size]],
        "2": [("user", "same")] * 3, "": [("", "")], "3": [("assistant", "")],
    }


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.format_conversations(chat.turns_in_order(df)).collect() == []
