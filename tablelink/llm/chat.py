"""Chat formatting: reply trees to root-to-leaf paths to conversations.

Paths are found with iterated self-joins that double their reach, so a tree of depth d
takes about 2 log2(d) joins. Branches are ranked by score, and each chosen path is
written as one text with marked turns. Control strings inside texts are escaped, and
`read_turns` gets the turns back.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelink.llm.shared import given_back, stored

# Fixed control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)
_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
# A turn as written: of a user, of another role (role, then text), of the assistant.
_TURN = re.compile(
    r"\[INST\] (?P<user>.*?) \[/INST\]"
    r"|<<SYS>>(?P<role>.*?)<s>(?P<other>.*?)<</SYS>>"
    r"| (?P<assistant>.*?) </s>",
    re.DOTALL,
)


def escaped(text: str) -> str:
    """Doubles backslashes and breaks control strings after their first character."""
    return _CONTROL.sub(lambda m: rf"{m[0][0]}\.{m[0][1:]}", text.replace("\\", "\\\\"))


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of it that carry loss: what the
    assistant says."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        if role in _MARKS:
            before, after = _MARKS[role]
        else:
            before, after = f"<<SYS>>{escaped(role)}<s>", "<</SYS>>"
        if role == "assistant":
            spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at += len(before) + len(body) + len(after)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns = []
    for found in _TURN.finditer(formatted):
        if found["role"] is not None:
            turns.append((unescaped(found["role"]), unescaped(found["other"])))
        else:
            role = "user" if found["user"] is not None else "assistant"
            turns.append((role, unescaped(found[role])))
    return turns


def loss_text(formatted: str, spans: list[tuple[int, int]]) -> str:
    return "".join(unescaped(formatted[a:b]) for a, b in spans)


def enumerate_paths(nodes: DataFrame) -> DataFrame:
    """Every (leaf, node, back) of every root-to-leaf path; back is the number of
    replies from the node to the leaf.

    nodes  tree, node, parent: `node` is unique in its tree, a parent has a smaller
           number than its replies; any other parent, or none, makes a node a root.
           Neither tree nor node is null.

    Jumps of 1, 2, 4, ... replies are made by joining the jumps with themselves. Then
    the longest jumps are taken first: each join doubles the part of every path found.
    """
    real = nodes.select("tree", F.col("node").alias("parent"))
    jumps = [
        stored(
            nodes.where(F.col("parent") < F.col("node"))
            .select("tree", "node", "parent")
            .join(real, ["tree", "parent"], "left_semi")
            .select("tree", "node", F.col("parent").alias("up"))
        )
    ]
    while not jumps[-1].isEmpty():
        last = jumps[-1]
        onward = last.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
        jumps.append(
            stored(last.join(onward, ["tree", "up"]).select("tree", "node", F.col("further").alias("up")))
        )
    answered = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    paths = (
        nodes.select("tree", "node")
        .join(answered, ["tree", "node"], "left_anti")
        .select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    )
    for power in range(len(jumps) - 2, -1, -1):
        here = F.struct("node", "back")
        further = F.struct(F.col("up").alias("node"), (F.col("back") + (1 << power)).alias("back"))
        both = F.when(F.col("up").isNotNull(), F.array(here, further)).otherwise(F.array(here))
        paths = paths.join(jumps[power], ["tree", "node"], "left").select(
            "tree", "leaf", F.inline(both)
        )
    return paths


def format_conversations(turns: DataFrame, best: int | None = None) -> DataFrame:
    """Each chosen root-to-leaf path as one conversation.

    turns  tree, node, parent, role, text, score; `enumerate_paths` says what tree,
           node and parent may be. A null role, text or score counts as empty or 0.
    best   branches kept per tree, by the mean score of their turns, then the smaller
           leaf; None keeps all

    Gives tree, leaf, rank (from 1), formatted, and spans: the start and end of what
    the assistant says, as written. A tree without rows gives no conversation.
    """
    rows = turns.select(
        "tree", "node", "parent",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    paths = stored(enumerate_paths(rows))
    scores = rows.select("tree", "node", "score")
    ranked = (
        paths.join(scores, ["tree", "node"])
        .groupBy("tree", "leaf")
        .agg(F.avg("score").alias("score"))
        .withColumn(
            "rank",
            F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")),
        )
    )
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    lines = (
        paths.join(ranked.select("tree", "leaf", "rank"), ["tree", "leaf"])
        .join(rows.select("tree", "node", "role", "text"), ["tree", "node"])
        .groupBy("tree", "leaf", "rank")
        .agg(F.sort_array(F.collect_list(F.struct("node", "role", "text"))).alias("turns"))
    )

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            yield pd.DataFrame(
                {
                    "tree": batch["tree"], "leaf": batch["leaf"], "rank": batch["rank"],
                    "formatted": [text for text, _ in made],
                    "spans": [[{"start": a, "end": b} for a, b in spans] for _, spans in made],
                }
            )

    kind = dict(rows.dtypes)
    return lines.mapInPandas(
        given_back(write),
        f"tree {kind['tree']}, leaf {kind['node']}, rank int, formatted string, "
        "spans array<struct<start: long, end: long>>",
    )


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """Conversations without reply links as trees in which each turn answers the one
    before: conv_id, turn, role, text to tree, node, parent, role, text, score.

    Turns are numbered by turn (null first), then role and text; repeated rows are
    turns of their own. `tree` is the id as text, empty for a null id.
    """
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    return (
        conversations.select(
            F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "turn", "role", "text"
        )
        .withColumn("node", F.row_number().over(order).cast("long"))
        .select(
            "tree", "node", (F.col("node") - 1).alias("parent"), "role", "text",
            F.lit(0.0).alias("score"),
        )
    )
