from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablelink.llm import decontamination as d

ITEMS = "item_id bigint, text string, match string"


def words(text):
    return d.words_of(None if text is None else text.encode())


def brute(text, items, window):
    doc = words(text)
    hit, found = set(), set()
    for item, item_text in items:
        code = words(item_text)
        size = min(window, len(code))
        for k in range(len(code) - size + 1 if code else 0):
            for at in range(len(doc) - size + 1):
                if doc[at : at + size] == code[k : k + size]:
                    hit |= set(range(at, at + size))
                    found.add("" if item is None else str(item))
    return len(doc), sorted(hit), sorted(found)


def result(match):
    return (
        match["n_words"],
        sorted(k for s in match["spans"] for k in range(s["start"], s["end"])),
        list(match["items"]),
    )


@pytest.mark.parametrize("block_words", [100_000, 30])
@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, documents, seed, block_words):
    dice = random.Random(seed)
    letters = "abc"
    def text(n):
        return " ".join(dice.choice(letters) for _ in range(n))
    items = [(k, text(dice.randrange(1, 12))) for k in range(12)] + [(None, text(7)), (50, None), (51, " ."), (10, text(8))]
    rows = [(k, text(dice.randrange(0, 40))) for k in range(60)] + [(90, None), (91, ""), (91, "")]
    got = d.match_benchmark(
        documents(rows), spark.createDataFrame([(i, t, "m") for i, t in items], ITEMS),
        window=5, block_words=block_words,
    )
    want = sorted(((i, *brute(t, items, 5)) for i, t in rows), key=repr)
    assert sorted(((r["doc_id"], *result(r["match"])) for r in got.select("doc_id", "match").collect()), key=repr) == want


def test_long_text_and_normalising(spark, documents):
    item = " ".join(f"W{k}" for k in range(20))
    text = "start, " + "x " * 50_000 + "w0-W1 w2;w3 W4 w5 w6 w7 w8 w9 w10 w11 w12 w13! É1 " + "y " * 10
    got = d.match_benchmark(documents([(1, text)]), spark.createDataFrame([(1, item, "")], ITEMS)).first()["match"]
    assert [(s["start"], s["end"]) for s in got["spans"]] == [(50_001, 50_015)]


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], ITEMS)
    assert d.match_benchmark(documents([]), none).collect() == []
    got = d.match_benchmark(documents([(1, "a b")]), none).first()["match"]
    assert result(got) == (2, [], [])


def test_remove_spans(spark, documents):
    item = " ".join(f"i{k}" for k in range(15))
    rows = [
        (1, f"Before it, {item}. After it."), (2, f"({item})"), (3, f"{item} " + "clean " * 1000),
        (4, None), (5, ""), (6, "clean text"),
    ]
    matched = d.match_benchmark(documents(rows), spark.createDataFrame([(1, item, "")], ITEMS))
    got = {r["doc_id"]: r["text"] for r in d.remove_spans(matched).collect()}
    assert got == {1: "Before it, . After it.", 3: rows[2][1], 4: None, 5: "", 6: "clean text"}
    assert matched.where(d.is_contaminated()).select(F.sort_array(F.collect_set("doc_id"))).first()[0] == [1, 2]


@pytest.mark.parametrize("seed", range(3))
def test_without_spans(spark, seed):
    import re

    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

    def plain(text, spans):
        places = [found.span() for found in word.finditer(text)]
        kept, at = [], 0
        for start, end in spans:
            kept.append(text[at : places[start][0]])
            at = places[end - 1][1]
        return "".join([*kept, text[at:]])

    dice = random.Random(seed)
    rows = []
    for _ in range(150):
        text = "".join(dice.choices("ab1É😀 .,\n-$\\", k=dice.randrange(60)))
        n = len(word.findall(text))
        cuts = sorted(dice.sample(range(n + 1), min(n + 1, 2 * dice.randrange(4))))
        spans = [(a, b) for a, b in zip(cuts[::2], cuts[1::2])]
        rows.append((text, spans, plain(text, spans)))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>, want string")
    made = df.select("want", d.without_spans(F.col("text"), F.col("spans")).alias("got")).collect()
    assert [r["got"] for r in made] == [r["want"] for r in made]
