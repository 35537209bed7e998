from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablelink.llm import language as g

WORDS = {
    "aa": "the and with this that from have which their there would about".split(),
    "bb": "der die und mit nicht eine für auf sich über können schön".split(),
    "cc": "που και για από είναι δεν μια στο αυτό όταν πολύ καλά".split(),
}


def text(dice, lang, n):
    return " ".join(dice.choices(WORDS[lang], k=n))


@pytest.fixture(scope="module")
def model():
    dice = random.Random(1)
    return g.train([(text(dice, lang, dice.randrange(5, 80)).encode(), lang) for lang in WORDS for _ in range(120)])


def test_held_out(model):
    dice = random.Random(2)
    rows = [(lang, text(dice, lang, dice.randrange(3, 50)).encode()) for lang in WORDS for _ in range(100)]
    made = g.predict(model, [t for _, t in rows])
    assert sum(lang == got for (lang, _), (got, *_) in zip(rows, made)) >= 297
    assert all(0 <= score <= 1 for _, score, _ in made) and sum(r for *_, r in made) <= 6


def test_edges(model):
    made = g.predict(model, [None, b"", b"12 + 3 = ?", "½ £".encode(), b"the", ("und " * 100_000).encode(), "ß".encode()])
    assert [m[0] for m in made[:4]] == ["und"] * 4 and all(m[1] == 0 and m[2] for m in made[:4])
    assert made[4][0] == "aa" and made[5][0] == "bb" and made[6][0] in WORDS


def test_blocks_do_not_change_results(model, monkeypatch):
    dice = random.Random(3)
    texts = [text(dice, dice.choice(list(WORDS)), 20).encode() for _ in range(50)] + [b""]
    whole = g.predict(model, texts)
    monkeypatch.setattr(g, "_BLOCK", 100)
    assert [m[0] for m in g.predict(model, texts)] == [m[0] for m in whole]


def test_without_rows():
    assert g.predict(g.train([]), [b"a text"]) == [("und", 0.0, True)]


def test_columns(spark, documents, model):
    rows = [(1, "the and"), (1, "the and"), (None, None)]
    got = g.identify_languages(documents(rows).withColumn("language", F.lit("x")), model)
    assert sorted((r["doc_id"] or 0, r["language"]["lang_pred"]) for r in got.collect()) == [(0, "und"), (1, "aa"), (1, "aa")]
    assert g.identify_languages(documents([]), model).collect() == []


def test_training_rows(documents):
    docs = documents([(k, f"t{k}") for k in range(40)] + [(50, None), (None, "n")]).withColumn("lang", F.lit("aa"))
    assert len(g.training_rows(docs, F.lit(True), "doc_id", "text", "lang")) == 41
    few = g.training_rows(docs, F.lit(True), "doc_id", "text", "lang", per_language=10)
    assert few == g.training_rows(docs, F.lit(True), "doc_id", "text", "lang", per_language=10) and 3 <= len(few) <= 20


def test_other_languages_and_noise_are_rejected(model):
    dice = random.Random(5)
    others = [
        "собака спит в саду а дети играют под деревьями и поют весь день",
        "kutya alszik kertben miközben gyerekek játszanak fák alatt énekelnek",
        "狗在花园里睡觉孩子们在树下玩耍唱歌",
        *("".join(dice.choices("bcdfghjklmnpqrstvwxz ", k=n)) for n in (40, 200, 1500)),
    ]
    assert [rejected for *_, rejected in g.predict(model, [t.encode() for t in others])] == [True] * len(others)
    clean = [text(dice, lang, n).encode() for lang in WORDS for n in (4, 10, 40, 400)]
    assert not any(rejected for *_, rejected in g.predict(model, clean))


def naive_grams(data):
    """Sequences of two to four bytes with at most one space, none across a text's ends."""
    letters = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in data.lower())
    padded = bytes(0 if old == 0 else new for old, new in zip(data, letters)) + b" "
    found = []
    for size in (2, 3, 4):
        for at in range(len(padded) - size + 1):
            gram = padded[at : at + size]
            if gram.count(b" ") <= 1 and 0 not in gram:
                found.append(gram)
    return found


def test_scores_equal_a_plain_sum(model):
    """Mean of the logits of each sequence, then a softmax; one hash per sequence."""
    import math

    import numpy as np

    def bucket(gram):
        code = 0
        for b in gram:
            code = code * 257 + b
        mixed = (code + (len(gram) << 40)) & (2**64 - 1)
        mixed = ((mixed ^ (mixed >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
        mixed = ((mixed ^ (mixed >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
        return (mixed ^ (mixed >> 31)) >> (64 - g._BITS)

    dice = random.Random(6)
    texts = [text(dice, lang, n).encode() for lang in WORDS for n in (1, 7)] + [b"The  AND-with 3\n4 this", "ß".encode()]
    for data, (lang, score, _) in zip(texts, g.predict(model, texts)):
        found = naive_grams(data)
        buckets, counts = g.grams([data])
        assert sorted(buckets.tolist()) == sorted(map(bucket, found)) and counts.tolist() == [len(found)]
        means = [sum(float(model.logits[bucket(x), at]) for x in found) / len(found) for at in range(len(WORDS))]
        powers = [math.exp(m / model.temperature) for m in means]
        assert lang == model.languages[int(np.argmax(means))]
        assert math.isclose(score, max(powers) / sum(powers), rel_tol=1e-6)
