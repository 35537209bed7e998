from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from tablelink.llm import toxicity as t

SYLLABLES = "the an re ing ent or li mo ta ver so del ka".split()


def text(dice, insult=None):
    words = ["".join(dice.choices(SYLLABLES, k=dice.randrange(1, 4))) for _ in range(dice.randrange(5, 60))]
    if insult:
        words.insert(dice.randrange(len(words)), insult)
    return " ".join(words) + "."


@pytest.fixture(scope="module")
def model():
    dice = random.Random(1)
    rows = [(text(dice), 0) for _ in range(400)]
    rows += [(text(dice, dice.choice(("zwubble", "gropfix", "fuzwit"))), 1) for _ in range(120)]
    return t.train(rows)


def test_held_out_texts(model):
    dice = random.Random(2)
    clean = t.score(model, [text(dice) for _ in range(200)])
    toxic = t.score(model, [text(dice, dice.choice(("zwubble", "gropfix", "fuzwit"))) for _ in range(100)])
    assert np.mean(np.array(clean) < 0.5) > 0.98 and np.mean(np.array(toxic) >= 0.5) > 0.98


@pytest.mark.parametrize("insult", ["z.w.u.b.b.l.e", "zwu-bble", "ZWUBBLE!!!", "z w u b b l e", "zwüb1ble", "zwubblex"])
def test_gaps_and_inserted_characters(model, insult):
    dice = random.Random(3)
    assert min(t.score(model, [text(dice, insult) for _ in range(20)])) >= 0.5


def test_edges(model):
    harmless = t.score(model, [None, "", "123 !?", "a"])
    assert len(set(harmless)) == 1 and harmless[0] < 0.5
    dice = random.Random(4)
    long = " ".join([text(dice)] * 4000)
    assert t.score(model, [long])[0] < 0.5
    assert t.score(model, [long + " zwubble", None])[0] >= 0.5


def test_training_without_a_class():
    assert t.score(t.train([]), ["a text", None]) == [0.5, 0.5]
    assert t.score(t.train([("only clean here", 0)] * 5), ["a text"])[0] < 0.5


def kernel(a, b):
    """Shared triples as subsequences, each weighted by what it spans."""
    def profile(word):
        out = {}
        for i, j, k in combinations(range(len(word)), 3):
            key = word[i] + word[j] + word[k]
            out[key] = out.get(key, 0) + t.DECAY ** (k - i + 1)
        return out
    x, y = profile(a), profile(b)
    norm = sum(v * v for v in x.values()) ** 0.5 * sum(v * v for v in y.values()) ** 0.5
    return sum(v * y.get(key, 0) for key, v in x.items()) / norm


@pytest.mark.parametrize("a, b", [("banana", "bandana"), ("idiot", "idxiot"), ("scum", "scum"), ("abab", "baba")])
def test_kernel(a, b):
    packed = np.array([t._packed(a), t._packed(b)], dtype=np.uint64)
    profiles = t._profiles(packed)
    assert profiles[0] @ profiles[1] == pytest.approx(kernel(a, b))
    table = profiles[1]
    assert t.margins(table, 0.0, packed[:1])[0] == pytest.approx(kernel(a, b))


def test_score_column(spark, documents, model):
    rows = [(1, "zwubble"), (1, "zwubble"), (None, None), (3, "")]
    got = t.score_toxicity(documents(rows), model)
    assert got.count() == 4 and got.columns == [*documents([]).columns, "toxicity"]
    assert t.score_toxicity(documents([]), model).collect() == []


def test_training_rows(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 1), (3, None, 1), (9, 1, 1)], "doc_id bigint, toxic int, quality int")
    from pyspark.sql import functions as F
    rows, share = t.training_rows(documents([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (9, None)]), labels, F.lit(True), "doc_id", "text", "toxic")
    assert rows == [("a", 1), ("b", 0)] and share == pytest.approx(2 / 3)


PLAIN = ("scum", "idiot", "moron", "loser", "trash", "zug")


@pytest.fixture(scope="module")
def plain_model():
    dice = random.Random(6)
    rows = [(text(dice), 0) for _ in range(600)]
    rows += [(text(dice, PLAIN[k % len(PLAIN)]), 1) for k in range(240)]
    return t.train(rows)


@pytest.mark.parametrize("insult", ["zug", "ZUG!", "sc*m", "m0r0n", "1d10t", "tra5h", "l*ser", "tr@sh", "sc um", "id iot", "mo ron", "lo ser", "tr as h"])
def test_short_masked_and_split_insults(plain_model, insult):
    dice = random.Random(7)
    assert np.mean(np.array(t.score(plain_model, [text(dice, insult) for _ in range(40)])) >= 0.5) > 0.95


def test_short_masked_and_split_harmless_words(plain_model):
    dice = random.Random(8)
    words = ["an", "the or", "don't", "b2b", "3rd", "re-in", "li mo", "an***", "2nd, 3rd", "e.g.", "ta-ver's"]
    scores = t.score(plain_model, [text(dice, dice.choice(words)) for _ in range(400)])
    assert np.mean(np.array(scores) < 0.5) > 0.98


SCRIPTS = {
    "cyrillic": ("ка ро ли мен сту да вер об ни ла зе пи".split(), "дурень", "тупица", " "),
    "greek": ("κα ρο λι μεν στυ δα βερ ομ νι λα ζε πι".split(), "βλάκας", "χαζός", " "),
    "arabic": ("با تر سن مو كل دا في نو رب شي".split(), "غبيحمق", "حقيرجد", " "),
    "han": (list("我们天地人民学生工作时间东西南北今明年月日水火山石"), "笨蛋", "白痴", ""),
    "hangul": (list("가나다라마바사아자차카타파하거너더러머버"), "멍청이", "바보", ""),
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_other_scripts(script):
    """Toxic and clean texts of a script differ in their letters, not in its being theirs."""
    parts, *insults, space = SCRIPTS[script]
    dice = random.Random(9)

    def made(insult=None):
        words = ["".join(dice.choices(parts, k=dice.randrange(2, 4))) for _ in range(dice.randrange(5, 40))]
        if insult:
            words.insert(dice.randrange(len(words)), insult)
        return space.join(words)

    model = t.train([(made(), 0) for _ in range(300)] + [(made(dice.choice(insults)), 1) for _ in range(150)])
    clean = np.array(t.score(model, [made() for _ in range(200)]))
    toxic = np.array(t.score(model, [made(dice.choice(insults)) for _ in range(200)]))
    assert np.mean(clean < 0.5) > 0.97 and np.mean(toxic >= 0.5) > 0.97


def test_full_width_letters(plain_model):
    wide = "".join(chr(ord(c) + 0xFEE0) for c in "idiot")
    assert t.score(plain_model, [f"the an {wide}"])[0] >= 0.5
    assert len(set(t.score(plain_model, ["", "。、！", "\U0001f600\U0001f600\U0001f600\U0001f600"]))) == 1


def test_a_long_tail_of_insults():
    """Each of many insults is in less than one in a hundred toxic texts."""
    dice = random.Random(10)
    insults = ["".join(dice.choices("bcdfghjkpqwxyz", k=3)) + dice.choice("aeiou") + "".join(dice.choices("bcfgkpqwxz", k=3))
               for _ in range(150)]
    rows = [(text(dice), 0) for _ in range(1000)] + [(text(dice, insults[k % 150]), 1) for k in range(900)]
    model = t.train(rows)
    toxic = np.array(t.score(model, [text(dice, insult) for insult in insults for _ in range(2)]))
    clean = np.array(t.score(model, [text(dice) for _ in range(300)]))
    assert len(model.landmarks) >= 140
    assert np.mean(toxic >= 0.5) > 0.95 and np.mean(clean < 0.5) > 0.97


def test_nothing_to_tell_is_reported():
    with pytest.warns(UserWarning, match="nothing tells"):
        t.train([("all the same words", k % 2) for k in range(40)])


def test_margins_of_a_window_are_made_once(model, monkeypatch):
    """A task makes the margin of each window once, and remembers a bounded number."""
    dice = random.Random(12)
    texts = [text(dice, dice.choice((None, "zwubble", "zw ubble", "gr0pfix"))) for _ in range(60)]
    alone = [t.score(model, [one])[0] for one in texts]
    made = []
    margins = t.margins
    monkeypatch.setattr(t, "margins", lambda table, bias, packed: made.extend(packed.tolist()) or margins(table, bias, packed))
    seen = t.Seen()
    assert [t.score(model, [one], seen)[0] for one in texts] == alone
    of_words = set(t.windows_of(texts)[0].tolist())
    assert sum(window in of_words for window in made) <= 2 * len(of_words)
    made.clear()
    assert t.score(model, texts, seen) == alone and not made
    few = t.SeenWindows(5)
    for at in range(0, 40, 3):
        windows = np.arange(at % 7, at % 7 + 4, dtype=np.uint64)
        assert few.of(windows, lambda new: new * 2.0).tolist() == (windows * 2.0).tolist()
        assert len(few.packed) <= 5 and (np.diff(few.packed.astype(np.int64)) > 0).all()
