from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tablelink.llm import byte_pairs as b
from tablelink.llm.queries import QUERIES, byte_coder
from tablelink.llm.shared import table


@pytest.fixture(scope="module")
def coder():
    return byte_coder()


@pytest.fixture(scope="module")
def plain(coder):
    """The library that the ids must equal."""
    return tiktoken.Encoding(
        "plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={}
    )


ALPHABETS = [
    "ab", "aab \n", "the and ing tion er \t\n ", "äöüßéñ你好мир😀🎉  ", "0123456789 .,;:!?'s't",
    "".join(map(chr, range(32, 127))), " 　‍ é",
]


@pytest.mark.parametrize("alphabet", ALPHABETS)
def test_random_texts(coder, plain, alphabet):
    dice = random.Random(alphabet)
    texts = ["".join(dice.choices(alphabet, k=k)) for k in (0, 1, 2, 3, 5, 8, 17, 40, 130, 900) for _ in range(8)]
    for text, ids in zip(texts, coder.encode(texts)):
        assert ids.tolist() == plain.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


@pytest.mark.parametrize("short", [1, 64])
def test_long_pieces(coder, plain, short, monkeypatch):
    monkeypatch.setattr(b, "SHORT", short)
    dice = random.Random(3)
    texts = ["a" * 7000, " " * 3000, "ab" * 2500, "<|endoftext|>" * 20, "x \n " * 500]
    texts += ["".join(dice.choices("abcdefghijklmnopqrstuvwxyz", k=k)) for k in (60, 70, 500, 3000)]
    coder._clear()
    assert [ids.tolist() for ids in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_blocks_and_forgetting(coder, plain, monkeypatch):
    """Texts over a block, and a memory of a few pieces, change nothing."""
    monkeypatch.setattr(b, "BLOCK_CHARS", 50)
    monkeypatch.setattr(b, "CACHED_PIECES", 20)
    monkeypatch.setattr(b, "MATRIX_CELLS", 64)
    dice = random.Random(4)
    texts = ["".join(dice.choices("abcxyz  \n.'s", k=k)) for k in (10, 700, 49, 51, 3000)]
    assert [ids.tolist() for ids in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]


def test_small_vocabulary():
    """A merge that makes a pair of lower rank than its own comes first in the next round."""
    ranks = {bytes([n]): n for n in range(256)}
    ranks |= {b"bc": 300, b"cd": 301, b"bcd": 299, b"abcd": 298, b"aa": 310, b"aaaa": 305}
    coder = b.BytePairs(ranks, r"[a-d]+|[^a-d]+")
    plain = tiktoken.Encoding("small", pat_str=r"[a-d]+|[^a-d]+", mergeable_ranks=ranks, special_tokens={})
    dice = random.Random(5)
    texts = ["".join(dice.choices("aabcd", k=k)) for k in (4, 9, 30, 100, 400) for _ in range(30)]
    for short in (1, 64):
        b.SHORT, before = short, b.SHORT
        try:
            assert [ids.tolist() for ids in coder.encode(texts)] == [plain.encode_ordinary(t) for t in texts]
            coder._clear()
        finally:
            b.SHORT = before


def test_needs_every_byte():
    with pytest.raises(ValueError):
        b.BytePairs({b"a": 0}, "a")


def test_edges(spark, documents, coder, plain):
    texts = [None, "", " ", "a", "word " * 40_000, "z" * 5000, "a\0b", "a"]
    docs = documents(list(enumerate(texts)) + [(None, "a"), (7, "a")])
    out = b.decode_ids(b.encode_texts(docs, coder), coder, F.col("encoded.ids"))
    assert set(docs.columns) < set(out.columns)
    rows = out.collect()
    assert len(rows) == 10
    for row in rows:
        ids = plain.encode_ordinary(row["text"] or "")
        assert row["encoded"]["n_tokens"] == len(ids)
        assert np.frombuffer(row["encoded"]["ids"], "<u4").tolist() == ids
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert b.encode_texts(documents([]), coder).collect() == []


def test_ids_that_cannot_be_decoded(spark, coder):
    given = [(1, None), (2, b""), (3, b"abc"), (4, np.array([2**31], "<u4").tobytes()), (5, np.array([0], "<u4").tobytes())]
    rows = spark.createDataFrame(given, "n int, encoded binary")
    out = {r["n"]: r["decoded"] for r in b.decode_ids(rows, coder, F.col("encoded")).collect()}
    assert out == {1: None, 2: b"", 3: None, 4: None, 5: coder.decode(np.array([0]))}


def test_query(spark, tiny, plain):
    want = {}
    for row in table(spark, tiny, "documents").collect():
        ids = plain.encode_ordinary(row["text"] or "")
        data = np.array(ids, "<u4").tobytes()
        want[row["doc_id"]] = (
            len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256((row["text"] or "").encode()).hexdigest(),
        )
    got = QUERIES["op11_byte_pairs"](spark, tiny).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
