"""Language ID: averaged hashed subword embeddings with a linear softmax.

A text is its sequences of two to four bytes (A-Z lower-cased, other ASCII that is no
letter as spaces), hashed into a table of embeddings. Their mean goes through a linear
layer. Both are trained by stochastic gradient descent in numpy on a bounded sample.
On sampled rows that were not trained on, whole and in short pieces, a temperature is
fitted, and two bounds below which a prediction is rejected: one of the score, and one
of the evidence, the mean logit of the predicted language. Sequences that training did
not see add next to no evidence, so texts of other languages and noise have little.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import crc_of_id, given_back, mixed, shared_object, small_batches

UNKNOWN = "und"
_BITS = 17
_DIMENSIONS = 16
_SIZES = (2, 3, 4)
# Bytes of the short pieces that calibrate along with whole texts.
SHORT_BYTES = 40
# Bytes that go through numpy at once.
_BLOCK = 1 << 18

_LETTERS = bytes(
    b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in bytes(range(256)).lower()
)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    logits: np.ndarray  # bucket x language
    temperature: float
    reject_below: float
    least_evidence: float


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all sequences of the texts, and how many each text has.

    Sequences of spaces alone, or with more than one space, are left out.
    """
    data = np.frombuffer(b" \0".join([b"", *texts, b""]).translate(_MARKED), dtype=np.uint8)
    of_text = np.cumsum(data == 0)
    space = (data == 0x20).astype(np.int8)
    wide = data.astype(np.uint64)
    found, owner = [], []
    code = wide
    for size in range(2, max(_SIZES) + 1):
        n = len(data) - size + 1
        if n <= 0:
            break
        code = code[:n] * np.uint64(257) + wide[size - 1 :]
        spaces = np.convolve(space, np.ones(size, np.int8), "valid") if size > 1 else space
        ends = data == 0
        crossing = np.convolve(ends.astype(np.int8), np.ones(size, np.int8), "valid")
        good = (spaces <= 1) & (crossing == 0)
        found.append((mixed(code[good] + np.uint64(size << 40)) >> np.uint64(64 - _BITS)).astype(np.int32))
        owner.append(of_text[:n][good] - 1)
    if not found:
        return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
    buckets, texts_of = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(texts_of, kind="stable")
    return buckets[order], np.bincount(texts_of, minlength=len(texts))[: len(texts)]


_MARKED = bytes(0 if b == 0 else c for b, c in enumerate(_LETTERS))


def _softmax(logits: np.ndarray) -> np.ndarray:
    powers = np.exp(logits - logits.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _means(table: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean row of `table` per text; 0 for a text without sequences."""
    out = np.zeros((len(counts), table.shape[1]), dtype=np.float64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for column in range(table.shape[1]):
            out[some, column] = np.add.reduceat(table[buckets, column], starts)
        out[some] /= counts[some, None]
    return out


def train(
    rows: list[tuple[bytes, str]], epochs: int = 4, rate: float = 0.5, batch: int = 32, seed: int = 7
) -> LanguageModel:
    """Fit a model on (text, language) pairs; every eighth one calibrates.

    Each text gives a piece of up to 2000 bytes and a short one, so that short texts are
    known as well. Without rows the model knows no language.
    """
    languages = tuple(sorted({language for _, language in rows}))
    if not languages:
        return LanguageModel((), np.zeros((1 << _BITS, 1), np.float32), 1.0, 0.0, 0.0)
    number = {language: at for at, language in enumerate(languages)}
    random = np.random.default_rng(seed)
    rows = [rows[at] for at in random.permutation(len(rows))]
    aside, used = rows[::8], [row for at, row in enumerate(rows) if at % 8 or len(rows) < 16]
    examples = []
    for text, language in used:
        start = int(random.integers(0, max(1, len(text) - 120)))
        long = min(start, max(0, len(text) - 2000))
        for piece in (text[long : long + 2000], text[start : start + 120]):
            buckets, _ = grams([piece])
            if len(buckets):
                examples.append((buckets, number[language]))
    embeddings = random.uniform(-1 / _DIMENSIONS, 1 / _DIMENSIONS, (1 << _BITS, _DIMENSIONS))
    weights = np.zeros((_DIMENSIONS, len(languages)))
    steps, done = max(1, epochs * -(-len(examples) // batch)), 0
    for _ in range(epochs):
        order = random.permutation(len(examples))
        for at in range(0, len(order), batch):
            chosen = [examples[k] for k in order[at : at + batch]]
            buckets = np.concatenate([b for b, _ in chosen])
            counts = np.array([len(b) for b, _ in chosen])
            means = _means(embeddings, buckets, counts)
            error = _softmax(means @ weights)
            error[np.arange(len(chosen)), [y for _, y in chosen]] -= 1
            step = rate * (1 - done / steps)
            back = error @ weights.T / counts[:, None]
            weights -= step * means.T @ error
            np.add.at(embeddings, buckets, -step * np.repeat(back, counts, axis=0))
            done += 1
    logits = (embeddings @ weights).astype(np.float32)
    starts = [int(random.integers(0, max(1, len(text) - SHORT_BYTES))) for text, _ in aside]
    pieces = [text[at : at + SHORT_BYTES] for (text, _), at in zip(aside, starts)]
    whole, short = (_means(logits, *grams(texts)) for texts in ([text for text, _ in aside], pieces))
    truth = np.array([number[language] for _, language in aside])
    return LanguageModel(languages, logits, *_calibrated(whole, short, truth))


def _calibrated(whole: np.ndarray, short: np.ndarray, truth: np.ndarray) -> tuple[float, float, float]:
    """From logits of whole texts and of short pieces: the temperature of least log loss
    of both, and the score and the evidence below which to reject: half of what all but
    one in 500 of the right predictions of whole texts reach."""
    every, languages = np.concatenate((whole, short)), np.concatenate((truth, truth))

    def loss(temperature: float) -> float:
        right = _softmax(every / temperature)[np.arange(len(languages)), languages]
        return float(-np.log(np.maximum(right, 1e-12)).mean())

    temperature = min((0.02 * 1.25**k for k in range(28)), key=loss)
    right = whole.argmax(axis=1) == truth
    if not right.any():
        return temperature, 0.0, 0.0
    scores = _softmax(whole / temperature).max(axis=1)[right]
    evidence = whole.max(axis=1)[right]
    return temperature, float(np.quantile(scores, 0.002)) / 2, float(np.quantile(evidence, 0.002)) / 2


def predict(model: LanguageModel, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
    """Language, score and whether the model rejects, per text."""
    out: list[tuple[str, float, bool]] = []
    block: list[bytes] = []
    size = 0

    def flush() -> Iterator[tuple[str, float, bool]]:
        if not block:
            return
        buckets, counts = grams(block)
        logits = _means(model.logits, buckets, counts)
        made = _softmax(logits / model.temperature)
        best, evidence = made.argmax(axis=1), logits.max(axis=1)
        for text, at, score, said in zip(block, best.tolist(), made.max(axis=1).tolist(), evidence.tolist()):
            if not model.languages or not _has_letter(text):
                yield UNKNOWN, 0.0, True
            else:
                yield model.languages[at], score, score < model.reject_below or said < model.least_evidence

    for text in texts:
        block.append(text or b"")
        size += len(block[-1])
        if size >= _BLOCK:
            out += flush()
            block, size = [], 0
    return out + list(flush())


def _has_letter(text: bytes) -> bool:
    if any(chr(b).isalpha() for b in set(text) if b < 0x80):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def training_rows(
    docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str,
    per_language: int = 600, longest: int = 100_000,
) -> list[tuple[bytes, str]]:
    """A sample of at most about `per_language` rows of each language, chosen by a hash
    of the id, of texts of at most `longest` bytes."""
    known = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {row[0]: row[1] for row in known.groupBy(lang).count().collect()}
    place = crc_of_id(F.concat(F.lit("language "), F.col(doc_id).cast("string"))) / float(1 << 32)
    share = F.lit(0.0)
    for language, n in counts.items():
        share = F.when(F.col(lang) == language, min(1.0, per_language / n)).otherwise(share)
    rows = (
        known.where((place < share) & (F.octet_length(text) <= longest))
        .select(F.col(text).cast("binary"), lang)
        .limit(2 * per_language * max(1, len(counts)))
        .collect()
    )
    return sorted((bytes(row[0]), row[1]) for row in rows)


def identify_languages(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add `language`: lang_pred, score and rejected.

    A null text or one without letters is `und` with score 0 and rejected. Other texts
    get the likeliest language of the model, and are rejected below either of its bounds.
    Repeated rows and further columns pass through; a column called language is replaced.
    """
    small_batches(docs.sparkSession)
    fitted = shared_object(docs.sparkSession, model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    @given_back
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = predict(fitted(), batch.tolist())
            yield pd.DataFrame(made, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("language", identify(F.col(text).cast("binary")))
