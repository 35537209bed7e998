"""Importance resampling of a corpus towards a target text collection.

Words and runs of words are hashed into buckets. A bucket gains what the logarithm of
its share in the target over its share in the corpus says, and a document weighs the sum
of its gains; both are scored with numpy arrays of one number per bucket. Gumbel noise
that the id fixes turns the highest scores into a sample without replacement in
proportion to the weights.

The scores are sorted by regular sampling. Each task writes its rows as a sorted run;
regular places of the runs give the splitters; every run is cut at the splitters and the
cuts are exchanged once; a segment merges what it gets; the counts of the segments before
it turn places in a segment into exact ranks. Only segments that hold drawn documents
are exchanged.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelink.llm.shared import WORD_BYTES, given_back, shared_object, small_batches, stored, union_all

# Rows of a sorted segment, and samples that its splitter comes from.
SEGMENT_ROWS = 1_000_000
SAMPLES = 64
# Features whose buckets a Python worker remembers.
CACHED_FEATURES = 300_000
# Bytes of texts whose features go through numpy at once.
_BLOCK = 1 << 20
_LAST = (1 << 33) - 1


class Buckets:
    """The buckets of texts: unsigned crc32 of each feature modulo their number. A
    feature is a run of 1 to `ngram` words of a text, joined by one space."""

    def __init__(self, ngram: int, buckets: int):
        self.ngram, self.buckets = ngram, buckets
        self.number: dict[bytes, int] = {}

    def __getstate__(self):
        return {"ngram": self.ngram, "buckets": self.buckets, "number": {}}

    def of_texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all features, text by text; features and words of each text."""
        lists = [text.translate(WORD_BYTES).split() for text in texts]
        n_words = np.fromiter(map(len, lists), np.int64, len(lists))
        features = lists
        for size in range(2, self.ngram + 1):
            features = [
                made + [b" ".join(words[at : at + size]) for at in range(len(words) - size + 1)]
                for made, words in zip(features, lists)
            ]
        n_features = np.fromiter(map(len, features), np.int64, len(features))
        flat = list(chain.from_iterable(features))
        found = np.fromiter(map(self.number.get, flat, repeat(-1)), np.int64, len(flat))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            made = {flat[at]: zlib.crc32(flat[at]) % self.buckets for at in missing}
            found[missing] = [made[flat[at]] for at in missing]
            if len(self.number) + len(made) > CACHED_FEATURES:
                self.number = {}
            if len(made) <= CACHED_FEATURES:
                self.number.update(made)
        return found, n_features, n_words


def _blocks(values: list[bytes | None]) -> Iterator[list[bytes]]:
    block: list[bytes] = []
    size = 0
    for value in values:
        block.append(value or b"")
        size += len(block[-1])
        if size >= _BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def bucket_counts(docs: DataFrame, text: str = "text", ngram: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs in all whole texts. Tasks add up arrays; the driver
    gets one number per bucket. Null texts have no features."""
    small_batches(docs.sparkSession)
    made = shared_object(docs.sparkSession, Buckets(ngram, buckets))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for block in _blocks(batch["text"].tolist()):
                total += np.bincount(made().of_texts(block)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    counted = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(given_back(count), "bucket long, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the
    corpus."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum()), float(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((t + 1.0) * (all_corpus + n) / ((s + 1.0) * (all_target + n))))
            for s, t in zip(corpus.tolist(), target.tolist())
        ],
        dtype=np.int64,
    )


def weigh(
    docs: DataFrame, gains: np.ndarray, text: str = "text", ngram: int = 1, into: str = "weighed"
) -> DataFrame:
    """Add the column `into`: n_words, n_features and weight (the sum of the features'
    gains), all long.

    Null, empty and wordless texts have 0 of each. Nothing is shuffled; other columns
    pass through, a column called `into` is replaced.
    """
    small_batches(docs.sparkSession)
    made = shared_object(docs.sparkSession, (Buckets(ngram, len(gains)), gains))

    @F.pandas_udf("n_words long, n_features long, weight long")
    @given_back
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter, of_bucket = made()
        for batch in batches:
            parts = [pd.DataFrame({"n_words": [], "n_features": [], "weight": []}, dtype="int64")]
            for block in _blocks(batch.tolist()):
                found, n_features, n_words = counter.of_texts(block)
                sums = np.append(0, np.cumsum(of_bucket[found]))
                ends = np.cumsum(n_features)
                weight = sums[ends] - sums[ends - n_features]
                parts.append(pd.DataFrame({"n_words": n_words, "n_features": n_features, "weight": weight}))
            yield pd.concat(parts, ignore_index=True)

    return docs.withColumn(into, score(F.col(text).cast("binary")))


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of Gumbel noise g that seed and id fix; a null id counts as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def _segment(splitters: list[tuple[int, int, int, int]]):
    """How many splitters are at or before a row of a run."""
    cut = np.array(splitters, dtype=np.int64)

    @F.pandas_udf("long")
    def number(down: pd.Series, no_id: pd.Series, key: pd.Series, place: pd.Series) -> pd.Series:
        own = np.stack([column.to_numpy(np.int64) for column in (down, no_id, key, place)], axis=1)
        every = np.concatenate((cut, own))
        order = np.lexsort(every.T[::-1])
        passed = np.empty(len(every), dtype=np.int64)
        passed[order] = np.cumsum(order < len(cut))
        return pd.Series(passed[len(cut) :])

    return number


def highest(
    rows: DataFrame, score: str, doc_id: str, drawn: int, segment_rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Add `rank`, 1 to `drawn`, to the rows with the highest scores, ties to smaller ids
    and null ids last; null for all others.

    rows  any table with a long `score` and a whole-number `doc_id`; give a narrow one,
          it is written once as sorted runs and once cut into segments

    Rows equal in score and id are told apart by their places in the runs, so any number
    of them is spread over segments. The driver gets 64 samples and one count per
    `segment_rows` rows. A column called rank is replaced.
    """
    row, order = F.struct(*rows.drop("rank").columns), ["down", "no_id", "key", "place"]
    runs = stored(
        rows.select(
            row.alias("row"),
            (-F.col(score)).cast("long").alias("down"),
            F.col(doc_id).isNull().cast("long").alias("no_id"),
            F.coalesce(F.col(doc_id).cast("long"), F.lit(0)).alias("key"),
        )
        .sortWithinPartitions("down", "no_id", "key")
        .withColumn("place", F.monotonically_increasing_id())
    )
    none = F.lit(None).cast("long").alias("rank")
    total = runs.count()
    if drawn <= 0 or total == 0:
        return runs.select("row.*", none)
    n_segments = -(-total // segment_rows)
    if n_segments > 1:
        step = max(1, total // (n_segments * SAMPLES))
        # Every run starts at a place of its own, so that runs shorter than the step count.
        run, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit(_LAST))
        regular = F.pmod(at + F.pmod(F.xxhash64(run), F.lit(step)), F.lit(step)) == 0
        samples = sorted(tuple(row) for row in runs.where(regular).select(*order).collect())
        splitters = sorted({samples[len(samples) * k // n_segments] for k in range(1, n_segments)})
        runs = stored(runs.withColumn("segment", _segment(splitters)(*order)))
    else:
        runs = runs.withColumn("segment", F.lit(0).cast("long"))
    counts = dict(runs.groupBy("segment").count().collect())
    starts = [0]
    for segment in range(max(counts)):
        starts.append(starts[-1] + counts.get(segment, 0))
    last = max(segment for segment, start in enumerate(starts) if start < drawn)
    merged = Window.partitionBy("segment").orderBy(*order)
    place = F.row_number().over(merged) + F.element_at(F.lit(starts).cast("array<long>"), (F.col("segment") + 1).cast("int"))
    ranked = runs.where(F.col("segment") <= last).withColumn("rank", place.cast("long"))
    return union_all(
        [
            ranked.select("row.*", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")),
            runs.where(F.col("segment") > last).select("row.*", none),
        ]
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    ngram: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    segment_rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Draw `percent` of the documents of at least `least_words` words, rounded down, in
    favour of those like the target: doc_id, n_words, n_features, weight, score, rank.

    rank  1, 2, 3... by falling score, then id; null if not drawn

    Words are lower-cased by A-Z only and are runs of other characters than ASCII
    non-letters, non-digits. Texts are read twice and never shuffled. Null, empty and
    wordless texts weigh 0 and are not drawn; a null id counts as an empty one and goes
    last among ties; rows that repeat an id have the same noise and are drawn each.
    Empty tables give an empty result, an empty target one in which common features
    cost most. Other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    gains = bucket_gains(
        bucket_counts(narrow, "text", ngram, buckets), bucket_counts(target, target_text, ngram, buckets)
    )
    score = (F.col("weighed.weight") + noise(F.col("doc_id"), seed)).alias("score")
    scored = stored(weigh(narrow, gains, "text", ngram).select("doc_id", "weighed.*", score))
    enough = F.col("n_words") >= least_words
    eligible = scored.where(enough)
    drawn = percent * eligible.count() // 100
    rest = scored.where(~enough).withColumn("rank", F.lit(None).cast("long"))
    return highest(eligible, "score", "doc_id", drawn, segment_rows).unionByName(rest)
