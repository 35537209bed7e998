"""Benchmark decontamination with a generalised suffix automaton.

The automaton holds every run of words of the benchmark items. Training texts stream
through it word by word, and it keeps the length of the longest run that ends at the
current word. A text's words are hit where that length reaches the window.

Before that, numpy finds the stretches whose short word sequences all occur in some
item; nothing outside of them can hold a window, so only they go through the automaton.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import WORD_BYTES, given_back, mixed, shared_object, small_batches, stored

# Benchmark words in one automaton; a larger benchmark is matched block by block.
BLOCK_WORDS = 200_000
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MATCH = "n_words long, spans array<struct<start: int, end: int>>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class SuffixAutomaton:
    """Of several sequences of numbers; states are numbers, 0 is the empty run."""

    def __init__(self):
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of `target` for the runs that `state` reaches by `symbol`."""
        copy = self._state(self.length[state] + 1, dict(self.step[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.step[state].get(symbol) == target:
            self.step[state][symbol] = copy
            state = self.link[state]
        return copy

    def add(self, sequence: Iterable[int]) -> None:
        last = 0
        for symbol in sequence:
            known = self.step[last].get(symbol)
            if known is not None:
                fits = self.length[known] == self.length[last] + 1
                last = known if fits else self._split(last, symbol, known)
                continue
            state, last = last, self._state(self.length[last] + 1, {}, 0)
            while state >= 0 and symbol not in self.step[state]:
                self.step[state][symbol] = last
                state = self.link[state]
            if state >= 0:
                target = self.step[state][symbol]
                fits = self.length[target] == self.length[state] + 1
                self.link[last] = target if fits else self._split(state, symbol, target)

    def forward(self, state: int, length: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest known run that ends with `symbol`."""
        while state and symbol not in self.step[state]:
            state = self.link[state]
            length = self.length[state]
        following = self.step[state].get(symbol)
        return (0, 0) if following is None else (following, length + 1)

    def holding(self, state: int, length: int) -> int:
        """The state of the last `length` symbols of a run in `state`."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Matcher:
    """A block of benchmark items, ready to match texts.

    window  words in a row of an item that count as a hit; an item with fewer words
            counts as a whole
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.numbers: dict[bytes, int] = {}
        self.automaton = SuffixAutomaton()
        coded = [
            (item, [self.numbers.setdefault(w, len(self.numbers)) for w in words])
            for item, words in items
            if words
        ]
        for _, code in coded:
            self.automaton.add(code)
        # State -> items that hold the window; state -> short items (length, item).
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, list[tuple[int, str]]] = {}
        for item, code in coded:
            state = length = 0
            for symbol in code:
                state, length = self.automaton.forward(state, length, symbol)
                if length >= window:
                    self.owners.setdefault(self.automaton.holding(state, window), set()).add(item)
            if len(code) < window:
                at = self.automaton.holding(state, len(code))
                self.short.setdefault(at, []).append((len(code), item))
        self.least = min((min(window, len(code)) for _, code in coded), default=0)
        self.gram = min(3, self.least)
        grams = [self._grams(np.array(code, dtype=np.int64)) for _, code in coded]
        self.known = np.unique(np.concatenate(grams)) if grams else np.empty(0, np.uint64)

    def _grams(self, numbers: np.ndarray) -> np.ndarray:
        n = len(numbers) - self.gram + 1
        code = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(self.gram if n > 0 else 0):
            code = mixed(code + numbers[k : n + k].astype(np.uint64) + np.uint64(1))
        return code

    def stretches(self, numbers: np.ndarray) -> Iterator[tuple[int, int]]:
        """Where windows can lie: word ranges whose grams are all known."""
        grams = self._grams(numbers)
        place = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        hit = np.concatenate(([False], self.known[place] == grams, [False]))
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        for start, end in zip(edges[::2], edges[1::2]):
            if end - start + self.gram - 1 >= self.least:
                yield int(start), int(end) + self.gram - 1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that are hit, in order and apart, and the items they are of."""
        if len(words) < max(self.least, 1) or not self.least:
            return [], set()
        get = self.numbers.get
        numbers = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        automaton = self.automaton
        for start, end in self.stretches(numbers):
            state = length = 0
            for at, symbol in enumerate(numbers[start:end].tolist(), start):
                state, length = automaton.forward(state, length, symbol)
                reach = 0
                if length >= self.window:
                    reach = length
                    items |= self.owners[automaton.holding(state, self.window)]
                if self.short:
                    up, most = state, length
                    while up > 0:
                        for size, item in self.short.get(up, ()):
                            if size <= most:
                                reach = max(reach, size)
                                items.add(item)
                        up = automaton.link[up]
                        most = automaton.length[up]
                if reach:
                    first = at + 1 - reach
                    while spans and spans[-1][1] >= first:
                        first = min(first, spans.pop()[0])
                    spans.append((first, at + 1))
        return spans, items


def _blocks(items: DataFrame, item_id: str, text: str, size: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items with their words, at most about `size` words at a time."""
    rows = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
        F.col(text).cast("binary").alias("text"),
    )
    block, held = [], 0
    for row in rows.toLocalIterator():
        words = words_of(bytes(row["text"]) if row["text"] is not None else None)
        if held and held + len(words) > size:
            yield block
            block, held = [], 0
        block.append((row["item"], words))
        held += len(words)
    yield block


def match_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 13,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """Add `match`: n_words, spans (word ranges [start, end) that are hit, in order)
    and items (ids as strings, sorted, each once).

    A null or wordless text has 0 words and no spans; a null or wordless item hits
    nothing; a null item id is the empty string. Repeated rows and further columns
    stay; a column called match is replaced. A benchmark of over `block_words` words
    is matched block by block, with the texts so far stored in between.
    """
    small_batches(docs.sparkSession)
    blocks = _blocks(items, item_id, item_text, block_words)
    block, first = next(blocks), True
    while block is not None:
        found = _matched(docs, shared_object(docs.sparkSession, Matcher(block, window)), text)
        if not first:
            found = found.withColumn("match", _merged("_before", "match")).drop("_before")
        block, first = next(blocks, None), False
        docs = found if block is None else stored(found).withColumnRenamed("match", "_before")
    return docs


def _matched(docs: DataFrame, matcher, text: str) -> DataFrame:
    @F.pandas_udf(_MATCH)
    @given_back
    def match(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        found = matcher()
        for batch in batches:
            rows = []
            for value in batch:
                words = words_of(value)
                spans, items = found.match(words)
                rows.append(
                    (len(words), [{"start": a, "end": b} for a, b in spans], sorted(items))
                )
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return docs.withColumn("match", match(F.col(text).cast("binary")))


def _merged(left: str, right: str):
    """Matches of two blocks as one."""
    either = F.sort_array(F.concat(F.col(f"{left}.spans"), F.col(f"{right}.spans")))

    def add(kept, span):
        last = F.get(kept, F.size(kept) - 1)
        longer = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end")
        )
        joined = F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(longer))
        return F.when(
            (F.size(kept) > 0) & (last["end"] >= span["start"]), joined
        ).otherwise(F.concat(kept, F.array(span)))

    return F.struct(
        F.col(f"{right}.n_words").alias("n_words"),
        F.aggregate(either, F.filter(either, lambda _: F.lit(False)), add).alias("spans"),
        F.sort_array(F.array_union(f"{left}.items", f"{right}.items")).alias("items"),
    )


def hit_words() -> Column:
    """Words of a `match` that are hit."""
    return F.aggregate(
        "match.spans", F.lit(0).cast("long"), lambda n, span: n + span["end"] - span["start"]
    )


def is_contaminated(share: int = 20) -> Column:
    """At least one hit word, and one of `share` words or more is hit."""
    return (hit_words() > 0) & (hit_words() * share >= F.col("match.n_words"))


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the given ranges of words (in order, apart) and what stands
    between their words."""
    between = F.split(text, _WORD, -1)
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    both = F.zip_with(between, words, lambda gap, word: F.concat(gap, F.coalesce(word, F.lit(""))))
    firsts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda span: span["end"]))
    lasts = F.concat(F.transform(spans, lambda span: span["start"]), F.array(F.size(words)))
    kept = F.zip_with(
        firsts,
        lasts,
        lambda first, last: F.concat(F.array_join(F.slice(both, first + 1, last - first), ""), between[last]),
    )
    return F.array_join(kept, "")


def remove_spans(docs: DataFrame, text: str = "text", share: int = 20) -> DataFrame:
    """Takes `match` and drops it. Of texts that `is_contaminated` says are, the hit
    spans go, and a row whose text has no word left goes too. Other rows stay as they
    are, null and empty texts included."""

    dirty = F.col("_dirty")
    left = F.when(dirty, without_spans(F.col(text), F.col("match.spans")))
    shortened = F.when(left.rlike(_WORD), left)
    return (
        docs.withColumn("_dirty", is_contaminated(share))
        .withColumn("_cut", shortened)
        .where(~dirty | F.col("_cut").isNotNull())
        .withColumn(text, F.when(dirty, F.col("_cut")).otherwise(F.col(text)))
        .drop("match", "_dirty", "_cut")
    )
