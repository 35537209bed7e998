"""Byte-level BPE, both ways, in padded numpy matrices.

A text is cut into pieces by the vocabulary's pattern. Pieces not seen before go into
matrices by length, one row per piece and one column per byte. In every round each row
merges its leftmost pair of least rank, the pairs being looked up in a hash table; the
columns left empty are closed up and finished rows leave the matrix.

Rows of over `SHORT` columns merge all places of their least rank in the same round,
from the left and without overlap, up to the first one that makes a pair of lower rank:
one merge at a time would come to them in the same order.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import given_back, shared_object, small_batches

_NONE = np.iinfo(np.int32).max
_HASH = np.uint64(0x9E3779B97F4A7C15)
# Columns up to which a row merges one pair a round.
SHORT = 64
# Cells of one matrix; a longer piece has a matrix of its own.
MATRIX_CELLS = 1 << 18
# Characters of texts that are cut into pieces at once.
BLOCK_CHARS = 1 << 19
# Pieces, and their ids, that a Python worker remembers.
CACHED_PIECES, CACHED_IDS = 250_000, 1 << 20

_BREAK = regex.compile(r"\S(?=\s)")


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """Tokens and their ids from a rank file: a token in base 64 and its id per line."""
    pairs = (line.split() for line in lines.splitlines() if line.strip())
    return {base64.b64decode(token): int(number) for token, number in pairs}


class Merges:
    """Which pairs of ids merge, and into what, as an open-addressing hash table."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, made = [], [], []
        for token, number in ranks.items():
            for cut in range(1, len(token)):
                first = ranks.get(token[:cut])
                if first is not None and (second := ranks.get(token[cut:])) is not None:
                    left.append(first)
                    right.append(second)
                    made.append(number)
        self.made = np.array(made, dtype=np.int32)
        self.pairs = (np.array(left, dtype=np.uint64) << np.uint64(32)) | np.array(right, dtype=np.uint64)
        self.bits = max(4, int(2 * len(self.pairs)).bit_length())

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "values")}

    def _fill(self) -> None:
        """Every pair takes the first free slot from its own on."""
        size = 1 << self.bits
        self.keys = np.full(size, np.iinfo(np.uint64).max, dtype=np.uint64)
        self.values = np.full(size, _NONE, dtype=np.int32)
        waiting, slot = np.arange(len(self.pairs)), self._slot(self.pairs)
        while len(waiting):
            free = self.values[slot] == _NONE
            first = np.zeros(len(waiting), dtype=bool)
            first[np.unique(np.where(free, slot, -1), return_index=True)[1]] = True
            placed = free & first
            self.keys[slot[placed]] = self.pairs[waiting[placed]]
            self.values[slot[placed]] = self.made[waiting[placed]]
            waiting, slot = waiting[~placed], (slot[~placed] + 1) & (size - 1)

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((pairs * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """What the pairs merge into; the largest number where they do not. Ids below 0
        are empty places."""
        if not hasattr(self, "keys"):
            self._fill()
        out = np.full(left.shape, _NONE, dtype=np.int32)
        open_at = np.flatnonzero((left >= 0) & (right >= 0))
        pairs = (left.reshape(-1)[open_at].astype(np.int64) << 32 | right.reshape(-1)[open_at]).astype(np.uint64)
        slot = self._slot(pairs)
        flat = out.reshape(-1)
        while len(open_at):
            found, value = self.keys[slot], self.values[slot]
            same = found == pairs
            flat[open_at[same]] = value[same]
            on = ~same & (value != _NONE)
            open_at, pairs, slot = open_at[on], pairs[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out


def _merges_of_round(
    ids: np.ndarray, rank: np.ndarray, least: np.ndarray, merges: Merges
) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs that merge now."""
    if ids.shape[1] <= SHORT:
        return np.arange(len(ids)), rank.argmin(axis=1)
    hit = rank == least[:, None]
    at = np.arange(hit.shape[1])
    before = np.maximum.accumulate(np.where(hit, -1, at), axis=1)
    hit &= (at - before) % 2 == 1
    row, column = np.nonzero(hit)
    made = least[row]
    left = np.where(column > 0, ids[row, column - 1], -1)
    left[(column > 1) & hit[row, column - 2]] = made[(column > 1) & hit[row, column - 2]]
    right = np.where(column + 2 < ids.shape[1], ids[row, np.minimum(column + 2, ids.shape[1] - 1)], -1)
    lower = np.minimum(merges.look_up(left, made), merges.look_up(made, right)) < made
    if lower.any():
        stop = np.full(len(ids), ids.shape[1])
        np.minimum.at(stop, row[lower], column[lower])
        row, column = row[column <= stop[row]], column[column <= stop[row]]
    return row, column


def merge_rows(ids: np.ndarray, merges: Merges) -> np.ndarray:
    """Merge the rows of a matrix of ids, padded with -1 at the right, to the end.

    `rank` has at each place what the id there and the next one merge into.
    """
    out = np.full_like(ids, -1)
    rows = np.arange(len(ids))
    rank = np.full_like(ids, _NONE)
    rank[:, :-1] = merges.look_up(ids[:, :-1], ids[:, 1:])
    while True:
        least = rank.min(axis=1)
        ended = least == _NONE
        if ended.any():
            out[rows[ended], : ids.shape[1]] = ids[ended]
            rows, ids, rank, least = rows[~ended], ids[~ended], rank[~ended], least[~ended]
        if not len(rows):
            return out
        row, column = _merges_of_round(ids, rank, least, merges)
        ids[row, column] = least[row]
        kept = np.ones(ids.shape, dtype=bool)
        kept[row, column + 1] = False
        n, width = ids.shape
        if len(row) == n and width <= SHORT:
            width -= 1
            ids, rank = ids[kept].reshape(n, width), rank[kept].reshape(n, width)
            merged = column
        else:
            place = np.cumsum(kept, axis=1) - 1
            width = int(place[:, -1].max()) + 1
            merged = place[row, column]
            of_row, at = np.nonzero(kept)
            to = place[of_row, at]
            ids, rank = _moved(ids, of_row, at, to, -1, width), _moved(rank, of_row, at, to, _NONE, width)
        after = np.minimum(merged + 1, width - 1)
        rank[row, merged] = np.where(
            merged + 1 < width, merges.look_up(ids[row, merged], ids[row, after]), _NONE
        )
        inner = merged > 0
        row, merged = row[inner], merged[inner]
        rank[row, merged - 1] = merges.look_up(ids[row, merged - 1], ids[row, merged])


def _moved(cells: np.ndarray, row: np.ndarray, at: np.ndarray, to: np.ndarray, empty: int, width: int) -> np.ndarray:
    out = np.full((len(cells), width), empty, dtype=cells.dtype)
    out[row, to] = cells[row, at]
    return out


class BytePairs:
    """Encodes and decodes with the tokens of a rank file. Every single byte must be a
    token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        self.ranks, self.pattern = ranks, pattern
        self.merges = Merges(ranks)
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, number in ranks.items():
            tokens[number] = token
        self.sizes = np.array(list(map(len, tokens)), dtype=np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.cut = None

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.ids = np.empty(1 << 14, dtype=np.int32)
        self.first = np.zeros(1 << 12, dtype=np.int64)
        self.used = 0

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, one after the other, and how many each has: its own if it
        is a token, else what its bytes merge into."""
        known = np.fromiter(map(self.ranks.get, pieces, repeat(-1)), np.int32, len(pieces))
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        parts, owners = [known[known >= 0]], [np.flatnonzero(known >= 0)]
        others = np.flatnonzero(known < 0)
        bucket = np.ceil(np.log2(length[others])).astype(np.int64)
        for power in np.unique(bucket).tolist():
            members = others[bucket == power]
            step = max(1, MATRIX_CELLS >> power)
            for start in range(0, len(members), step):
                chosen = members[start : start + step]
                data = np.frombuffer(b"".join([pieces[at] for at in chosen.tolist()]), dtype=np.uint8)
                matrix = np.full((len(chosen), length[chosen].max()), -1, dtype=np.int32)
                matrix[np.arange(matrix.shape[1]) < length[chosen, None]] = self.byte_ids[data]
                merged = merge_rows(matrix, self.merges)
                parts.append(merged[merged >= 0])
                owners.append(np.repeat(chosen, (merged >= 0).sum(axis=1)))
        owner = np.concatenate(owners)
        ids = np.concatenate(parts)[np.argsort(owner, kind="stable")]
        return ids, np.bincount(owner, minlength=len(pieces))

    def _learn(self, pieces: list[str]) -> None:
        made, sizes = self.encode_pieces([piece.encode() for piece in pieces])
        known, new, total = len(self.number), len(pieces), len(made)
        if self.used + total > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.used + total))
        if known + new + 1 > len(self.first):
            self.first = np.resize(self.first, 2 * (known + new + 1))
        self.number.update(zip(pieces, range(known, known + new)))
        self.ids[self.used : self.used + total] = made
        self.first[known + 1 : known + new + 1] = self.used + np.cumsum(sizes)
        self.used += total

    def _blocks(self, text: str) -> Iterator[str]:
        """The text in blocks that end before white space, where a piece always ends."""
        at = 0
        while len(text) - at > BLOCK_CHARS:
            found = _BREAK.search(text, at + BLOCK_CHARS)
            if not found:
                break
            yield text[at : found.end()]
            at = found.end()
        yield text[at:]

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        lists = [self.cut.findall(text) for text in texts]
        pieces = list(chain.from_iterable(lists))
        number = np.fromiter(map(self.number.get, pieces, repeat(-1)), np.int64, len(pieces))
        missing = np.flatnonzero(number < 0)
        if len(missing):
            unknown = [pieces[at] for at in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            number[missing] = list(map(self.number.__getitem__, unknown))
        first = self.first[number]
        sizes = self.first[number + 1] - first
        after = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.arange(after[-1]) + np.repeat(first - after[:-1], sizes)]
        ends = after[np.cumsum([0, *map(len, lists)])]
        if len(self.number) > CACHED_PIECES or self.used > CACHED_IDS:
            self._clear()
        return [ids[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        if self.cut is None:
            self.cut = regex.compile(self.pattern)
            self._clear()
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > BLOCK_CHARS:
                yield from self._encode_some(held)
                held, size = [], 0
                yield np.concatenate([self._encode_some([block])[0] for block in self._blocks(text)])
                continue
            held.append(text)
            size += len(text)
            if size >= BLOCK_CHARS:
                yield from self._encode_some(held)
                held, size = [], 0
        yield from self._encode_some(held)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """The bytes of the ids; None if one is not in the vocabulary."""
        ids = ids.astype(np.int64)
        if len(ids) and (ids.max() >= len(self.sizes) or (self.sizes[ids] == 0).any()):
            return None
        sizes = self.sizes[ids]
        after = np.cumsum(sizes)
        total = int(after[-1]) if len(ids) else 0
        return self.bytes[np.arange(total) + np.repeat(self.starts[ids] - after + sizes, sizes)].tobytes()

    def __getstate__(self):
        gone = ("number", "ids", "first", "used")
        return {k: v for k, v in self.__dict__.items() if k not in gone} | {"cut": None}


def encode_texts(docs: DataFrame, coder: BytePairs, text: str = "text", into: str = "encoded") -> DataFrame:
    """Add the column `into`: n_tokens long, ids binary (little-endian 32-bit ids).

    A null or empty text has no ids. Bytes that are not UTF-8 count as U+FFFD. Rows are
    encoded in place, nothing is shuffled; repeated rows, null ids and further columns
    pass through, a column called `into` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = shared_object(docs.sparkSession, coder)

    @F.pandas_udf("n_tokens long, ids binary")
    @given_back
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [value.decode("utf-8", "replace") if value else "" for value in batch.tolist()]
            rows = [(len(ids), ids.astype("<u4").tobytes()) for ids in shared().encode(texts)]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids"])

    return docs.withColumn(into, encode(F.col(text).cast("binary")))


def decode_ids(encoded: DataFrame, coder: BytePairs, ids: Column, into: str = "decoded") -> DataFrame:
    """Add the column `into`: the bytes that the ids stand for.

    ids  binary, little-endian 32-bit

    Null ids, ids outside of the vocabulary and broken binaries give null. Other columns
    pass through, a column called `into` is replaced.
    """
    small_batches(encoded.sparkSession)
    shared = shared_object(encoded.sparkSession, coder)

    @F.pandas_udf("binary")
    @given_back
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            whole = (value if value is not None and len(value) % 4 == 0 else None for value in batch.tolist())
            made = [
                None if value is None else shared().decode(np.frombuffer(value, dtype="<u4")) for value in whole
            ]
            yield pd.Series(made, dtype=object)

    return encoded.withColumn(into, decode(ids))
