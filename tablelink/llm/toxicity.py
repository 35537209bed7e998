"""Toxicity: a subsequence string kernel, Nystroem landmarks and a linear SVM.

The kernel compares two strings by the letter triples they share as subsequences; a
triple counts less the more letters lie inside it, so gapped and inserted characters
cost a little and do not hide a word. Strings are windows of up to eight letters of a
text's words: accents are dropped, characters that are no letters are skipped inside a
word, and letters that stand alone are joined ("i d i o t"). Words of two and three
letters have marks at their ends, so that they have triples.

Extra windows find hidden words: short words joined with their neighbours ("sc um"), digits
and signs read as the letters they look like ("1d10t"), and masks filled in with the
letters of a landmark that fits ("sc*m"). They count only from a margin on that clean
training texts do not reach, and not at all if a clean one has them.

Letters are the 26 Latin ones and 227 classes of all others, by base character. Scripts
that write words without spaces have a window for every two neighbouring characters too.

Landmarks are letter sequences that toxic training texts have and others lack, chosen
until they cover the toxic texts. With them a window's features are the Nystroem map of
its kernel values. A linear support vector machine separates the windows of clean texts
from the worst window of each toxic text, chosen anew in each round. The SVM of the
features is a sum over the triples of a window, so scoring needs one table.

Labels are of whole texts, and texts are not cut into sentences: a text's score is that
of its worst window, put through a logistic fit.
"""

from __future__ import annotations

import unicodedata
import warnings
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import crc_of_id, distinct, given_back, mixed, shared_object, small_batches

WINDOW = 8
SHORTEST = 4  # letters of a word that has windows without marks at its ends
DECAY = 0.6
LANDMARKS = 64
# Kernel value with some landmark from which a toxic text's window is learned from.
NEAR = 0.5
# Symbols of windows: 0 none, 26 letters, any character, a word's end, other letters.
_ANY = 27
_END = 28
_OTHERS = 227
_BITS = 8
_CODES = 1 << 17
_STEM = 5
SEEN = 1 << 18
_BLOCK = 1 << 18

_TRIPLES = np.array(list(combinations(range(WINDOW), 3)))
_WEIGHTS = DECAY ** (_TRIPLES[:, 2] - _TRIPLES[:, 0] + 1)
_SPACE, _MARK = -1, -2
_LOOK_ALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_TABLED = 0x3000


def _class(point: int) -> int:
    """Symbol of a code point: 1-26 by base letter, from 29 on other letters by their
    lower-cased base character, 0 for no letter, or white space, or a combining mark."""
    char = chr(point)
    if char.isspace():
        return _SPACE
    if unicodedata.category(char)[0] == "M":
        return _MARK
    whole = unicodedata.normalize("NFKC", char)[0]
    # Syllables of Hangul are letters as they are, not their first consonant.
    base = whole if "\uac00" <= whole <= "\ud7a3" else unicodedata.normalize("NFKD", whole)[0].lower()[0]
    if "a" <= base <= "z":
        return ord(base) - 96
    return _END + 1 + ord(base) % _OTHERS if base.isalpha() else 0


_CLASS = np.array([_class(point) for point in range(_TABLED)], dtype=np.int16)
_RARE: dict[int, int] = {}


def _classes(points: np.ndarray) -> np.ndarray:
    kind = _CLASS[np.minimum(points, _TABLED - 1)]
    rare = points >= _TABLED
    if rare.any():
        different, place = np.unique(points[rare], return_inverse=True)
        for point in different.tolist():
            if point not in _RARE:
                _RARE[point] = _class(point)
        kind[rare] = np.array([_RARE[point] for point in different.tolist()], dtype=np.int16)[place]
    return kind


def _packed_at(symbols: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows of at most eight of the symbols."""
    padded = np.append(symbols, np.zeros(WINDOW, symbols.dtype)).astype(np.uint64)
    packed = np.zeros(len(first), dtype=np.uint64)
    for k in range(WINDOW):
        packed |= np.where(lengths > k, padded[first + k], np.uint64(0)) << np.uint64(_BITS * k)
    return packed


def _ended(packed: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows of short words with marks at both ends, so that they have triples."""
    end = np.uint64(_END)
    return end | packed << np.uint64(_BITS) | end << (lengths + 1).astype(np.uint64) * np.uint64(_BITS)


def _of_words(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of words given by their symbols and starts, and where they begin: every
    second symbol of a longer word begins one, and so does the last full one."""
    sizes = np.diff(np.append(starts, len(symbols)))
    size = np.repeat(sizes, sizes)
    at = np.arange(len(symbols)) - np.repeat(starts, sizes)
    left = size - at
    first = np.flatnonzero((size >= SHORTEST) & ((at == 0) | ((left >= WINDOW) & ((at % 2 == 0) | (left == WINDOW)))))
    short = (sizes > 1) & (sizes < SHORTEST)
    small, lengths = starts[short], sizes[short]
    packed = (_packed_at(symbols, first, left[first]), _ended(_packed_at(symbols, small, lengths), lengths))
    return np.concatenate(packed), np.concatenate((first, small))


def _across(symbols: np.ndarray, starts: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows across one white space beside a word of up to three letters, and of three
    and more such words."""
    if len(starts) < 2:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(symbols)))
    beside = word[starts[1:]] - word[starts[:-1]] == 1
    short = sizes < SHORTEST
    a, b = sizes[:-1], sizes[1:]
    before = np.where(short[1:], np.minimum(a, WINDOW - b), a)
    lengths = np.minimum(before + b, WINDOW)
    pairs = np.flatnonzero(beside & (short[1:] | short[:-1]) & (lengths > 2))
    first, lengths = starts[1:][pairs] - before[pairs], lengths[pairs]
    packed = _packed_at(symbols, first, lengths)
    packed = np.where(lengths < SHORTEST, _ended(packed, np.minimum(lengths, SHORTEST)), packed)
    # Runs of short words: a run goes on where both sides of a white space are short.
    on = np.append(beside & short[1:] & short[:-1], False)
    stops = np.flatnonzero(~on)
    last = stops[np.searchsorted(stops, np.arange(len(starts)))]
    runs = np.flatnonzero(last >= np.arange(len(starts)) + 2)
    reach = np.minimum(starts[last[runs]] + sizes[last[runs]] - starts[runs], WINDOW)
    three = np.minimum(starts[runs + 2] + sizes[runs + 2] - starts[runs], WINDOW)
    parts, places = [packed], [first]
    for reached in (reach, three):
        fit = reached >= SHORTEST
        parts.append(_packed_at(symbols, starts[runs][fit], reached[fit]))
        places.append(starts[runs][fit])
    return np.concatenate(parts), np.concatenate(places)


def _starts(word: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.empty(0, np.int64)


def _masked(points: np.ndarray, kind: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Windows of words with characters that are no letters, and their places: those
    characters as any letter, and digits and signs as the letters that they look like."""
    alike = np.zeros(128, dtype=np.int16)
    alike[[ord(c) for c in _LOOK_ALIKE]] = [ord(c) - 96 for c in _LOOK_ALIKE.values()]
    edge = np.zeros(128, dtype=bool)
    edge[[ord(c) for c in "0123456789@$*"]] = True
    ascii_point = np.minimum(points, 127)
    # From the first letter, digit or mask of a word to its last letter.
    inner = (kind > 0) | ((kind == 0) & (points < 128) & edge[ascii_point])
    n_words = int(word[-1]) + 1
    at = np.arange(len(kind))
    low, high = np.full(n_words, len(kind)), np.full(n_words, -1)
    np.minimum.at(low, word[inner], at[inner])
    np.maximum.at(high, word[kind > 0], at[kind > 0])
    hidden = (kind == 0) & (at >= low[word]) & (at < high[word])
    read = (kind == 0) & inner & (alike[ascii_point] > 0)
    mixed_words = (np.bincount(word[hidden | read], minlength=n_words) > 0) & (
        np.bincount(word[kind > 0], minlength=n_words) > 1)
    out = []
    place = np.flatnonzero(mixed_words[word] & (hidden | (kind > 0)))
    packed, first = _of_words(np.where(kind[place] > 0, kind[place], _ANY), _starts(word[place]))
    letters = letters_of(packed)
    masks = (letters == _ANY).sum(axis=1)
    plain = ((letters > 0) & (letters != _ANY) & (letters != _END)).sum(axis=1)
    # Masks around letters, one at most before them: others could stand for anything.
    last = np.maximum((letters > 0).sum(axis=1) - 1, 0)
    ends = letters[np.arange(len(letters)), last] == _ANY
    begins = (letters[:, 0] == _ANY) & (letters[:, 1] == _ANY)
    good = (masks > 0) & (masks <= 3) & (plain > 1) & ~ends & ~begins
    out.append((packed[good], place[first[good]]))
    seen = np.where(read, alike[ascii_point], np.maximum(kind, 0))
    place = np.flatnonzero(mixed_words[word] & (seen > 0))
    packed, first = _of_words(seen[place], _starts(word[place]))
    out.append((packed, place[first]))
    return out


def _unspaced(points: np.ndarray) -> np.ndarray:
    """Characters of scripts that write words without spaces, or in two or three signs."""
    p = points
    return ((p >= 0x0E00) & (p < 0x1000)) | ((p >= 0x1780) & (p < 0x1800)) | ((p >= 0x3041) & (p < 0xA000)) | (
        (p >= 0xAC00) & (p < 0xD7B0)) | ((p >= 0xF900) & (p < 0xFB00)) | ((p >= 0x20000) & (p < 0x32000))


def windows_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts' words, packed eight bits a symbol, and their text's
    number, in order."""
    return _both(texts, False)[0]


def _both(texts: list[str], extra: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """The windows of words as they are written; and if asked, the extra ones: across a
    white space beside short words, and of masked words."""
    nothing = (np.empty(0, np.uint64), np.empty(0, np.int64))
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), lengths)
    kind = _classes(points)
    if (kind == _MARK).any():
        points, owner, kind = points[kind != _MARK], owner[kind != _MARK], kind[kind != _MARK]
    word = np.cumsum(kind == _SPACE)
    letter = np.flatnonzero(kind > 0)
    if not len(letter):
        return [nothing, nothing]
    symbols, word_of, owner_of = kind[letter], word[letter], owner[letter]
    # Letters that are words of their own join with such neighbours.
    fresh = np.append(True, word_of[1:] != word_of[:-1])
    alone = fresh & np.append(fresh[1:], True)
    begins = fresh & ~(alone & np.append(False, alone[:-1]) & np.append(False, owner_of[1:] == owner_of[:-1]))
    packed, first = _of_words(symbols, np.flatnonzero(begins))
    parts = [(packed, owner_of[first])]
    dense = _unspaced(points[letter])
    if dense.any():
        two = np.flatnonzero(dense[:-1] & dense[1:] & ~fresh[1:])
        size = np.full(len(two), 2)
        parts.append((_ended(_packed_at(symbols, two, size), size), owner_of[two]))
    hidden = [nothing]
    if extra:
        # Texts end with a white space; with their numbers added no two have neighbours.
        packed, first = _across(symbols, np.flatnonzero(fresh), word_of + owner_of)
        hidden.append((packed, owner_of[first]))
        hidden += [(packed, owner[place]) for packed, place in _masked(points, kind, word)]
    return [_by_owner(parts), _by_owner(hidden)]


def _by_owner(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    packed, owners = (np.concatenate(part) for part in zip(*parts))
    order = np.argsort(owners, kind="stable")
    return packed[order], owners[order]


def letters_of(packed: np.ndarray) -> np.ndarray:
    """Window x symbol."""
    shifts = np.arange(WINDOW, dtype=np.uint64) * np.uint64(_BITS)
    return ((packed[:, None] >> shifts) & np.uint64(255)).astype(np.int32)


def _packed(word: str) -> int:
    return sum((ord(c) - 96) << (_BITS * k) for k, c in enumerate(word))


def _parts_of_codes() -> np.ndarray:
    """Place in a triple x symbol: what it adds to the triple's code. Triples of the 26
    letters and the two marks have codes of their own, others are hashed."""
    parts = mixed(np.arange(3 * 256, dtype=np.uint64) + np.uint64(1)).reshape(3, 256) >> np.uint64(64 - 17)
    parts[:, : _END + 1] = np.arange(_END + 1, dtype=np.uint64) * np.array([[841], [29], [1]], np.uint64)
    return parts.astype(np.int32)


_PARTS = _parts_of_codes()


def _coded(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, (_PARTS[0][a] + _PARTS[1][b] + _PARTS[2][c]) & (_CODES - 1), 0)


def _codes(packed: np.ndarray) -> np.ndarray:
    """Codes of the triples of each window; 0 where a triple has no third letter, or one
    that is any letter."""
    letters = letters_of(packed)
    a, b, c = (letters[:, _TRIPLES[:, k]] for k in range(3))
    codes = np.where(c > 0, (_PARTS[0][a] + _PARTS[1][b] + _PARTS[2][c]) & (_CODES - 1), 0)
    some = np.flatnonzero((letters == _ANY).any(axis=1))
    if len(some):
        codes[some] = np.where((letters[some] == _ANY)[:, _TRIPLES].any(axis=2), 0, codes[some])
    return codes


def _profiles(packed: np.ndarray) -> np.ndarray:
    """Window x code: the normalised weights of a few windows, as a dense table."""
    table = np.zeros((len(packed), _CODES))
    codes = _codes(packed)
    rows = np.repeat(np.arange(len(packed)), codes.shape[1])
    np.add.at(table, (rows, codes.ravel()), np.tile(_WEIGHTS, len(packed)))
    table[:, 0] = 0
    norm = np.sqrt((table**2).sum(axis=1, keepdims=True))
    return table / np.maximum(norm, 1e-9)


def _filled(packed: np.ndarray, landmarks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Windows with masks as what they may stand for, and which window that is: for each
    landmark that fits somewhere, with its letters in place of the masks there."""
    any_byte = np.zeros(len(packed), dtype=np.uint64)
    for k in range(WINDOW):
        at = np.uint64(_BITS * k)
        any_byte |= np.where((packed >> at) & np.uint64(255) == _ANY, np.uint64(255) << at, np.uint64(0))
    made, source = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for landmark in landmarks:
        length = -(-int(landmark).bit_length() // _BITS)
        for k in range(WINDOW - length + 1):
            shift = np.uint64(_BITS * k)
            part = np.uint64(((1 << (_BITS * length)) - 1) << (_BITS * k))
            own = np.uint64(landmark) << shift
            fits = ((packed ^ own) & part & ~any_byte == 0) & (any_byte & part != 0)
            # At least two letters are not masked.
            for at in np.flatnonzero(fits).tolist():
                if length - int(any_byte[at] & part).bit_count() // _BITS >= 2:
                    masks = any_byte[at] & part
                    made.append(np.array([(packed[at] & ~masks) | (own & masks)]))
                    source.append(np.array([at]))
    return np.concatenate(made), np.concatenate(source)


def hidden_windows(texts: list[str], landmarks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The extra windows of the texts and their text's number; masks are filled in."""
    return _read(*_both(texts)[1], landmarks)


def _read(packed: np.ndarray, owner: np.ndarray, landmarks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    masked = (letters_of(packed) == _ANY).any(axis=1)
    different, place = np.unique(packed[masked], return_inverse=True)
    filled, source = _filled(different, landmarks)
    # Every text with a masked window has all that it may stand for.
    order = np.argsort(place, kind="stable")
    owners = owner[masked][order]
    counts = np.bincount(place, minlength=len(different))
    first = np.cumsum(counts) - counts
    parts = [(packed[~masked], owner[~masked])]
    for window, of in zip(filled, source.tolist()):
        texts_of = owners[first[of] : first[of] + counts[of]]
        parts.append((np.full(len(texts_of), window), texts_of))
    return _by_owner(parts)


def _norms(codes: np.ndarray) -> np.ndarray:
    """The kernel of each window with itself, rooted."""
    order = np.argsort(codes, axis=1, kind="stable")
    ordered = np.take_along_axis(codes, order, axis=1)
    weights = np.where(ordered > 0, _WEIGHTS[order], 0.0)
    total = np.cumsum(weights, axis=1)
    last = np.ones(codes.shape, dtype=bool)
    last[:, :-1] = ordered[:, 1:] != ordered[:, :-1]
    # Sums of the runs of equal codes: differences of the running sum at their ends.
    ends = np.where(last, total, 0.0)
    before = np.maximum.accumulate(ends, axis=1)
    before = np.concatenate((np.zeros((len(codes), 1)), before[:, :-1]), axis=1)
    return np.sqrt(np.maximum((np.where(last, total - before, 0.0) ** 2).sum(axis=1), 1e-9))


@dataclass(frozen=True)
class ToxicityModel:
    table: np.ndarray  # value of each triple code
    bias: float
    slope: float
    offset: float
    landmarks: tuple[int, ...]
    # Extra windows count from this margin on, if no clean training text has them.
    barrier: float = np.inf
    excused: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))


def margins(table: np.ndarray, bias: float, packed: np.ndarray) -> np.ndarray:
    """SVM margin of each window."""
    out = np.empty(len(packed))
    for at in range(0, len(packed), 1 << 13):
        codes = _codes(packed[at : at + (1 << 13)])
        out[at : at + len(codes)] = (table[codes] * _WEIGHTS).sum(axis=1) / _norms(codes) + bias
    return out


class SeenWindows:
    """Remembers a number for each window seen, up to `most` windows; then it starts anew.

    Texts share most of their windows, whose margins need not be made again.
    """

    def __init__(self, most: int = SEEN):
        self.most = most
        self.packed, self.value = np.empty(0, np.uint64), np.empty(0)

    def of(self, packed: np.ndarray, make: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The numbers of different sorted windows; `make` gives those of new ones."""
        place = np.searchsorted(self.packed, packed)
        known = np.zeros(len(packed), dtype=bool)
        inside = place < len(self.packed)
        known[inside] = self.packed[place[inside]] == packed[inside]
        out = np.empty(len(packed))
        out[known] = self.value[place[known]]
        new = packed[~known]
        if len(new):
            out[~known] = made = make(new)
            if len(self.packed) + len(new) > self.most:
                self.packed, self.value = packed[: self.most], out[: self.most]
            else:
                self.packed = np.insert(self.packed, place[~known], new)
                self.value = np.insert(self.value, place[~known], made)
        return out


class Seen:
    """What a task remembers of the windows it has met, for one model."""

    def __init__(self):
        self.margin, self.high = SeenWindows(), SeenWindows()


def _above(table: np.ndarray, bias: float, packed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The windows with at least such a margin, and their margins."""
    found = []
    for at in range(0, len(packed), 1 << 13):
        part = packed[at : at + (1 << 13)]
        codes = _codes(part)
        value = (table[codes] * _WEIGHTS).sum(axis=1)
        # Equal triples add up, so a window's norm is that of different ones or more.
        norm = np.sqrt(((codes > 0) * _WEIGHTS**2).sum(axis=1))
        found.append(part[value >= (least - bias) * norm] if least > bias else part)
    kept = np.concatenate([np.empty(0, np.uint64), *found])
    made = margins(table, bias, kept)
    return kept[made >= least], made[made >= least]


def _counted(model: ToxicityModel, packed: np.ndarray) -> np.ndarray:
    """Margins of extra windows, sorted, that count; -inf for others."""
    high, values = _above(model.table, model.bias, packed, model.barrier)
    out = np.full(len(packed), -np.inf)
    new = _without(high, model.excused)
    out[np.searchsorted(packed, high[new])] = values[new]
    return out


def _without(packed: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of the windows are not in the sorted known ones."""
    if not len(known):
        return np.ones(len(packed), dtype=bool)
    return known[np.minimum(np.searchsorted(known, packed), len(known) - 1)] != packed


def _excused(
    table: np.ndarray, bias: float, cut: float, landmarks: tuple[int, ...], texts: list[str]
) -> tuple[float, np.ndarray]:
    """The margin that extra windows must reach, and those that never count: what clean
    texts have. The margin lets one in 500 pass of the clean texts of one half, without
    the windows of the other half."""
    seen = [distinct(hidden_windows([text], landmarks)[0]) for text in texts]
    every, values = _above(table, bias, distinct(np.concatenate([np.empty(0, np.uint64), *seen])), cut)
    hits = [text[~_without(text, every)] if len(every) else text[:0] for text in seen]
    halves = [distinct(np.concatenate([np.empty(0, np.uint64), *hits[half::2]])) for half in (0, 1)]
    worst = [
        values[np.searchsorted(every, text[_without(text, halves[1 - at % 2])])].max(initial=cut)
        for at, text in enumerate(hits)
    ]
    return float(np.quantile(worst, 0.998, method="higher")), every


def _stems(packed: np.ndarray) -> np.ndarray:
    """Sequences of five symbols inside the windows, and whole windows of fewer."""
    mask = np.uint64((1 << (_BITS * _STEM)) - 1)
    full = np.uint64(1 << (_BITS * (_STEM - 1)))
    parts = [(packed >> np.uint64(_BITS * k)) & mask for k in range(WINDOW - _STEM + 1)]
    return np.concatenate([*(part[part >= full] for part in parts), packed[packed < full]])


def _support(in_toxic: Counter, in_clean: Counter, n_toxic: int, n_clean: int) -> int:
    """The least number of toxic texts a telling sequence must be in: three, or up to five
    or one in a hundred texts while chance alone makes too many such sequences. How many
    it makes is seen from those that tell clean texts from toxic ones in the same way."""
    most = max(5, -(-n_toxic // 100))
    scale = max(1, n_clean) / max(1, n_toxic)
    for least in range(3, most):
        found = sum(n >= least and n * scale >= 10 * (in_clean[s] + 0.3 * scale) for s, n in in_toxic.items())
        chance = sum(n >= least * max(1.0, scale) and n >= 10 * (in_toxic[s] + 0.3) * scale for s, n in in_clean.items())
        if chance * 10 <= found:
            return least
    return most


def choose_landmarks(toxic: list[np.ndarray], clean: list[np.ndarray], most: int = LANDMARKS) -> list[int]:
    """Letter sequences that cover the toxic texts, the most telling first.

    A sequence must be in three toxic texts at least, or as many as chance asks for, and
    ten times as often in toxic texts as in clean ones. Each choice is the one that is in
    most toxic texts not yet covered four times, and after `most` choices in most texts
    not covered at all, until every text with such a sequence is covered.
    """
    def per_text(texts: list[np.ndarray]) -> list[np.ndarray]:
        return [distinct(_stems(t)) for t in texts]

    of_toxic, of_clean = per_text(toxic), per_text(clean)
    in_clean = Counter(np.concatenate([np.empty(0, np.uint64), *of_clean]).tolist())
    in_toxic = Counter(np.concatenate([np.empty(0, np.uint64), *of_toxic]).tolist())
    scale = max(1, len(clean)) / max(1, len(toxic))
    least = _support(in_toxic, in_clean, len(toxic), len(clean))
    good = {s for s, n in in_toxic.items() if n >= least and n * scale >= 10 * (in_clean[s] + 0.3 * scale)}
    where: dict[int, list[int]] = {}
    for at, stems in enumerate(of_toxic):
        for stem in stems.tolist():
            if stem in good:
                where.setdefault(stem, []).append(at)
    covered = np.zeros(len(toxic), dtype=np.int64)
    chosen: list[int] = []
    # Gains only shrink, so the first whose gain is still what it was is the best.
    heap = [(-len(at), -len(at), -stem) for stem, at in where.items()]
    heapify(heap)
    while heap:
        before, n, stem = heappop(heap)
        at = where[-stem]
        gain = int((covered[at] < (4 if len(chosen) < most else 1)).sum())
        if gain == -before:
            chosen.append(-stem)
            covered[at] += 1
        elif gain:
            heappush(heap, (-gain, n, stem))
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss, by accelerated gradient descent."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    keep = np.append(np.full(x.shape[1], 1e-4), 0.0)
    step = 1.0 / (2 * np.linalg.norm(x1 * np.sqrt(cost)[:, None], 2) ** 2 + 2e-4)
    w = ahead = np.zeros(x1.shape[1])
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead))
        new = ahead - step * (2 * keep * ahead - 2 * x1.T @ (cost * y * slack))
        w, ahead = new, new + k / (k + 3) * (new - w)
    return w[:-1], float(w[-1])


def _logistic(scores: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by Newton's method with a small prior."""
    x = np.stack((scores, np.ones(len(scores))), axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - truth)) + 1e-2 * (w - [1.0, 0.0])
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w = w - np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(max(w[0], 1e-3)), float(w[1])


def _landmark_profiles(landmarks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes that landmarks have, 0 first, and landmark x such code."""
    codes = distinct(np.append(_codes(landmarks).ravel(), 0))
    parts = [_profiles(landmarks[at : at + 32])[:, codes] for at in range(0, len(landmarks), 32)]
    return codes, np.concatenate(parts)


def train(
    rows: list[tuple[str, int]], share: float | None = None, rounds: int = 3
) -> ToxicityModel:
    """Fit a model on (text, 0 or 1) pairs; `share` is that of toxic texts where they come
    from, if not that of the pairs. Without toxic or clean texts, or without a
    sequence that tells them apart, every text gets the share of toxic ones."""
    toxic = [distinct(windows_of([text])[0]) for text, label in rows if label]
    clean = [distinct(windows_of([text])[0]) for text, label in rows if not label]
    landmarks = choose_landmarks(toxic, clean)
    share = len(toxic) / max(1, len(rows)) if share is None else share
    odds = float(np.log((len(toxic) + 0.5) / (len(rows) - len(toxic) + 0.5)))
    harmless = ToxicityModel(np.zeros(_CODES), 0.0, 1.0, odds, ())
    if toxic and clean and not landmarks:
        warnings.warn(f"nothing tells {len(toxic)} toxic texts from {len(clean)} clean ones", stacklevel=2)
    if not landmarks or not clean:
        return harmless
    used, profiles = _landmark_profiles(np.array(landmarks, dtype=np.uint64))
    slots = np.zeros(_CODES, dtype=np.int64)
    slots[used] = np.arange(len(used))
    values, vectors = np.linalg.eigh(profiles @ profiles.T)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) @ vectors.T
    mapped = (root @ profiles).T  # used code x feature: the Nystroem map of a triple

    def features(packed: np.ndarray) -> np.ndarray:
        codes = _codes(packed)
        at = slots[codes] + np.arange(len(packed))[:, None] * len(used)
        weights = np.bincount(at.ravel(), np.tile(_WEIGHTS, len(packed)), len(packed) * len(used))
        return weights.reshape(len(packed), len(used)) @ mapped / _norms(codes)[:, None]

    def whole(of_used: np.ndarray) -> np.ndarray:
        table = np.zeros(_CODES)
        table[used] = of_used
        return table

    every_clean, of_clean = np.unique(np.concatenate(clean), return_counts=True)
    near = (whole(profiles.max(axis=0)), 0.0)  # bounds the kernel with every landmark
    every_toxic, of_toxic = np.unique(np.concatenate(toxic), return_counts=True)
    place = np.minimum(np.searchsorted(every_clean, every_toxic), len(every_clean) - 1)
    in_clean = np.where(every_clean[place] == every_toxic, of_clean[place], 0)
    telling = of_toxic * len(clean) >= 10 * in_clean * len(toxic)
    # What clean texts have as well is no one's fault, and a toxic text without any
    # window like a landmark has nothing to teach.
    suspect = []
    for text in toxic:
        own = text[telling[np.searchsorted(every_toxic, text)]]
        own = own[np.argsort(-margins(*near, own), kind="stable")[:8]]
        own = own[(features(own) @ np.linalg.inv(root)).max(axis=1, initial=0) >= NEAR]
        if len(own):
            suspect.append(own)
    if not suspect:
        return harmless
    # Windows of several toxic texts are learned along with the worst one of each.
    shared, texts_with = np.unique(np.concatenate(suspect), return_counts=True)
    shared = np.repeat(shared, np.where(texts_with >= max(3, len(toxic) / 200), texts_with, 0))
    hard = np.argsort(-margins(*near, every_clean), kind="stable")[:6000]
    calm = np.argsort(-of_clean, kind="stable")[:6000]
    table, bias = near
    for _ in range(rounds):
        worst = np.array([t[margins(table, bias, t).argmax()] for t in suspect])
        positive, in_texts = np.unique(np.append(worst, shared), return_counts=True)
        negative = distinct(np.concatenate((hard, calm)))
        packed = np.concatenate((positive, every_clean[negative]))
        y = np.concatenate((np.ones(len(positive)), -np.ones(len(negative))))
        # In units of texts: a window counts in every text that has it.
        cost = np.concatenate((in_texts / len(worst), of_clean[negative] / len(clean)))
        x = np.concatenate([features(packed[k : k + 2000]) for k in range(0, len(packed), 2000)])
        weights, bias = _svm(x, y, cost)
        table = whole(mapped @ weights)
        hard = np.argsort(-margins(table, bias, every_clean), kind="stable")[:6000]
    scores = np.array([margins(table, bias, t).max() if len(t) else -1.0 for t in (*toxic, *clean)])
    truth = np.append(np.ones(len(toxic)), np.zeros(len(clean)))
    weight = np.append(np.full(len(toxic), share * len(rows) / len(toxic)),
                       np.full(len(clean), (1 - share) * len(rows) / len(clean)))
    slope, offset = _logistic(scores, truth, weight)
    calm_texts = [text for text, label in rows if not label]
    extra = _excused(table, bias, -offset / slope, tuple(landmarks), calm_texts)
    return ToxicityModel(table, bias, slope, offset, tuple(landmarks), *extra)


def score(model: ToxicityModel, texts: list[str | None], seen: Seen | None = None) -> list[float]:
    """Score from 0 to 1 per text; a text without windows has margin -1. `seen` may go from
    call to call with the same model."""
    seen = seen or Seen()
    out: list[float] = []
    block: list[str] = []
    size = 0
    for text in [*texts, None]:
        last = len(out) + len(block) == len(texts)
        if block and (size >= _BLOCK or last):
            out += _score_block(model, block, seen)
            block, size = [], 0
        if not last:
            block.append(text or "")
            size += len(block[-1])
    return out


def _score_block(model: ToxicityModel, texts: list[str], seen: Seen) -> list[float]:
    (packed, owner), (extra, owner_of_extra) = _both(texts, bool(model.landmarks))
    worst = np.full(len(texts), -1.0 if model.landmarks else 0.0)
    if len(packed) and model.landmarks:
        different, place = np.unique(packed, return_inverse=True)
        found = seen.margin.of(different, lambda new: margins(model.table, model.bias, new))[place]
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        worst[owner[starts]] = np.maximum.reduceat(found, starts)
    if len(extra):
        extra, owner_of_extra = _read(extra, owner_of_extra, model.landmarks)
        different = distinct(extra)
        values = seen.high.of(different, lambda new: _counted(model, new))
        high, values = different[values > -np.inf], values[values > -np.inf]
        hit = np.flatnonzero(~_without(extra, high)) if len(high) else np.empty(0, np.int64)
        if len(hit):
            np.maximum.at(worst, owner_of_extra[hit], values[np.searchsorted(high, extra[hit])])
    return (1 / (1 + np.exp(-np.clip(model.slope * worst + model.offset, -30, 30)))).tolist()


def training_rows(
    docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str, text: str, toxic: str,
    per_class: int = 2000, longest: int = 100_000,
) -> tuple[list[tuple[str, int]], float]:
    """A sample of at most about `per_class` labelled rows of each class, chosen by a
    hash of the id, of texts of at most `longest` bytes; and the share of toxic rows
    among all labelled ones."""
    marked = (
        labels.where(usable & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_labelled"))
        .agg(F.max(toxic).alias("_toxic"))
    )
    counts = {row[0]: row[1] for row in marked.groupBy("_toxic").count().collect()}
    place = crc_of_id(F.concat(F.lit("toxicity "), F.col("_labelled").cast("string"))) / float(1 << 32)
    share = F.when(F.col("_toxic") == 1, min(1.0, per_class / max(1, counts.get(1, 0)))).otherwise(
        min(1.0, per_class / max(1, counts.get(0, 0)))
    )
    chosen = marked.where(place < share).limit(4 * per_class)  # its bound lets it be broadcast
    rows = (
        docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
        .where(F.col("_text").isNotNull() & (F.octet_length("_text") <= longest))
        .join(F.broadcast(chosen), F.col("_id") == F.col("_labelled"))
        .select("_text", "_toxic")
        .limit(8 * per_class)
        .collect()
    )
    pairs = sorted((row[0], int(row[1] == 1)) for row in rows)
    return pairs, counts.get(1, 0) / max(1, sum(counts.values()))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Add `toxicity`, a score from 0 to 1, to every row.

    Null and empty texts, and texts without letters, get the score of a harmless text.
    Repeated rows get equal scores; a column called toxicity is replaced.
    """
    small_batches(docs.sparkSession)
    fitted = shared_object(docs.sparkSession, model)

    @F.pandas_udf("double")
    @given_back
    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        seen = Seen()
        for batch in batches:
            yield pd.Series(score(fitted(), batch.tolist(), seen), dtype="float64")

    return docs.withColumn("toxicity", rate(F.col(text)))
