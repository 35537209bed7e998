"""Order-preserving packing of documents into sequences of a fixed length.

The tokens of the documents follow each other in the order of the rows. Dynamic
programming chooses the cuts: the cost of a sequence is its padding, and a cut costs
nothing at the end of a document, little at the end of a sentence, more at the end of
a clause and most elsewhere. The
cheapest way to reach a place comes from the places at most one sequence back. Those are
the last places of one stretch of a sequence's length and the first of the next, so that
running minima over both ends give the best of them for a whole stretch at once.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelink.llm.shared import given_back, shared_object, small_batches

# Cost of a cut, in tokens of padding.
SENTENCE_COST = 2
CLAUSE_COST = 6
PLAIN_COST = 16
# Tokens between cuts where no sentence or clause ends for twice as long.
PLAIN_STEP = 24
# Tokens after which cuts are fixed as far as they are certain, and tokens held at most.
HELD_TOKENS = 1 << 18
MOST_HELD_TOKENS = 1 << 22
# Bytes of text whose different words are looked at together.
GROUP_BYTES = 1 << 20
# Pieces that go out together.
PIECES = 500

_PIECE = (
    "doc_id string, start long, length long, ids binary, doc_tokens long, "
    "sequence_id long, offset long"
)
_PIECE_ARROW = pa.schema(
    [
        ("doc_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ]
)

# What a cut after a byte costs, and which bytes at the end of a word are looked past.
_COSTS = np.full(256, PLAIN_COST)
_COSTS[list(b".!?")] = SENTENCE_COST
_COSTS[list(b",;:|")] = CLAUSE_COST
_CLOSING = b"\"')]}*_"
_IS_CLOSING = np.isin(np.arange(256), list(_CLOSING))

# Words of these characters are put into lower case and split by _PARTS. Others go to
# the tokenizer itself: words with an apostrophe (contractions), with <, from which
# special tokens are made, and with characters beyond Latin-1.
_PLAIN = re.compile(r"[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_LETTERS = r"a-z\u00df-\u00f6\u00f8-\u00ff"
_PARTS = re.compile(rf"[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\x01]+")
# The same for words of ASCII, by byte.
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_LETTER, _DIGIT, _SIGN, _OTHER = range(4)
_KIND = np.array(
    [
        _OTHER if b > 0x7E or not _PLAIN.fullmatch(chr(b))
        else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
        for b in range(256)
    ],
    np.uint8,
)


def _byte_ranks(tokenizer_json: str) -> dict[bytes, int]:
    """The vocabulary by bytes; the end of a word is the byte 0."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    ranks = {}
    for token, number in json.loads(tokenizer_json)["model"]["vocab"].items():
        word = token.removesuffix("</w>")
        end = b"\0" if word != token else b""
        ranks[bytes(map(byte_of.__getitem__, word)) + end] = number
    return ranks


class WordTokens:
    """Tokens of texts, word by word. The tokenizer splits at white space first, so the
    tokens of a text are those of its words one after the other.

    The different words of about a megabyte of texts are tokenized together; none are
    remembered after that.
    """

    def __init__(self, tokenizer_json: str):
        self.tokenizer_json = tokenizer_json
        self.tokenizer = None

    def _open(self) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(self.tokenizer_json)
        ranks = _byte_ranks(self.tokenizer_json)
        self.pairs = tiktoken.Encoding(
            "words", pat_str=r"[^\x00\x01]+\x00|\x01", mergeable_ranks=ranks, special_tokens={}
        )
        self.mark = ranks[b"\x01"]
        self.is_end = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.is_end[[number for token, number in ranks.items() if token.endswith(b"\0")]] = True

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, one after the other, and how many each word has."""
        text = _PARTS.sub("\\g<0>\0", "".join(f"{w}\1" for w in words).lower())
        ids = np.array(self.pairs.encode_ordinary(text), dtype=np.uint32)
        marks = np.flatnonzero(ids == self.mark)
        return np.delete(ids, marks), np.diff(marks, prepend=-1) - 1

    def _encoded_ascii(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for words, none empty, of ASCII without apostrophe and <: their bytes
        one after the other, and how many each word has."""
        kind, last = _KIND[data], np.cumsum(sizes) - 1
        ends = kind == _DIGIT
        ends[:-1] |= kind[1:] != kind[:-1]
        ends[last] = True
        parts = np.cumsum(ends)
        text = np.zeros(len(data) + int(parts[-1]), np.uint8)
        text[np.arange(len(data)) + parts - ends] = _LOWER[data]
        ids = np.array(self.pairs.encode_ordinary(text.tobytes().decode()), dtype=np.uint32)
        upto = np.flatnonzero(self.is_end[ids])[parts[last] - 1] + 1
        return ids, np.diff(upto, prepend=0)

    def _learn(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of different words in some order, and by word: where its ids begin, how many
        they are, and what a cut after the word costs."""
        n = len(words)
        at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
        at = at.astype(np.int64) - at[0]
        length = np.diff(at)
        filled = np.flatnonzero(length)
        costs = np.full(n, PLAIN_COST)
        final = data[at[filled + 1] - 1]
        costs[filled] = _COSTS[final]
        for k in filled[_IS_CLOSING[final]].tolist():
            before = data[at[k] : at[k + 1]].tobytes().rstrip(_CLOSING)
            costs[k] = _COSTS[before[-1]] if before else PLAIN_COST
        odd = np.zeros(n, dtype=bool)
        odd[np.searchsorted(at, np.flatnonzero(_KIND[data] == _OTHER), "right") - 1] = True
        order, made, counts = [], [], []
        ascii_words = filled[~odd[filled]]
        if len(ascii_words):
            ids, sizes = self._encoded_ascii(data[np.repeat(~odd, length)], length[ascii_words])
            order, made, counts = [ascii_words], [ids], [sizes]
        plain, plain_text, other, other_text = [], [], [], []
        for k in np.flatnonzero(odd).tolist():
            text = data[at[k] : at[k + 1]].tobytes().decode()
            if _PLAIN.fullmatch(text):
                plain.append(k)
                plain_text.append(text)
            else:
                other.append(k)
                other_text.append(text)
        if plain:
            ids, sizes = self._encoded(plain_text)
            order, made, counts = [*order, plain], [*made, ids], [*counts, sizes]
        if other:
            lists = [e.ids for e in self.tokenizer.encode_batch(other_text, add_special_tokens=False)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.fromiter(chain.from_iterable(lists), np.uint32)
            order, made, counts = [*order, other], [*made, ids], [*counts, sizes]
        first, size = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        if order:
            number, sizes = np.concatenate(order), np.concatenate(counts)
            first[number], size[number] = np.cumsum(sizes) - sizes, sizes
        return np.concatenate([np.empty(0, np.uint32), *made]), first, size, costs

    def encode(
        self, texts: pa.Array | list[bytes | None]
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: its ids, the places after which a sentence or clause ends, and what
        cuts there cost."""
        if self.tokenizer is None:
            self._open()
        if isinstance(texts, list):
            texts = pa.array(texts, pa.binary())
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = upto[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(upto, before + GROUP_BYTES, "right")))
            yield from self._encode_group(texts[at:end])
            at = end

    def _encode_group(self, texts: pa.Array) -> Iterator[tuple]:
        texts = pc.fill_null(texts.cast(pa.binary()), b"").view(pa.string())
        split = pc.ascii_split_whitespace(texts)  # with an empty word at an end of white space
        upto = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        words = split.flatten().dictionary_encode()
        number = words.indices.to_numpy()
        learned = self._learn(words.dictionary)
        del split, words
        for at in range(0, len(texts), 128):
            bounds = upto[at : at + 129]
            yield from self._encode_some(number[bounds[0] : bounds[-1]], bounds - bounds[0], *learned)

    def _encode_some(
        self, number: np.ndarray, bounds: np.ndarray,
        known: np.ndarray, first: np.ndarray, size: np.ndarray, cost: np.ndarray,
    ) -> Iterator[tuple]:
        sizes = size[number]
        after = np.cumsum(sizes)
        ids = known[np.arange(after[-1] if len(number) else 0) + np.repeat(first[number] - after + sizes, sizes)]
        costs = cost[number]
        cuts = np.flatnonzero(costs < PLAIN_COST)
        places, costs = after[cuts], costs[cuts]
        begins = np.append(0, after)[bounds].tolist()
        marks = np.searchsorted(cuts, bounds).tolist()
        for k in range(len(bounds) - 1):
            begin, here = begins[k], slice(marks[k], marks[k + 1])
            yield ids[begin : begins[k + 1]], places[here] - begin, costs[here]


WHOLE, CERTAIN, BEST = "whole", "certain", "best"
# The bits of a number in a key.
_NUMBER = (1 << 32) - 1


def choose_cuts(places: np.ndarray, costs: np.ndarray, length: int, upto: str) -> list[int]:
    """Cuts, in order, of a stream that begins at 0.

    places  where a cut may be, ascending, at most `length` apart
    costs   what a cut there costs
    upto    WHOLE: the stream ends at the last place, and so do the cuts; CERTAIN: the
            cuts that stay the cheapest ones however the stream goes on, maybe none;
            BEST: up to the cheapest place within a sequence of the last one
    """
    n = len(places)
    position = np.append(0, places).astype(np.int64)
    step = np.append(0, costs).astype(np.int64) + length
    number = np.arange(n + 1)
    # Of the cheapest way to each place: its cost and the place, and where it comes from.
    value, back = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64)
    last = 0
    while last < n:
        # The places up to a sequence after the last one. The best place before each of them
        # is one up to the last one, or one after it that is itself best reached from there:
        # where two of these places follow each other on a way, leaving out the second is
        # cheaper. Of equal ones the latter is best, so a key is a value less a number.
        begin, end = np.searchsorted(position, (position[last] - length, position[last] + length), "right")
        if end == last + 1:
            raise ValueError("places are further apart than a sequence is long")
        stretch, before, base = slice(last + 1, end), slice(begin, last + 1), value[last]
        keys = ((value[before] - base) << 32) - number[before]
        keys = np.minimum.accumulate(keys[::-1])[::-1]
        best = keys[np.searchsorted(position[before], position[stretch] - length)]
        here = number[stretch]
        keys = ((value[-best & _NUMBER] - base + step[stretch]) << 32) - here
        best[1:] = np.minimum(best[1:], np.minimum.accumulate(keys)[:-1])
        back[stretch] = -best & _NUMBER
        value[stretch] = ((best + back[stretch]) >> 32) + base + step[stretch]
        last = int(end) - 1
    way = back.tolist()
    j = n
    if upto != WHOLE:
        near = int(np.searchsorted(position, position[n] - length))
        if upto == BEST:
            j = n - int(np.argmin((value - position)[max(near, 1) :][::-1]))
        ways = set(range(near, n + 1))
        while upto == CERTAIN and len(ways) > 1:
            # The last place that is not on all ways gives way to the one before it.
            if j in ways:
                ways.remove(j)
                ways.add(way[j])
            j -= 1
        if upto == CERTAIN:
            j = ways.pop()
    cuts = []
    while j:
        cuts.append(int(position[j]))
        j = way[j]
    return cuts[::-1]


class Packer:
    """Packs a stream of documents; gives pieces as soon as their cuts are fixed."""

    def __init__(self, length: int, first_sequence: int):
        self.length = length
        self.sequence = first_sequence
        self.docs: list[tuple[object, np.ndarray, int]] = []  # id, its tokens, those gone
        self.places: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.held = 0
        self.cut_at = HELD_TOKENS

    def add(
        self, doc_id, ids: np.ndarray, places: np.ndarray, costs: np.ndarray
    ) -> Iterator[tuple]:
        n = len(ids)
        inner = (places > 0) & (places < n)
        places, costs = np.append(places[inner], n), np.append(costs[inner], 0)
        gaps = np.diff(places, prepend=0)
        if gaps.max() > 2 * PLAIN_STEP:
            far = np.flatnonzero(gaps > 2 * PLAIN_STEP)
            extra = np.concatenate(
                [np.arange(places[k] - gaps[k] + PLAIN_STEP, places[k], PLAIN_STEP) for k in far]
            )
            order = np.argsort(np.concatenate((places, extra)), kind="stable")
            costs = np.concatenate((costs, np.full(len(extra), PLAIN_COST)))[order]
            places = np.concatenate((places, extra))[order]
        self.docs.append((doc_id, ids, 0))
        self.places.append(places + self.held)
        self.costs.append(costs)
        self.held += n
        if self.held >= self.cut_at:
            yield from self.cut(CERTAIN if self.held < MOST_HELD_TOKENS else BEST)
            # What was not certain is looked at again; twice as much, so that this stays cheap.
            self.cut_at = self.held + max(self.held, HELD_TOKENS)

    def cut(self, upto: str) -> Iterator[tuple]:
        if not self.held:
            return
        places, costs = np.concatenate(self.places), np.concatenate(self.costs)
        cuts = choose_cuts(places, costs, self.length, upto)
        docs = deque(self.docs)
        before = 0
        for cut in cuts:
            offset = 0
            while before + offset < cut:
                doc_id, ids, gone = docs[0]
                take = min(len(ids) - gone, cut - before - offset)
                piece = ids[gone : gone + take]
                yield doc_id, gone, take, piece.astype("<u4").tobytes(), len(ids), self.sequence, offset
                offset += take
                docs.popleft()
                if gone + take < len(ids):
                    docs.appendleft((doc_id, ids, gone + take))
            before = cut
            self.sequence += 1
        rest = places > before
        self.docs, self.held = list(docs), self.held - before
        self.places, self.costs = [places[rest] - before], [costs[rest]]


def pack_documents(
    docs: DataFrame,
    tokenizer_json: str,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """Pieces of documents in sequences of at most `length` tokens.

    tokenizer_json  content of a tokenizer file whose splitter drops white space
    end_id          id that ends every document

    Every task packs its rows in their order, so nothing is shuffled; only its last
    sequence may need much padding. A task's cuts are the cheapest ones for all its rows:
    they are fixed as the rows come in, up to where every way on agrees. Only if none is
    certain in `MOST_HELD_TOKENS` tokens does the cheapest one there decide. Gives doc_id, start (the document's ids before the
    piece), length, ids (little-endian 32-bit), doc_tokens (with `end_id`), sequence_id
    (task number times 2^32 and up), offset in the sequence. A null or empty text is
    just `end_id`; repeated rows are documents of their own; null ids stay null; an
    empty table gives no pieces. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    words = shared_object(docs.sparkSession, WordTokens(tokenizer_json))

    def made(pieces: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*pieces), _PIECE_ARROW.types)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], schema=_PIECE_ARROW)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        tokens = words()
        packer = Packer(length, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype=np.uint32)
        pieces: list[tuple] = []
        for batch in batches:
            encoded = tokens.encode(batch.column("text"))
            for number, (ids, places, costs) in zip(batch.column("doc_id").to_pylist(), encoded):
                pieces += packer.add(number, np.concatenate((ids, end)), places, costs)
                if len(pieces) >= PIECES:
                    yield made(pieces)
                    pieces = []
        pieces += packer.cut(WHOLE)
        if pieces:
            yield made(pieces)

    # Ids of any type go along as text.
    rows = docs.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("binary").alias("text")
    )
    kind = docs.select(doc_id).dtypes[0][1]
    return rows.mapInArrow(given_back(pack), _PIECE).withColumn("doc_id", F.col("doc_id").cast(kind))
