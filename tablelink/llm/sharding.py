"""Histogram sort: rows to shards of near equal bytes, in key order.

Exact bytes are counted below candidate key boundaries; only the cells in which a
splitter still lies are probed again with finer boundaries, until every splitter
meets the tolerance. Then the rows are exchanged once. What the driver sees is the
histogram of the probed cells, whose size depends on the number of shards alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablelink.llm.shared import crc_of_id, stored

# Key bits that the first round and each further round tell apart.
_FIRST_BITS = 12
_NEXT_BITS = 8
_KEY_BITS = 64


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def text_key(text: Column, doc_id: Column) -> Column:
    """A 64-bit sort key: equal texts are neighbours, and the rows of one text are
    told apart by their ids, so that a text that many rows share can be cut."""
    of_text = F.coalesce(F.crc32(text.cast("binary")), F.lit(0)) - F.lit(1 << 31)
    return F.shiftleft(of_text, 32) + crc_of_id(doc_id)


def find_splitters(
    rows: DataFrame, key: str, size: str, shards: int, tolerance: float = 0.001
) -> list[int]:
    """The keys at which shards 1, 2, ... begin, in order; `shards - 1` of them.

    A splitter is done when the bytes between the two probes around its ideal place
    are at most `tolerance` of a shard, or no key lies between them. Rows of one key
    are not cut. An empty table gives splitters that all rows are below.
    """
    cell = F.shiftright(key, _KEY_BITS - _FIRST_BITS)
    total, shift = 0, _KEY_BITS - _FIRST_BITS
    counted = _histogram(rows, cell, size)
    total = sum(counted.values())
    if not total:
        return [(1 << (_KEY_BITS - 1)) - 1] * (shards - 1)
    allowed = tolerance * total / shards
    # Splitter number -> its cell, the bytes before that cell, the bytes in it.
    open_cells = {}
    for number in range(1, shards):
        open_cells[number] = _cell_of(sorted(counted.items()), 0, total * number / shards)
    splitters: dict[int, int] = {}
    while open_cells:
        for number, (at, before, inside) in list(open_cells.items()):
            if inside <= allowed or shift == 0:
                ideal = total * number / shards
                up = ideal - before > before + inside - ideal
                splitters[number] = min((at + up) << shift, (1 << (_KEY_BITS - 1)) - 1)
                del open_cells[number]
        if not open_cells:
            break
        probed = sorted({at for at, _, _ in open_cells.values()})
        finer = max(0, shift - _NEXT_BITS)
        within = rows.where(F.shiftright(key, shift).isin(probed))
        counted = _histogram(within, F.shiftright(key, finer), size)
        by_cell: dict[int, list[tuple[int, int]]] = {}
        for at, n in sorted(counted.items()):
            by_cell.setdefault(at >> (shift - finer), []).append((at, n))
        for number, (at, before, _) in open_cells.items():
            open_cells[number] = _cell_of(by_cell[at], before, total * number / shards)
        shift = finer
    return [splitters[number] for number in range(1, shards)]


def _histogram(rows: DataFrame, cell: Column, size: str) -> dict[int, int]:
    counts = rows.groupBy(cell.alias("cell")).agg(F.sum(size).alias("n"))
    return {row["cell"]: row["n"] for row in counts.collect()}


def _cell_of(cells: list[tuple[int, int]], before: int, ideal: float) -> tuple[int, int, int]:
    """The cell in which the running sum, from `before` on, passes `ideal`."""
    for at, n in cells:
        if before + n >= ideal:
            return at, before, n
        before += n
    return cells[-1][0], before - cells[-1][1], cells[-1][1]


def histogram_sort(
    rows: DataFrame,
    key: str,
    size: str,
    shards: int = 40,
    tolerance: float = 0.001,
    slot_rows: int = 50_000,
) -> DataFrame:
    """Add `shard` and `slot` to every row.

    rows   any table with a 64-bit integer `key` and a `size` in bytes, neither null;
           give a stored table, as it is read once per round
    shard  by key: shard 0 has the smallest keys; shards differ by `tolerance` of the
           mean shard on either side, or by the rows of one key
    slot   a number in the shard, from 0 without gaps. A shard is numbered in pieces
           of about `slot_rows` rows, so no task ever holds a whole shard.
    Repeated rows get a slot each; an empty table stays empty. Columns called shard or
    slot are replaced, others pass through.
    """
    splitters = find_splitters(rows, key, size, shards, tolerance)
    shard = F.lit(0)
    for splitter in splitters:
        shard = shard + (F.col(key) >= F.lit(splitter)).cast("int")
    pieces = max(8, rows.count() // (shards * slot_rows) + 1)
    placed = rows.drop("shard", "slot").withColumns(
        {"shard": shard, "_piece": F.pmod(F.xxhash64(key), F.lit(pieces))}
    )
    counts = placed.groupBy("shard", "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "shard", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    numbered = placed.withColumn(
        "slot", F.row_number().over(Window.partitionBy("shard", "_piece").orderBy(key)) - 1
    )
    return (
        numbered.join(starts, ["shard", "_piece"])
        .withColumn("slot", (F.col("slot") + F.col("_start")).cast("long"))
        .drop("_piece", "_start")
    )


def shard_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 40
) -> DataFrame:
    """Shards of documents by bytes of text plus 16: doc_id, size, text_crc32, shard,
    slot.

    A null text has 0 bytes of text and a null crc; a null id is an id like others.
    Rows that repeat both id and text keep together and are counted each. Equal texts
    are neighbours: they fill one shard or run over into the next.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (text_bytes(F.col(text)) + 16).alias("size"),
        F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
        text_key(F.col(text), F.col(doc_id)).alias("key"),
    )
    return histogram_sort(stored(rows), "key", "size", shards).drop("key")
