"""Ordered work on groups of any size: running totals, positions, joined text.

A window over a whole group puts that group in one task. The functions here cut
each group into runs of neighbouring order values first, so that a group with a
large share of all rows is spread over many tasks and only one small row per
run meets the other runs of its group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tablelink.functions.text import joined_in_order

# Order values per run, as a power of two; no window holds more rows.
RUN_BITS = 16


def order_bits_of(df: DataFrame, order: str) -> int:
    """Bits that `running_total` needs for the order values there are, from one small
    aggregate over that column."""
    least, most = df.agg(F.min(order), F.max(order)).first()
    return max(int(most or 0), -1 - int(least or 0), 0).bit_length() + 1


def running_total(
    df: DataFrame,
    value: Column,
    *,
    keys: Sequence[str],
    order: str,
    out: str,
    run_bits: int = RUN_BITS,
    order_bits: int = 64,
) -> DataFrame:
    """Add `out`: the sum of `value` over the rows of the group up to this one.

    `order` is a whole number that is unique inside a group and, like `keys`,
    never null. It may be sparse: the totals of the runs are added up in the same
    way, as runs of runs, until what is left of the order has `run_bits` bits. So no
    window holds more than 2^run_bits rows, whatever the numbers are. Numbers known to
    be below 2^(order_bits - 1) need fewer levels.
    """
    numbered = df.withColumn("_at_0", F.col(order).cast("bigint"))
    return _level(numbered, value, keys, out, run_bits, order_bits, 0).drop("_at_0")


def _level(
    df: DataFrame, value: Column, keys: Sequence[str], out: str, run_bits: int, bits: int, level: int
) -> DataFrame:
    at, run, start = f"_at_{level}", f"_at_{level + 1}", f"_start_{level}"
    parts = [*keys, run] if bits > run_bits else list(keys)
    inside = (
        Window.partitionBy(*parts)
        .orderBy(at)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    if bits <= run_bits:
        return df.withColumn(out, F.sum(value).over(inside))
    tagged = df.withColumn(run, F.shiftright(at, run_bits))
    totals = tagged.groupBy(*keys, run).agg(F.sum(value).alias("_total"))
    upto = _level(totals, F.col("_total"), keys, "_upto", run_bits, bits - run_bits, level + 1)
    starts = upto.select(*keys, run, (F.col("_upto") - F.col("_total")).alias(start))
    return (
        tagged.withColumn("_inside", F.sum(value).over(inside))
        .join(starts, parts)
        .withColumn(out, F.col(start) + F.col("_inside"))
        .drop(run, "_inside", start)
    )


def position(
    df: DataFrame,
    *,
    keys: Sequence[str],
    order: str,
    out: str,
    run_bits: int = RUN_BITS,
    order_bits: int = 64,
) -> DataFrame:
    """Add `out`: the 1-based position of the row inside its group."""
    one = F.lit(1).cast("bigint")
    return running_total(
        df, one, keys=keys, order=order, out=out, run_bits=run_bits, order_bits=order_bits
    )


def first_k(
    df: DataFrame, k: int, *, keys: Sequence[str], order: Sequence[str | Column], out: str
) -> DataFrame:
    """Keep the first `k` rows of each group and number them in `out`.

    Written as a row_number filter, which Spark applies to every input split
    before the shuffle, so a group sends at most `k` rows per split.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def joined_text(
    df: DataFrame,
    text: Column,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    out: str,
    head: str = "",
    carried: Sequence[str] = (),
    needed: str | None = None,
) -> DataFrame:
    """One row per group: `head` and `text` of its rows, concatenated in `order`, and the
    columns `carried` of its first row. With `needed`, one of these, there is none for a group
    whose first row has no value in it, and that column is left out: a filter or a choice of
    columns that comes later would copy a long text.

    The result is one value, so its rows meet in one task in any case; they are shuffled
    once at most and sorted, and no list of them is made. Equal places are ordered by text.
    """
    rows = rows_in_order(df, text, keys=keys, order=order, out=out, carried=carried)
    names = [name for name in rows.columns[:-1] if name != needed]
    schema = StructType([*(rows.schema[name] for name in names[:-1]), StructField(out, StringType(), False)])
    start = head.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_joined(batches, start, needed):
            if needed is not None and batch.column(needed).null_count:
                batch = batch.filter(batch.column(needed).is_valid())
            yield batch.select(names)
            # What was yielded is not kept while the next is made.
            del batch

    return rows.mapInArrow(run, schema)


def rows_in_order(
    df: DataFrame, text: Column, *, keys: Sequence[str], order: str | Sequence[str], out: str, carried: Sequence[str] = ()
) -> DataFrame:
    """The rows of each group one after another in `order`, numbered from 1 in `_number`, with
    `text` as `out`: what `texts_joined` puts together in a task."""
    keys, places = list(keys), [order] if isinstance(order, str) else list(order)
    ats = [f"_at_{k}" for k in range(len(places))]
    placed = df.select(
        *keys, *carried, *(F.col(place).alias(at) for place, at in zip(places, ats)), text.alias(out)
    )
    # Groups come in no order of their keys, so that a long one seldom begins a file.
    inside = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*ats, out)
    return placed.withColumn("_number", F.row_number().over(inside)).select(*keys, *carried, out, "_number")


def text_parts(
    df: DataFrame,
    text: Column,
    *,
    keys: Sequence[str],
    order: str | Sequence[str],
    out: str,
    rows: int,
    carried: Sequence[str] = (),
    needed: str,
) -> DataFrame:
    """The texts of `joined_text` in parts of `rows` rows each, `piece` numbers them from 1:
    keys, `carried` (null but in the first part), piece, `out`. Parts are joined as they pass
    by, so that no text is whole anywhere."""
    ordered = rows_in_order(df, text, keys=keys, order=order, out=out, carried=carried)
    at = F.col("_number") - 1
    placed = ordered.select(
        *keys, *carried, (F.floor(at / rows) + 1).cast("int").alias("piece"), out, (at % rows + 1).alias("_number")
    )
    names = [name for name in placed.columns[:-1] if name != needed]
    schema = StructType([*(placed.schema[name] for name in names[:-1]), StructField(out, StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_joined(_of_needed(batches, needed)):
            yield batch.select(names)
            del batch

    return placed.mapInArrow(run, schema)


def _of_needed(batches: Iterator[pa.RecordBatch], needed: str) -> Iterator[pa.RecordBatch]:
    """The rows of groups whose first row has a value in a column."""
    wanted = False
    for batch in batches:
        first = (batch.column("piece").to_numpy() == 1) & (batch.column("_number").to_numpy() == 1)
        known = batch.column(needed).is_valid().to_numpy(zero_copy_only=False)
        # The place of the last first row up to each row; before it, the group of the last batch goes on.
        begin = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        kept = np.where(begin < 0, wanted, known[begin])
        if len(kept):
            wanted = bool(kept[-1])
        yield batch if kept.all() else batch.filter(pa.array(kept))


# Texts from this size on wait for the end of the task, where its sort has let go of its rows.
_LONG = 1 << 24


def texts_joined(
    batches: Iterator[pa.RecordBatch], head: bytes = b"", needed: str | None = None
) -> Iterator[pa.RecordBatch]:
    """Joined texts, the last column but one, of rows from one numbered 1 to the next; other
    columns are those of the first row. Inside a batch the texts of a group already stand in
    one piece of its buffer. What was yielded is not kept, and a long text is a batch of its own.
    Where the first row has no value in the column `needed`, no text over several batches is made."""
    first = text = held = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        *_, texts, numbers = batch.columns
        _, offsets, data = texts.buffers()
        ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + n + 1]
        data = data or pa.py_buffer(b"")
        starts = np.flatnonzero(numbers.to_numpy() == 1)
        batch = batch.select(range(batch.num_columns - 1))
        if first is not None:
            text += memoryview(data)[ends[0] : ends[starts[0] if len(starts) else n]]
        if not len(starts):
            continue
        if first is not None:
            made, text = _row(first, text), None
            if made.nbytes >= _LONG:
                made, held = held, made
            if made is not None:
                yield made
            del made
        if len(starts) > 1:
            whole = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(ends[starts].copy()), data)
            if head:
                whole = pc.binary_join_element_wise(head.decode(), whole, "")
            others = batch.take(pa.array(starts[:-1])).columns[:-1]
            yield pa.RecordBatch.from_arrays([*others, whole], schema=batch.schema)
        last = int(starts[-1])
        # A copy, so that the batch is not kept.
        first = batch.take(pa.array([last]))
        if needed is not None and first.column(needed).null_count:
            first = None
            continue
        text = bytearray(head) + memoryview(data)[ends[last] : ends[n]]
    last_ones = [] if first is None else [_row(first, text)]
    if held is not None:
        last_ones.append(held)
    batch = texts = data = text = held = None
    while last_ones:
        yield last_ones.pop()


def text_views(texts: pa.StringArray) -> Iterator[memoryview]:
    """The bytes of texts, none of them missing, without a copy."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].tolist()
    whole = memoryview(data or b"")
    return (whole[begin:end] for begin, end in zip(ends, ends[1:]))


def _row(first: pa.RecordBatch, text: bytearray) -> pa.RecordBatch:
    """The row with another text."""
    if len(text) >= 1 << 31:
        raise ValueError(f"a text of {len(text)} bytes is longer than one value can be; see joined_pieces")
    value = pa.StringArray.from_buffers(
        1, pa.py_buffer(np.array([0, len(text)], np.int32)), pa.py_buffer(text)
    )
    return pa.RecordBatch.from_arrays([*first.columns[:-1], value], schema=first.schema)


def joined_pieces(
    df: DataFrame,
    text: Column,
    *,
    keys: Sequence[str],
    order: str,
    out: str,
    piece_chars: int,
    run_bits: int = RUN_BITS,
    order_bits: int = 64,
) -> DataFrame:
    """The text that `joined_text` gives, of any length: one row per group and piece
    (keys, piece from 0, start in characters, `out`).

    Running lengths say where each row's text begins; rows that begin in the same
    `piece_chars` characters make a piece, so it is longer than that by one row's text at
    most, and the pieces of a group are put together by many tasks. A piece in which no
    text begins is missing. Rows of equal place are one text. `run_bits` and `order_bits`
    are as in `running_total`.
    """
    parts, bits = list(keys), order_bits
    placed = df.select(*keys, F.col(order).cast("bigint").alias("_at"), text.alias("_text")).withColumn(
        "_length", F.coalesce(F.char_length("_text"), F.lit(0)).cast("bigint")
    )
    if bits > run_bits:
        parts = [*keys, "_run"]
        placed = placed.withColumn("_run", F.shiftright("_at", run_bits))
    # Rows of one place are peers of the first window and all there are of the second.
    upto = F.sum("_length").over(Window.partitionBy(*parts).orderBy("_at"))
    own = F.sum("_length").over(Window.partitionBy(*parts, "_at"))
    begins = upto - own
    if bits > run_bits:
        totals = placed.groupBy(*parts).agg(F.sum("_length").alias("_total"))
        ends = running_total(
            totals, F.col("_total"), keys=keys, order="_run", out="_end", run_bits=run_bits, order_bits=bits - run_bits
        )
        runs = ends.select(*parts, (F.col("_end") - F.col("_total")).alias("_begin"))
        placed = placed.withColumn("_start", begins).join(runs, parts)
        placed = placed.withColumn("_start", F.col("_begin") + F.col("_start"))
    else:
        placed = placed.withColumn("_start", begins)
    piece = F.floor(F.col("_start") / piece_chars).alias("piece")
    rows = F.collect_list(F.struct(F.col("_at").alias("at"), F.col("_text").alias("text")))
    return placed.groupBy(*keys, piece).agg(F.min("_start").alias("start"), joined_in_order(rows).alias(out))
