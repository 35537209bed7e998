"""What the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce, wraps
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a
# space; bytes of other characters stay.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower()
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lowered(text: Column) -> Column:
    """A-Z as a-z, every other character as it is."""
    return F.translate(text, _UPPER, _LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what
    setCheckpointDir was given. Where neither is set, a temporary one on a single
    machine; a cluster has to name one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tablelink-"))
        folder = context.getCheckpointDir()
    return folder


def stored(df: DataFrame) -> DataFrame:
    """Write a table below the shared folder and read it again: cuts the lineage,
    and lost executors cost no more than the tasks they ran."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


T = TypeVar("T")


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that go to Python by four megabytes instead of Spark's default,
    which with the copies that numpy makes fills a small executor. A bound that the
    session sets itself stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, "4m")


class Shared:
    """An object that was broadcast. Calling it in a task gives the object, which a Python
    worker opens once and keeps until `given_back` lets go of it."""

    def __init__(self, held: Broadcast):
        self.held = held

    def __call__(self):
        value = self.held.value
        if "made" not in value:
            value["made"] = cloudpickle.loads(value["pickled"])
            _OPENED.append(value)
        return value["made"]


_OPENED: list[dict] = []


def shared_object(spark: SparkSession, made: T) -> Callable[[], T]:
    """Broadcast an object of bounded size; the function returned gives it inside of
    tasks."""
    return Shared(spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(made)}))


def _trim() -> None:
    """Hand free memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def give_back() -> None:
    """Drop what this Python worker has opened, and hand free memory to the system."""
    while _OPENED:
        _OPENED.pop().pop("made", None)
    gc.collect()
    _trim()


def given_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over the batches of a task that gives free memory back after each, and
    all of its memory after the last one.

    Spark deals tasks to its idle Python workers in turn, of which it keeps several per
    core; models and caches that outlive their task would be held once in each.
    """

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        try:
            for made in function(batches):
                yield made
                del made
                _trim()
        finally:
            give_back()

    return run


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of the id as text; 0 for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0))


def held_out(doc_id: Column) -> Column:
    """The fifth of all documents that no model learns from."""
    return crc_of_id(doc_id) % 5 == 0


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers over all bits (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
