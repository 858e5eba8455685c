"""Helpers that the document operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from catalog_engine.session import ensure_checkpoint_dir

SLICE_BYTES = 2 << 20
"""Text bytes that a task works on at once; a single longer text makes a slice of its own."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null texts as empty ones."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder (spark.checkpoint.dir; a scratch one in local mode)."""
    base = ensure_checkpoint_dir(spark, allow_local=True).rstrip("/")
    return f"{base}/{label}-{uuid.uuid4().hex}"


BATCH_ROWS = 1000
"""Rows with whole texts or sets that go to Python at once; Spark's 10,000 are tens of MB on either side."""

INNERMOST = []
_passing: ContextVar[list | None] = ContextVar("tables of the innermost passing() block", default=None)


def stored(df: DataFrame, label: str, block: list | None = INNERMOST, batch_rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, so what follows
    survives lost executors and never computes df again. The table goes at the end of the
    given passing() block, by default of the innermost one, if any; with None it stays.
    batch_rows bounds the rows that go to Python at once."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, str(batch_rows or before))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(setting, before)
    block = _passing.get() if block is INNERMOST else block
    if block is not None:
        block.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[list]:
    """A block of work: the tables stored for it are deleted at its end."""
    tables: list = []
    token = _passing.set(tables)
    try:
        yield tables
    finally:
        _passing.reset(token)
        for spark, path in tables:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many bytes of text each (one row at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
               schema: str | StructType, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over slices of bounded text size. make() runs once in each task and
    returns the function of a slice."""

    def run(batches):
        one = make()
        for batch in batches:
            for part in slices(batch, column, most):
                yield one(part)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return df.mapInArrow(run, schema)


SIEVE_BITS = 26
"""A sieve has two to the power of this bits, in words of 64: a table of a million rows at most."""


def sifted(df: DataFrame, col: str, keys: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of df whose hash in a column may be among the keys, a column of the same name: all that
    are, and few others. With left_anti the other rows. Nothing is shuffled: the keys become a table of
    bits, of bounded size however many they are, that is broadcast. With more keys than bits it lets all pass."""
    at = F.col(col).bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    word, bit = F.shiftright(at, 6), at.bitwiseAND(F.lit(63)).cast("int")
    words = (keys.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit"))
             .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))
    return df.join(F.broadcast(words), (word == F.col("_word")) & (F.getbit("_bits", bit) == 1), how)


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """One Arrow list for each array."""
    offsets = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    flat = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat).cast(kind))


def is_held_out(divisor: int, remainder: int):
    """crc32 of the id's decimal digits, modulo a divisor, is the remainder."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(divisor)) == remainder
