"""Small helpers of the operators: tables, bounded slices of Arrow batches, joins on hot keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Text bytes that a Python step handles at once; a longer text is a slice of its own.
SLICE_BYTES = 4 << 20
#: Largest table of verdicts or rates that is broadcast, in rows of at most a few hundred bytes.
BROADCAST_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a slice, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def release() -> None:
    """Give freed memory back: a Python worker lives on for the next stage, beside that stage's own."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_texts(
    df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, column: str = "text", limit: int = SLICE_BYTES
) -> DataFrame:
    """Rows from each bounded slice of ``df``. ``fn`` makes a task's step, which returns the columns of ``schema``."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or fn()
            for part in slices(batch, column, limit):
                out = step(part)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[n] for n in names)], names)
                del out
            release()

    return df.mapInArrow(run, schema)


def filter_texts(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], np.ndarray]], column: str = "text") -> DataFrame:
    """The rows for which a task's step says true, with all their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches:
            step = step or fn()
            for part in slices(batch, column):
                yield part.filter(pa.array(step(part), pa.bool_()))
            release()

    return df.mapInArrow(run, df.schema)


def join_small(df: DataFrame, keyed: DataFrame, key: str, rows: int, buckets: int = 64, left: str | None = None) -> DataFrame:
    """Left join of ``df`` (its key is ``left``) with one row per key, null keys equal, where a key may hold a third of ``df``.

    ``rows`` is the counted size of ``keyed``. Up to ``BROADCAST_ROWS`` it is broadcast; beyond that
    each of its rows is repeated for ``buckets`` salts, so that a hot key is dealt to as many tasks.
    """
    right = keyed.withColumnRenamed(key, "_key")
    if rows <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), F.col(left or key).eqNullSafe(F.col("_key")), "left").drop("_key")
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    right = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    on = F.col(left or key).eqNullSafe(F.col("_key")) & (F.col("_salt") == F.col("_right_salt"))
    return salted.join(right, on, "left").drop("_key", "_salt", "_right_salt")


def hash_unit(*parts: Column | str, seed: int) -> Column:
    """A number in [0, 1) with 52 bits from md5, the same in every engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
