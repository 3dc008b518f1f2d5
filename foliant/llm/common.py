"""What the training-data operators share: scratch tables, words, row checks."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import reach_workers
from ..storage import materialize, removed_at_exit, scratch

__all__ = ["LOWER", "SPACES", "UPPER", "ascii_lower", "fit_in_task", "lean", "learns", "materialize", "removed_at_exit", "scratch", "table"]

#: ASCII white space of the word and line contracts: space and 0x09-0x0D.
SPACES = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def _free() -> None:
    """Returns memory that allocators hold back, so that idle Python workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _hold() -> None:
    """Has the C library hold freed arrays of up to 32 MB, 128 MB in all, for the next ones:
    pages that go back after every step must be cleared again for the step after it."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 32 << 20)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], hold: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; at a task's end the worker gives back what it doesn't need.
    hold: until then it keeps what large arrays took."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if hold:
            _hold()
        yield from run(batches)
        _free()

    return whole


def fit_in_task(rows: DataFrame, fit: Callable[[pa.Table], object]) -> object | None:
    """``fit`` of all ``rows``, a sample or table of bounded size, run in one executor
    task, where numpy has one thread; None if there are no rows."""

    def run(t: pa.Table) -> pa.Table:
        return pa.table({"model": pa.array([pickle.dumps(fit(t))], pa.binary())})

    got = rows.groupBy().applyInArrow(run, "model binary").collect()  # one row
    return pickle.loads(bytes(got[0]["model"])) if got else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def learns(c: Column, modulus: int, left_out: int) -> Column:
    """True for rows a model may learn from: crc32 of the id as text, by remainder."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus != left_out
