"""Arrow batches in and out of numpy: the base of the operators here that run in Python.

Every operator that needs Python takes whole rows through ``mapInArrow``. A slice of rows is cut
so that its text stays near ``SLICE_BYTES`` (one row alone may be longer), which bounds a worker's
memory whatever the batch size of the session.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Batches between the JVM and Python of a few MB, whatever number of rows that is, unless the session says otherwise.

    By default a batch has 10,000 rows or 64 MB; each task holds some in the JVM and in Python.
    """
    if spark.conf.get(_LIMIT, None) is None:
        spark.conf.set(_LIMIT, str(BATCH_BYTES))


@cache
def _lean() -> Callable[[], object]:
    """Large arrays of this process go back to the system when freed; returns what gives back the rest.

    Workers are reused between tasks; without this, each keeps the most that it ever held. Called where
    rows are cut, so that a process which only imports this stays as it is.
    """
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 2 << 20)  # M_MMAP_THRESHOLD, fixed from now on
        libc.mallopt(-1, 8 << 20)  # M_TRIM_THRESHOLD
        return lambda: libc.malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return lambda: None


def settled() -> None:
    """Gives back freed memory: at the end of a task, and before the first slice of one, as the task before may have left some."""
    pa.default_memory_pool().release_unused()
    _lean()()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows one after the other, and where each row begins (one more than rows).

    A null row has no bytes.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def row_text(data: np.ndarray, at: np.ndarray, row: int) -> str:
    """The text of a row; bytes that are no UTF-8 become U+FFFD."""
    return data[at[row] : at[row + 1]].tobytes().decode("utf-8", "replace")


def slices(batch: pa.RecordBatch, text: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``budget`` bytes of text."""
    _lean()
    _, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(at, at[start] + budget, side="right")) - 1)
        yield batch.slice(start, min(stop, batch.num_rows) - start)
        start = stop


def lists(values: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values))


def with_columns(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    budget: int = SLICE_BYTES,
) -> DataFrame:
    """``df`` with ``fields`` added, row by row, in the order of the rows.

    ``make()`` is called once in each task and returns a function from a slice of rows to the new
    columns' arrays. An input column whose name is that of a new one (in any case) is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        settled()
        work = make()
        for batch in batches:
            for part in slices(batch, text, budget):
                added = work(part)
                yield pa.RecordBatch.from_arrays(
                    [part.column(part.schema.get_field_index(n)) for n in names] + added,
                    names=names + [f.name for f in fields],
                )
        settled()

    return df.mapInArrow(run, T.StructType(kept + fields))
