"""What the corpus operators share: Arrow batch mapping and small helpers."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partlake.session import ship

#: Rows and, about, bytes that a Python function gets at once; Spark itself ends a batch at 64 MB.
ROWS_AT_ONCE = 2048
BYTES_AT_ONCE = 4 << 20


#: What a worker process remembers between batches, by module: how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


def forget_others(owner: str) -> None:
    """Workers live on between stages: drop what modules other than the one at work remember."""
    for name, forget in MEMORIES.items():
        if name != owner:
            forget()


def release() -> None:
    """Give memory that Arrow and the C library hold for reuse back to the machine: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_batches(df: DataFrame, make: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """Apply ``make`` to slices of a batch; it returns a column for each field of ``schema``."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(make.__module__)
        for batch in batches:
            step = max(1, min(ROWS_AT_ONCE, batch.num_rows * BYTES_AT_ONCE // max(1, batch.nbytes)))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                if piece.num_rows:
                    out = make(piece)
                    arrays = [x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in out.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=list(out))
                    del out, arrays
            piece = batch = None
            release()

    return df.mapInArrow(run, schema)


def fold(key: Column) -> Column:
    """crc32 of a key as text; of the empty text for a null key."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def texts_of(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]
