"""Adding computed columns to a table, one Arrow batch at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

Columns = dict[str, pa.Array]

# Bytes of text worked on at once; a longer single text is a slice of its own.
SLICE = 1_000_000


def add_columns(
    df: DataFrame, uses: Sequence[str], keep: Sequence[str], adds: str, work: Callable[[Columns], Columns]
) -> DataFrame:
    """``keep`` columns of every row, then the columns ``adds`` (DDL) that ``work`` makes of the columns ``uses``.

    Rows stay where they are: nothing is shuffled. A kept column with the name
    of an added one gives way to it, and all other columns are left out.
    """
    new = StructType.fromDDL(adds)
    kept = [k for k in dict.fromkeys(keep) if k not in new.names]
    schema = StructType([df.schema[k] for k in kept] + new.fields)
    columns = list(dict.fromkeys([*kept, *uses]))
    used = list(uses)
    names = new.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, columns.index(used[0])):
                made = work({name: part.column(columns.index(name)) for name in used})
                arrays = [part.column(columns.index(k)) for k in kept] + [made[n] for n in names]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *names])

    return df.select(*columns).mapInArrow(run, schema)


def _parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of a few slices of text each, so that what is made of a piece stays small."""
    values = batch.column(column)
    if pa.types.is_list(values.type):
        size = pc.multiply(values.value_lengths().fill_null(0), 4)
    else:
        size = pc.binary_length(values).fill_null(0)
    ends = np.concatenate(([0], np.cumsum(size.to_numpy().astype(np.int64) + 1)))
    for i, j in slices(ends, 4 * SLICE):
        yield batch.slice(i, j - i)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if offsets is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each, one row at least."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
