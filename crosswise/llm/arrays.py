"""Arrow and numpy helpers for columns of text."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def trim() -> None:
    """Give freed memory back to the system: workers live on, and the next operator's tasks share their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to give back
        pass


def pieces_of(batch: pa.RecordBatch, text: str = "text", most: int = 8 << 20):
    """Cut a batch so that each piece has about ``most`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.cumsum(size)
    start = 0
    while start < batch.num_rows:
        base = at[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(at, base + most, side="right")))
        yield batch.slice(start, end - start)
        start = end
    trim()


def texts_of(batch: pa.RecordBatch, text: str = "text") -> pa.Array:
    """The text column with nulls as empty strings."""
    return pc.fill_null(batch.column(text).cast(pa.string()), "")


def space_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words between ASCII white space with A-Z lower-cased: all words in order, and each text's number of words."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = split.flatten()
    whole = pc.greater(pc.binary_length(flat), 0)
    kept = whole.to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(kept)))
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    return flat.filter(whole), np.diff(ends[offsets])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - first, lengths)


def slices_of(ids: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """``ids`` cut into runs of these lengths, one after another, as binary values (little-endian uint32) over one buffer."""
    ends = np.concatenate(([0], np.cumsum(lengths))) * 4
    kind, width = (pa.binary(), np.int32) if ends[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    body = np.ascontiguousarray(ids, "<u4")
    return pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(body)]).cast(pa.binary())


def whole_row(docs: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that an operator's own columns cannot clash with them; ``select("row.*")`` gives them back."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias(name)


def filtered(docs: DataFrame, judge: Callable[[], Callable[[pa.RecordBatch], pa.Array]], most: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` that a test of bounded pieces keeps. ``judge()`` makes the test, once a task; columns may have any names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = judge()
        for batch in batches:
            for piece in pieces_of(pa.RecordBatch.from_struct_array(batch.column("row")), most=most):
                yield piece.filter(keep(piece))

    return docs.select(whole_row(docs)).mapInArrow(run, docs.schema)
