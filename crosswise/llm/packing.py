"""Packing by best-fit decreasing (operator 7).

Documents become ids, an end id is appended, and overlong documents are first
cut into full windows. What is left of each document goes, longest first, into
the open window with the least sufficient room, found by a segment tree over
the possible remaining capacities.

Packing needs no document to meet a particular other one, so every input
partition packs its own rows, in blocks of bounded size: there is no shuffle,
memory does not depend on the input, and a lost task repacks one partition.
A block's last windows are the only ones that a larger block would fill better.

Defined results: a null or empty text is its end id alone; a very long text is encoded by
itself and cut into full windows and one rest; repeated rows are packed each; ties keep input order; an
empty table gives no rows; other columns of the input are ignored; a null doc_id is kept as null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crosswise.llm.arrays import pieces_of, slices_of, texts_of, trim
from crosswise.llm.tokens import encoder
from crosswise.session import ship

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class RoomTree:
    """Counts of open windows by remaining capacity, as a segment tree."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, room: int, window: int) -> None:
        self.open[room].append(window)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of the tightest window with room for ``need``."""
        count, i = self.count, need + self.width
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # climb until a right sibling has windows
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.width:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.width
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each item's window and offset in it, and the number of windows. Every length is 1 to capacity."""
    window, offset, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    tree = RoomTree(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room, at = tree.take(need) or (capacity, opened)
        opened += at == opened
        window[i], offset[i] = at, capacity - room
        if room > need:
            tree.put(room - need, at)
    return window, offset, opened


def _pack_block(ids: list, counts: list, names: list, capacity: int, base: int) -> tuple[pa.RecordBatch, int]:
    flat, count = np.concatenate(ids), np.concatenate(counts)
    full, rest = count // capacity, count % capacity
    tails = np.flatnonzero(rest)
    window, offset, opened = best_fit_decreasing(rest[tails], capacity)
    # Pieces in the order of their ids: each document's full windows, then its tail.
    pieces = full + (rest > 0)
    row = np.repeat(np.arange(len(count)), pieces)
    start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
    length = np.minimum(capacity, count[row] - start)
    whole = length == capacity
    sequence, place = np.empty(len(row), np.int64), np.zeros(len(row), np.int64)
    sequence[whole] = base + opened + np.arange(int(whole.sum()))
    sequence[~whole], place[~whole] = base + window, offset
    columns = [pa.concat_arrays(names).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in (start, length, count[row], sequence, place)), slices_of(flat, length)]
    return pa.record_batch(columns, names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]), opened + int(whole.sum())


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece: where it comes from, where it stands in which sequence, and its ids (little-endian uint32).

    ``vocabulary``: path of a file of the tokenizers library. ``block_tokens``
    bounds what a task holds (4 bytes each), not what is packed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, base = encoder(vocabulary), TaskContext.get().partitionId() << 32
        ids, counts, names, held = [], [], [], 0
        for batch in batches:
            for piece in pieces_of(batch, most=4 << 20):
                flat, count = code.encode(texts_of(piece), end_id)
                ids.append(flat)
                counts.append(count)
                names.append(piece.column("doc_id").cast(pa.int64()))
                held += len(ids[-1])
                if held >= block_tokens:
                    out, used = _pack_block(ids, counts, names, capacity, base)
                    yield out
                    base, ids, counts, names, held = base + used, [], [], [], 0
        if held:
            yield _pack_block(ids, counts, names, capacity, base)[0]
        ids.clear()
        trim()

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
