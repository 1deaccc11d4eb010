"""Benchmark decontamination with suffix arrays of the training texts (operator 3).

Each task sorts the word suffixes of a bounded run of whole documents into a
suffix array and binary-searches every window of the benchmark in it. The
interval found holds all verbatim occurrences, with their documents and places;
from each, the match is followed word by word to its full length. Documents
never meet, so the plan has no shuffle: a shard is what one task holds.

The array is sparse and as deep as a window: it leaves out suffixes whose first words (as many as the
shortest window has) are not all words of the benchmark, since none of those
can start an occurrence, and orders the others by the words of one window, since no window tells
more of them apart. Words outside the benchmark's vocabulary share one id.

The benchmark is taken in blocks of bounded text size, streamed to the driver one at a time. With one block the
documents pass once. With more, every block is a pass of its own that writes only what it found, for
documents that it hit; these findings are put together by document. So any number
of items is answered in full, and no task holds more than one block.

Defined results: a null or empty text has no words, hits or items; an item
without words has no windows; equal items are each counted; an item without an id counts for hits and contamination, all such items
count as one in n_items, and none is named in items_sha256 or as the longest match; repeated documents
are judged each; a very long text is a shard of its own; an empty benchmark or table gives clean or no rows; other
columns are ignored, or kept by ``decontaminate`` whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.llm.arrays import filtered, pieces_of, ragged, texts_of, whole_row
from crosswise.session import ship, stage

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, longest_start long, longest_item long"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


class WindowSet:
    """The distinct windows of a block of items, as word ids, and who has them."""

    def __init__(self, items: list[tuple[int | None, str | None]], width: int):
        self.vocabulary: dict[bytes, int] = {}
        self.items = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]) for name, text in items]
        owners: dict[tuple[int, ...], list[tuple[int, int]]] = {}
        for k, (_, ids) in enumerate(self.items):
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1) if ids else ():
                owners.setdefault(tuple(ids[at : at + size]), []).append((k, at))
        self.windows, self.owners = list(owners), list(owners.values())
        self.names = [frozenset(self.items[k][0] for k, _ in own) for own in self.owners]
        self.longest: dict[bytes, tuple] = {}  # by a run of hit words: most documents that hold a passage hold the same one
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(self.windows):
            by_size.setdefault(len(w), []).append(k)
        self.by_size = {n: (np.array(ks), np.array([self.windows[k] for k in ks], np.int64)) for n, ks in by_size.items()}
        self.shortest = min(by_size, default=0)
        self.depth = max(by_size, default=0)


def suffix_array(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions ``at`` in the order of the first ``depth`` word ids from each (stable).

    ``ids`` ends with ``depth`` zeros. Prefix doubling: each pass orders by
    twice as many words as the pass before, and stops once all ranks differ.
    """
    rank = ids.astype(np.int64)
    span = 1
    while span < depth:
        ahead = np.zeros_like(rank)
        step = min(span, depth - span)
        ahead[: len(rank) - step] = rank[step:]
        pair = rank * (int(rank.max()) + 1) + ahead
        rank = np.unique(pair, return_inverse=True)[1].astype(np.int64)
        span += step
    return at[np.argsort(rank[at], kind="stable")]


def interval(ids: np.ndarray, array: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window (a row of word ids), by binary search, the interval of ``array`` whose suffixes start with it."""
    size = windows.shape[1]
    reach = np.arange(size)

    def bound(after: bool) -> np.ndarray:
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), len(array), np.int64)
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                return low
            mid = (low[todo] + high[todo]) >> 1
            here = ids[array[mid][:, None] + reach]
            differ = here != windows[todo]
            first = differ.argmax(axis=1)
            row = np.arange(len(todo))
            less = np.where(differ.any(axis=1), here[row, first] < windows[todo][row, first], after)
            low[todo] = np.where(less, mid + 1, low[todo])
            high[todo] = np.where(less, high[todo], mid)

    return bound(False), bound(True)


def occurrences(ids: np.ndarray, known: WindowSet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every place where a window stands in ``ids`` (0 between documents): place, window, its size."""
    if not known.windows:
        return (np.zeros(0, np.int64),) * 3
    ids = np.concatenate((ids, np.zeros(known.depth, ids.dtype)))
    runs = np.concatenate(([0], np.cumsum(ids > 0)))
    at = np.flatnonzero(runs[known.shortest :] - runs[: -known.shortest] == known.shortest)
    if not len(at):
        return (np.zeros(0, np.int64),) * 3
    # Only the ``depth`` words from each suffix's place matter for its rank; the rest is left out.
    marks = np.zeros(len(ids) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, np.minimum(at + known.depth, len(ids)), -1)
    near = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    array = near[suffix_array(ids[near], np.searchsorted(near, at), known.depth)]
    found = []
    for size, (names, windows) in known.by_size.items():
        low, high = interval(ids, array, windows)
        n = high - low
        found.append((array[ragged(low, n)], np.repeat(names, n), np.full(int(n.sum()), size)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _longest(run: np.ndarray, known: WindowSet, at: list[int], windows: list[int]) -> tuple[int, int, int | None]:
    """The longest match in a run of hit words: its size, its place in the run and the smallest id of an item that has it."""
    best = None
    for p, w in zip(at, windows):
        for item, spot in known.owners[w]:
            name, own = known.items[item]
            if spot and p and run[p - 1] == own[spot - 1]:
                continue  # the match starts before this window
            n = len(known.windows[w])
            while spot + n < len(own) and p + n < len(run) and run[p + n] == own[spot + n]:
                n += 1
            found = (-n, p, name is None, name or 0)
            best = min(best, found) if best else found
    return -best[0], best[1], None if best[2] else best[3]


@dataclass(frozen=True)
class Finding:
    """What a block of items shows of one text."""

    words: int
    hit: np.ndarray
    names: frozenset
    longest: tuple[int, int, int | None] | None


def _better(a: tuple | None, b: tuple | None) -> tuple | None:
    """Of two longest matches the longer one, then the earlier, then that of the smaller item id."""
    return min((x for x in (a, b) if x), key=lambda x: (-x[0], x[1], x[2] is None, x[2] or 0), default=None)


def _judge(texts: list[str], known: WindowSet) -> Iterator[Finding]:
    get = known.vocabulary.get
    codes = [[get(w, 0) for w in words_of(t)] for t in texts]
    sizes = np.array([len(c) for c in codes], np.int64)
    flat: list[int] = []
    for c in codes:
        flat += c
        flat.append(0)
    ids = np.array(flat, np.int64)
    begin = np.cumsum(sizes + 1) - sizes - 1
    places, windows, lengths = occurrences(ids, known)
    hit = np.zeros(len(ids) + 1, np.int64)
    np.add.at(hit, places, 1)
    np.add.at(hit, places + lengths, -1)
    hit = np.cumsum(hit)[:-1] > 0
    order = np.argsort(places, kind="stable")
    places, windows = places[order], windows[order]
    cut = np.searchsorted(places, np.append(begin, len(ids)))
    for k in range(len(texts)):
        flags = hit[begin[k] : begin[k] + sizes[k]]
        if cut[k] == cut[k + 1]:
            yield Finding(int(sizes[k]), flags, frozenset(), None)
            continue
        own, spots = windows[cut[k] : cut[k + 1]], places[cut[k] : cut[k + 1]] - begin[k]
        names = frozenset().union(*(known.names[w] for w in np.unique(own).tolist()))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))).reshape(-1, 2)
        best = None
        for a, b in edges.tolist():
            run = ids[begin[k] + a : begin[k] + b]
            key = run.tobytes()
            if key not in known.longest:
                if len(known.longest) >= 4096:
                    known.longest.clear()
                some = slice(*np.searchsorted(spots, (a, b)).tolist())
                known.longest[key] = _longest(run, known, (spots[some] - a).tolist(), own[some].tolist())
            n, at, name = known.longest[key]
            best = _better(best, (n, a + at, name))
        yield Finding(int(sizes[k]), flags, names, best)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list]:
    """Items in blocks of bounded size, streamed to the driver; each holds at least one item."""
    held, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("text is not null").toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def _report(names: pa.Array, found: list[Finding]) -> pa.RecordBatch:
    own = [sorted(str(n) for n in f.names if n is not None) for f in found]
    best = [f.longest or (0, None, None) for f in found]
    columns = [
        names,
        pa.array([f.words for f in found], pa.int64()),
        pa.array([int(f.hit.sum()) for f in found], pa.int64()),
        pa.array([len(f.names) for f in found], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in own]),
        pa.array([bool(f.hit.any()) for f in found]),
        *(pa.array([b[k] for b in best], pa.int64()) for k in range(3)),
    ]
    return pa.record_batch(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _findings(docs: DataFrame, block: list, width: int, shard_bytes: int) -> DataFrame:
    """(id, h, words, hit, names, longest) of the documents in which a block's items occur; rows alike once or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(block, width)
        for batch in batches:
            for piece in pieces_of(batch, most=shard_bytes):
                found = list(_judge(texts_of(piece).to_pylist(), known))
                some = [k for k, f in enumerate(found) if f.names]
                own = [found[k] for k in some]
                longest = pa.array([[*f.longest[:2], f.longest[2] or 0, int(f.longest[2] is None)] for f in own], pa.list_(pa.int64()))
                ids = [pa.array([sorted(n for n in f.names if n is not None) for f in own], pa.list_(pa.int64())), pa.array([None in f.names for f in own], pa.bool_())]
                hits = pa.array([np.packbits(f.hit).tobytes() for f in own], pa.binary())
                columns = [piece.column("id").take(pa.array(some, pa.int64())), piece.column("h").take(pa.array(some, pa.int64())), hits, *ids, longest]
                yield pa.record_batch(columns, names=["id", "h", "hit", "names", "unnamed", "longest"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, "id long, h long, hit binary, names array<bigint>, unnamed boolean, longest array<bigint>")


def _passes(docs: DataFrame, blocks: Iterator[list], width: int, shard_bytes: int) -> DataFrame:
    """The findings of all blocks, put together: one row for each document hit."""
    parts = [stage(_findings(docs, block, width, shard_bytes), "findings") for block in blocks]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    key = ("id", "h")
    names = every.select(*key, F.explode("names").alias("name")).distinct().groupBy(*key).agg(F.collect_list("name").alias("names"))
    # the longest first, then the earliest, then the smallest named item
    longest = F.struct(-F.get("longest", 0), F.get("longest", 1), F.get("longest", 3), F.get("longest", 2))
    rest = every.groupBy(*key).agg(F.collect_set("hit").alias("hits"), F.max("unnamed").alias("unnamed"), F.min(longest).alias("longest"))
    right = names.select(F.col("id").alias("i"), F.col("h").alias("g"), "names")
    return stage(rest.join(right, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left").drop("i", "g"), "findings")


def _first_two(blocks: Iterator[list]) -> tuple[list, Iterator[list] | None]:
    """The first block (empty if there is none), and all blocks if there are more."""
    first = next(blocks, [])
    second = next(blocks, None)
    return first, None if second is None else chain([first, second], blocks)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """One row per document: its words, those inside verbatim occurrences, the items, and the longest match with its place."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    block, more = _first_two(_blocks(benchmark, block_bytes))
    if more is None:

        def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = WindowSet(block, width)
            for batch in batches:
                for piece in pieces_of(batch, most=shard_bytes):
                    yield _report(piece.column("doc_id"), list(_judge(texts_of(piece).to_pylist(), known)))

        return rows.mapInArrow(once, SCHEMA)
    found = _passes(rows, more, width, shard_bytes)
    marked = rows.withColumn("h", F.xxhash64("text"))
    joined = marked.join(found.withColumnsRenamed({"id": "i", "h": "g"}), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, hits, names, unnamed, best in zip(*(batch.column(c).to_pylist() for c in ("text", "hits", "names", "unnamed", "longest"))):
                n = len(words_of(text))
                flags = np.zeros(n, bool)
                for hit in hits or ():
                    flags |= np.unpackbits(np.frombuffer(hit, np.uint8), count=n).astype(bool)
                size, at, bare, name = best.values() if best else (0, None, 1, None)
                made.append(Finding(n, flags, frozenset([*(names or ()), *([None] if unnamed else ())]), (-size, at, None if bare else name) if best else None))
            yield _report(batch.column("doc_id"), made)

    return joined.select("doc_id", "text", "hits", "names", "unnamed", "longest").mapInArrow(folded, SCHEMA)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 8 << 20, shard_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` without the documents that hold a window of the benchmark; all columns stay."""
    ship(docs.sparkSession)
    block, more = _first_two(_blocks(benchmark, block_bytes))
    if more is None:

        def clean():
            known = WindowSet(block, width)
            return lambda piece: pa.array([not f.names for f in _judge(texts_of(piece).to_pylist(), known)], pa.bool_())

        return filtered(docs, clean, shard_bytes)
    found = _passes(docs.select("doc_id", "text"), more, width, shard_bytes).select(F.col("id").alias("i"), F.col("h").alias("g"))
    marked = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    return marked.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left_anti").select("row.*")
