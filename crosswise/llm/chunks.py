"""Substring dedup by content-defined chunking (operator 4).

A gear hash rolls over the bytes; its value after the last byte of a word covers
the 16 bytes before. A word ends a chunk if its value is the largest among the
``reach`` words on either side (the first of equals), so chunks are runs of whole
words, at least ``reach`` + 1 long, and where they end depends on nearby text only: an insertion shifts none but its
neighbours. Runs without such a word are cut every ``longest`` words, counted from the last cut.

Where words repeat with a period of ``reach`` or less no value is the largest; such a stretch is cut at
the largest value of its period, every 12 words, so its chunks are alike wherever it begins.

Texts alike count once: the row of smallest doc_id stands for them, and the others are
repeats from end to end. Of the texts that stay, chunks are deduplicated by digest.
Runs of consecutive chunks that all occur more than once, and could with the chunks beside them
hold ``least`` words, get digests for their sequences of 16 to 40 words, from every chunk on.
A sequence's first occurrence, by (doc_id, text hash, place), stays; later ones of one
document and shift are put together and compared word by word with the text beside the earlier
occurrence, so that a repeat reaches as far as the repetition does. What stands there
verbatim for ``least`` words is a repeat. Longer sequences have first occurrences of
their own, so a passage is found too where its parts stood apart in still earlier documents.

The shuffles carry digests and places, pre-aggregated for counts and first occurrences; a digest
that a third of the documents share is split by the skew handling of the join, as neither
side collects its group. Texts are shuffled once to fetch the words beside the runs, and once
more where texts are edited.

Defined results: a null or empty text has no chunks; rows alike in doc_id and text
count as one document; a null doc_id comes first in the order; a passage that
repeats inside one document is a repeat there, also where it overlaps itself, as periodic junk does;
a very long text is one row of a list of its chunks; an empty table gives no rows; other columns are
ignored, or kept by ``drop_repeats`` whatever their names, which leaves null texts null and may leave a text empty.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.llm.arrays import pieces_of, texts_of, whole_row
from crosswise.session import discard, ship, stage

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
GEAR = np.random.default_rng(20240501).integers(0, 1 << 16, 256).astype(np.uint16)


@dataclass(frozen=True)
class Options:
    reach: int = 3
    longest: int = 64
    least: int = 50
    sequences: tuple[int, ...] = (16, 24, 32, 40)


def gear_hashes(body: np.ndarray) -> np.ndarray:
    """h = 2h + gear(byte) modulo 2^16 at every byte, by doubling: each value covers 16 bytes."""
    h = GEAR[body]
    for shift in (1, 2, 4, 8):
        h[shift:] = h[shift:] + (h[:-shift] << np.uint16(shift))
    return h


def words_in(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word (a run of bytes that are no ASCII white space)."""
    edge = np.diff(np.concatenate(([True], SPACE[body], [True])).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def chunk_ends(body: np.ndarray, ends: np.ndarray, o: Options) -> np.ndarray:
    """For words ending at ``ends``, the number of words up to each chunk's end."""
    n = len(ends)
    if not n:
        return np.zeros(0, np.int64)
    value = gear_hashes(body)[ends - 1].astype(np.int32)
    padded = np.concatenate((np.full(o.reach, -1), value, np.full(o.reach, -1)))
    top = np.ones(n, bool)
    for k in range(1, o.reach + 1):
        top &= value > padded[o.reach - k : o.reach - k + n]
        top &= value >= padded[o.reach + k : o.reach + k + n]
    cuts = np.flatnonzero(top) + 1
    cuts = np.unique(np.concatenate((cuts, [n])))
    gaps = np.diff(cuts, prepend=0)
    if gaps.max() > o.longest:
        more = [_inner_cuts(value[a - g : a], o) + a - g for a, g in zip(cuts[gaps > o.longest], gaps[gaps > o.longest])]
        cuts = np.unique(np.concatenate((cuts, *more)))
    return cuts


def _inner_cuts(value: np.ndarray, o: Options) -> np.ndarray:
    """Cuts of a stretch without a largest value: in step with its period if it has one, and never over ``longest`` words apart."""
    same = np.zeros(len(value), bool)
    for k in range(1, o.reach + 1):
        same[k:] |= value[k:] == value[:-k]
    out, at = [], 0
    if same.any():
        step = math.lcm(*range(1, o.reach + 1)) * 2
        for k in (np.flatnonzero(same & (value == value[same].max())) + 1).tolist():
            if not out or k >= at + step:
                out.append(k)
                at = k
    ends = np.array([0, *out, len(value)])
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        out += range(a + o.longest, b, o.longest)
    return np.array(sorted(out), np.int64)


def chunks_of(text: bytes, o: Options) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digest, first word and number of words of each chunk of a text."""
    from xxhash import xxh3_64_intdigest

    body = np.frombuffer(text, np.uint8)
    starts, ends = words_in(body)
    cuts = chunk_ends(body, ends, o)
    first = np.concatenate(([0], cuts[:-1])) if len(cuts) else cuts
    at = zip(starts[first].tolist(), ends[cuts - 1].tolist())
    digest = np.fromiter((xxh3_64_intdigest(text[a:b]) for a, b in at), np.uint64, len(cuts))
    return digest.view(np.int64), first, cuts - first


def _chunk_lists(docs: DataFrame, o: Options) -> DataFrame:
    """(id, h, digests, at) of every row: its chunks' digests, and their first words, the number of all words last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                found = [chunks_of(t.as_py().encode(), o) for t in texts_of(piece)]
                size = np.array([len(f[0]) for f in found], np.int64)
                ends = [np.append(at, at[-1] + n[-1] if len(at) else 0).astype(np.int32) for _, at, n in found]
                digests = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size))).astype(np.int32), np.concatenate([f[0] for f in found]))
                places = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(size + 1))).astype(np.int32), np.concatenate(ends))
                yield pa.record_batch([piece.column("id"), piece.column("h"), digests, places], names=["id", "h", "digests", "at"])

    return docs.select("id", "h", "text").mapInArrow(run, "id long, h long, digests array<bigint>, at array<int>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), "text")


def _runs_of(marked: np.ndarray, at: np.ndarray, o: Options) -> Iterator[tuple[int, int]]:
    """Runs (first, last + 1) of consecutive marked chunks that could hold ``least`` words with what may agree beside them."""
    edge = np.flatnonzero(np.diff(marked, prepend=-2) != 1)
    for a, b in zip(edge.tolist(), np.append(edge[1:], len(marked)).tolist()):
        first, last = int(marked[a]), int(marked[b - 1]) + 1
        begin = at[first - 1] + 1 if first else 0
        end = at[last + 1] - 1 if last + 1 < len(at) else at[last]
        if end - begin >= o.least:
            yield first, last


def _sequences(lists: DataFrame, o: Options) -> DataFrame:
    """(digest, id, h, at, n) of the sequences in runs of chunks that all occur more than once: from every chunk on, the fewest that have so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            made, owner = [], []
            for k, (digests, at, marked) in enumerate(zip(*(batch.column(n) for n in ("digests", "at", "marked")))):
                raw, at = digests.values.to_numpy(zero_copy_only=False), at.values.to_numpy(zero_copy_only=False).astype(np.int64)
                for first, last in _runs_of(np.unique(marked.values.to_numpy(zero_copy_only=False)), at, o):
                    body, start, end = raw[first:last].tobytes(), at[first:last], at[first + 1 : last + 1]
                    stops = np.stack([np.searchsorted(end, start + words) for words in o.sequences])
                    i = np.broadcast_to(np.arange(last - first), stops.shape)
                    new = stops < last - first
                    new[1:] &= stops[1:] != stops[:-1]
                    i, j = i[new], stops[new]
                    found = [xxh3_64_intdigest(body[8 * x : 8 * y + 8]) for x, y in zip(i.tolist(), j.tolist())]
                    made.append((np.array(found, np.uint64).view(np.int64), start[i], end[j] - start[i]))
                    owner.append(np.full(len(found), k))
            if made:
                digest, at, n = (np.concatenate(x) for x in zip(*made))
                own = [batch.column(c).take(pa.array(np.concatenate(owner))) for c in ("id", "h")]
                yield pa.record_batch([pa.array(digest), *own, pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))], names=["digest", "id", "h", "at", "n"])

    return lists.mapInArrow(run, "digest long, id long, h long, at int, n int")


def _seeds(votes: DataFrame) -> DataFrame:
    """Stretches that stand verbatim at one earlier place: sequences of one document and shift that overlap or touch, put together."""
    here = F.col("at") - F.col("fat")
    place = ("id", "h", "fid", "fh", "shift")
    spans = votes.select("id", "h", "fid", "fh", here.alias("shift"), "at", "n").groupBy(*place).agg(F.array_sort(F.collect_set(F.struct("at", "n"))).alias("v"))
    end = lambda x: x["at"] + x["n"]
    span = lambda s, e: F.struct(s.alias("s"), e.alias("e"))
    joined = F.aggregate(
        "v", F.expr("cast(array() as array<struct<s:int,e:int>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["at"] <= F.element_at(done, -1)["e"]),
            F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(span(F.element_at(done, -1)["s"], F.greatest(F.element_at(done, -1)["e"], end(x))))),
        ).otherwise(F.concat(done, F.array(span(x["at"], end(x))))),
    )
    return spans.select(*place, F.explode(joined).alias("x")).select("id", "h", "fid", "fh", F.col("x.s").alias("s"), F.col("x.e").alias("e"), (F.col("x.s") - F.col("shift")).alias("fs"), (F.col("x.e") - F.col("shift")).alias("fe"))


def _beside(docs: DataFrame, asked: DataFrame, o: Options) -> DataFrame:
    """Hashes of the words before (side 0, nearest first) or after (side 1) each asked place of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            for piece in pieces_of(batch):
                rows = []
                for i, h, text, spots in zip(*(piece.column(n).to_pylist() for n in ("id", "h", "text", "spots"))):
                    raw = (text or "").encode()
                    starts, ends = words_in(np.frombuffer(raw, np.uint8))
                    for spot in spots:
                        at, side = spot["at"], spot["side"]
                        which = range(at - 1, max(-1, at - 1 - o.longest), -1) if side == 0 else range(at, min(len(starts), at + o.longest))
                        rows.append((i, h, at, side, [xxh3_64_intdigest(raw[starts[w] : ends[w]]) - (1 << 63) for w in which]))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(list(zip(*rows)) or [[]] * 5, kinds)], names=["id", "h", "at", "side", "words"])

    spots = asked.distinct().groupBy("id", "h").agg(F.collect_list(F.struct("at", "side")).alias("spots"))
    one = docs.join(spots.select(F.col("id").alias("i"), F.col("h").alias("g"), "spots"), F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")))
    found = one.select("id", "h", "text", "spots").mapInArrow(run, "id long, h long, at int, side int, words array<bigint>")
    return found.dropDuplicates(["id", "h", "at", "side"])  # rows alike were each answered


def repeats(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """One row per repeat: doc_id, h (text hash), start and n_words (in words), first_doc_id and first_start (where it occurred before)."""
    ship(docs.sparkSession)
    docs = _keyed(docs)
    every = stage(_chunk_lists(docs, o), "chunk-lists")
    # One row for all texts alike, in words too: the class is known by two hashes of its chunks and text.
    words = F.element_at("at", -1)
    kinds = [F.col("h"), F.xxhash64("digests", "at").alias("g")]
    rows = every.select("id", *kinds, words.alias("n"))
    firsts = stage(rows.groupBy("h", "g").agg(F.min(F.struct("id")).alias("f")).select(F.col("f.id").alias("fid"), "h", "g"), "chunk-firsts")
    copies = rows.filter(F.col("n") >= o.least).join(firsts, ["h", "g"]).filter(~F.col("id").eqNullSafe(F.col("fid")))
    copies = copies.select("id", "h", F.lit(0).alias("start"), F.col("n").alias("end"), F.col("fid").alias("first_doc_id"), F.lit(0).alias("first_start")).distinct()
    lists = every.select("id", *kinds, "digests", "at").join(firsts.select("fid", F.col("h").alias("fh"), F.col("g").alias("fg")), F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")))
    lists = stage(lists.select("id", "h", "digests", "at").dropDuplicates(["id", "h"]), "chunk-texts")

    several = lists.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("digest")
    several = stage(several, "chunk-several")  # a join splits a hot digest only where no aggregate stands between it and its shuffle
    places = lists.select("id", "h", F.posexplode("digests").alias("nth", "digest"))
    marked = places.join(several, "digest").groupBy("id", "h").agg(F.collect_list("nth").alias("marked"))
    marked = marked.select(F.col("id").alias("i"), F.col("h").alias("g"), "marked")
    whole = lists.join(marked, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g"))).drop("i", "g")
    sequences = stage(_sequences(whole, o), "chunk-sequences")

    order = F.struct("id", "h", "at")
    known = sequences.groupBy("digest").agg(F.min(order).alias("f"), F.max(order).alias("l")).filter("f != l")
    known = known.select("digest", F.col("f.id").alias("fid"), F.col("f.h").alias("fh"), F.col("f.at").alias("fat"))
    known = stage(known, "chunk-known")
    votes = sequences.join(known, "digest").filter(~(F.col("id").eqNullSafe(F.col("fid")) & (F.col("h") == F.col("fh")) & (F.col("at") == F.col("fat"))))
    runs = stage(_seeds(votes), "chunk-runs")
    discard(lists, several, sequences, known)

    sides = [("id", "h", "s", 0), ("id", "h", "e", 1), ("fid", "fh", "fs", 0), ("fid", "fh", "fe", 1)]
    asked = None
    for i, h, at, side in sides:
        own = runs.select(F.col(i).alias("id"), F.col(h).alias("h"), F.col(at).alias("at"), F.lit(side).alias("side"))
        asked = own if asked is None else asked.unionAll(own)
    beside = stage(_beside(docs, asked, o), "chunk-words")
    for k, (i, h, at, side) in enumerate(sides):
        words = beside.filter(F.col("side") == side).select(F.col("id").alias("i"), F.col("h").alias("g"), F.col("at").alias("a"), F.col("words").alias(f"w{k}"))
        runs = runs.join(words, F.col(i).eqNullSafe(F.col("i")) & (F.col(h) == F.col("g")) & (F.col(at) == F.col("a")), "left").drop("i", "g", "a")

    def common(a: str, b: str):
        """How many first members of two lists are equal."""
        same = F.zip_with(a, b, lambda x, y: x == y)
        stop = F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False)
        return F.coalesce(F.when(stop > 0, stop - 1).otherwise(F.size(same)), F.lit(0)).cast("int")

    grown = runs.select(
        "id", "h", (F.col("s") - common("w0", "w2")).alias("start"), (F.col("e") + common("w1", "w3")).alias("end"),
        F.col("fid").alias("first_doc_id"), (F.col("fs") - common("w0", "w2")).alias("first_start"),
    ).filter(F.col("end") - F.col("start") >= o.least).unionAll(copies)
    # Runs of one document that now overlap are one repeat.
    merged = grown.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("start", "end", "first_doc_id", "first_start"))).alias("r"))
    joined = F.aggregate(
        "r", F.expr("cast(array() as array<struct<start:int,end:int,first_doc_id:bigint,first_start:int>>)"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x["start"] < F.element_at(done, -1)["end"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end"),
                                 F.element_at(done, -1)["first_doc_id"].alias("first_doc_id"), F.element_at(done, -1)["first_start"].alias("first_start"))),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    spans = merged.withColumn("x", F.explode(joined))
    return spans.select(F.col("id").alias("doc_id"), "h", F.col("x.start").alias("start"), (F.col("x.end") - F.col("x.start")).alias("n_words"), "x.first_doc_id", "x.first_start")


def drop_repeats(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """``docs`` with every repeat cut out of its text, the first occurrence left; all columns and rows stay."""
    found = stage(repeats(docs, o), "repeats")
    spans = found.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "n_words")).alias("spans")).toDF("i", "g", "spans")
    marked = docs.select(whole_row(docs), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))
    joined = marked.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("h") == F.col("g")), "left")

    def cut(text: str | None, spans: list | None) -> str | None:
        if not spans or text is None:
            return text
        raw = text.encode()
        starts, ends = words_in(np.frombuffer(raw, np.uint8))
        out, at = [], 0
        for s in sorted(spans, key=lambda x: x["start"]):
            first, last = s["start"], s["start"] + s["n_words"]
            out.append(raw[at : starts[first]])
            at = starts[last] if last < len(starts) else len(raw)
        return b"".join([*out, raw[at:]]).decode()

    where = [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            made = [cut(t, s) if s else t for t, s in zip(columns[where].to_pylist(), batch.column("spans").to_pylist())]
            columns[where] = pa.array(made, pa.string())
            yield pa.record_batch(columns, names=[f.name for f in batch.schema.field("row").type])

    return joined.select("row", "spans").mapInArrow(run, docs.schema)
