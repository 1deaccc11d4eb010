"""SimHash near-duplicates found through Golay-code fuzzy hashing (operator 9).

A 64-bit fingerprint is cut into three segments of 21, 21 and 22 bits. Each
segment, padded to 23 bits, is decoded to the index (12 bits) of the nearest
word of the perfect [23,12,7] Golay code. Two segments that differ in one bit at most
need not decode alike, but the index of one is always among the indices to
which the other and its one-bit neighbours decode; there are about five of
those, so the list serves as fuzzy keys.

Pigeonhole for three errors at most: either each segment has just one, or some
segment has none and another has one at most. So a pair meets

* in one of six tables (exact segment, fuzzy segment): one side has the other
  segment's own index, the other side its list; or
* in a seventh table of all three segments: one side lists the first two, the other the third.

Candidates are verified by counting differing bits in the join itself, and only
links come out. Keys are made for distinct fingerprints, so thousands of copies count as
one. A key with very many fingerprints on either side is not joined row by row: its two sides are
cut into blocks, every pair of blocks is compared in one bounded task, and each gives
only a spanning forest of its links. No link is lost, since components need no more.
(How many a key lists is told from a sixteenth of the fingerprints, as it only chooses between two ways to the same links.)

Defined results: a null or empty text has no words and fingerprint zero, linked
like any other; null doc_ids take part but a component is named by its smallest
non-null id; repeated rows and ties fall together; a very long text is hashed in runs of 65,536 shingles; an
empty table gives no rows; other columns are ignored, or kept by ``drop_near_duplicates`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswise.llm.arrays import pieces_of, space_words, texts_of, whole_row
from crosswise.operators.components import connected_components
from crosswise.session import ship, stage

SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Tables 0 to 5: (exact segment, fuzzy segment); table 6 has all three.
ORDERED = [(z, o) for z in range(3) for o in range(3) if z != o]
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR = 0xAE3


@cache
def golay_decoder() -> np.ndarray:
    """The index of the nearest codeword for each of the 2^23 words."""
    words = np.zeros(4096, np.int64)
    message = np.arange(4096)
    for bit in range(12):
        words ^= np.where(message >> bit & 1, GENERATOR << bit, 0)
    flips = np.array([0, *(1 << np.arange(23))])
    errors = np.unique(flips[:, None, None] ^ flips[None, :, None] ^ flips[None, None, :])  # weight 3 at most
    index = np.zeros(1 << 23, np.uint16)
    for e in errors.tolist():
        index[words ^ e] = message
    return index


def _segment(fingerprints: np.ndarray, k: int) -> np.ndarray:
    low, width = SEGMENTS[k]
    return (fingerprints.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1)


def _own(fingerprints: np.ndarray, k: int) -> np.ndarray:
    return golay_decoder()[_segment(fingerprints, k)].astype(np.int64)


def _listed(fingerprints: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, index) for the distinct indices of the segment and its one-bit neighbours."""
    flips = np.array([0, *(1 << np.arange(SEGMENTS[k][1]))])
    found = np.sort(golay_decoder()[_segment(fingerprints, k)[:, None] ^ flips], axis=1).astype(np.int64)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return np.nonzero(new)[0], found[new]


def _key(table: int, exact: np.ndarray, fuzzy: np.ndarray) -> np.ndarray:
    return (np.int64(table) << 40) | (exact << 12) | fuzzy


def keys_of(fingerprints: np.ndarray, listing: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of one side: ``listing`` has the lists of the first six tables."""
    rows, keys = [], []
    every = np.arange(len(fingerprints))
    for t, (z, o) in enumerate(ORDERED):
        row, fuzzy = _listed(fingerprints, o) if listing else (every, _own(fingerprints, o))
        rows.append(row)
        keys.append(_key(t, _segment(fingerprints, z)[row], fuzzy))
    if listing:
        a_row, a = _listed(fingerprints, 0)
        b_row, b = _listed(fingerprints, 1)
        b_count = np.bincount(b_row, minlength=len(fingerprints))
        b_start = np.cumsum(b_count) - b_count
        n = b_count[a_row]
        nth = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(a_row, n)
        keys.append(_key(6, np.repeat(a, n) << 12 | b[b_start[row] + nth], _own(fingerprints, 2)[row]))
    else:
        row, fuzzy = _listed(fingerprints, 2)
        keys.append(_key(6, (_own(fingerprints, 0) << 12 | _own(fingerprints, 1))[row], fuzzy))
    rows.append(row)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprints_of(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text: a bit is set if over half of the shingles' XXH64 have it."""
    from xxhash import xxh64_intdigest

    words, counts = space_words(texts)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode() if len(words) else b""
    begin = np.cumsum(size + 1) - size - 1
    end = begin + size
    out = np.zeros(len(texts), np.uint64)
    first = 0
    for k, n in enumerate(counts.tolist()):
        if n:
            wide = min(shingle, n)
            starts, ends = begin[first : first + n - wide + 1].tolist(), end[first + wide - 1 : first + n].tolist()
            h = np.fromiter((xxh64_intdigest(body[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n - wide + 1)
            total = np.zeros(64, np.int64)
            for at in range(0, len(h), 1 << 16):
                total += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[k] = np.packbits(2 * total > len(h), bitorder="little").view(np.uint64)[0]
        first += n
    return out


def simhash(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, h, fp): the row's id, the hash of its text and its fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, most=4 << 20):
                fp = pa.array(fingerprints_of(texts_of(piece), shingle).view(np.int64))
                yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), piece.column("h"), fp], names=["doc_id", "h", "fp"])

    ship(docs.sparkSession)
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, fp long")


def _keyed(prints: DataFrame, listing: bool, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                some = fp[at : at + 4096]
                row, key = keys_of(some, listing)
                yield pa.record_batch([pa.array(key), pa.array(some[row])], names=["key", name])

    return prints.select("fp").mapInArrow(run, f"key long, {name} long")


def _forest(errors: int):
    """Compare one block of a key's fingerprints with another; give a spanning forest of the links."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (t.column(n).to_numpy() for t, n in ((left, "a"), (right, "b")))
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        u, v = [], []
        for at in range(0, len(a), 256):
            i, j = np.nonzero(np.bitwise_count((a[at : at + 256, None] ^ b[None, :]).view(np.uint64)) <= errors)
            for x, y in zip(a[at + i].tolist(), b[j].tolist()):
                x_root, y_root = find(x), find(y)
                if x_root != y_root:
                    root[x_root] = y_root
                    u.append(x)
                    v.append(y)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def links(prints: DataFrame, errors: int = 3, hot: int = 512, block: int = 2048) -> DataFrame:
    """``prints(fp)``, distinct, -> links (u, v) whose components are those of all pairs that differ in ``errors`` bits at most.

    Keys of up to ``hot`` fingerprints on the side of single keys, and about sixteen times as many on the listing side,
    give all their links, larger ones a forest for each pair of blocks.
    """
    if errors > 3:
        raise ValueError("the tables hold for three errors at most")
    ship(prints.sparkSession)
    single, listed = _keyed(prints, False, "b"), _keyed(prints, True, "a")
    some = _keyed(prints.filter(F.pmod(F.xxhash64("fp"), F.lit(16)) == 0), True, "a")
    ones = single.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("m"))
    many = some.groupBy("key").agg(F.lit(0).cast("long").alias("n"), (F.count(F.lit(1)) * 16).alias("m"))
    crowded = ones.filter(F.col("n") > hot).unionAll(many.filter(F.col("m") > 16 * hot)).groupBy("key").agg(F.max("n").alias("n"), F.max("m").alias("m"))
    crowded = stage(crowded, "hot-keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= errors
    if not crowded.head(1):
        return listed.join(single, "key").filter((F.col("a") < F.col("b")) & near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    plain = listed.join(crowded, "key", "left_anti").join(single.join(crowded, "key", "left_anti"), "key")
    found = plain.filter((F.col("a") < F.col("b")) & near).select(F.col("a").alias("u"), F.col("b").alias("v"))
    # A key's listing side has about six times its single side, and what the sample told.
    blocks = lambda c: F.greatest(F.ceil(c / block), F.lit(1)).cast("int")
    sized = crowded.select("key", blocks(F.greatest("m", F.col("n") * 6)).alias("lefts"), blocks(F.col("n")).alias("rights"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = listed.join(sized, "key").select("key", own("a", "lefts").alias("i"), every("rights").alias("j"), "a")
    rights = single.join(sized, "key").select("key", every("lefts").alias("i"), own("b", "rights").alias("j"), "b")
    keys = ("key", "i", "j")
    forests = lefts.groupBy(*keys).cogroup(rights.groupBy(*keys)).applyInArrow(_forest(errors), "u long, v long")
    return found.unionAll(forests)


def fingerprint_groups(docs: DataFrame, errors: int, shingle: int) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, h, fp), and for each fingerprint its component's root."""
    rows = stage(simhash(docs, shingle), "simhash")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    prints = stage(prints, "prints")
    roots = connected_components(links(prints, errors))
    whole = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    return rows, stage(whole, "roots")


def near_duplicates(docs: DataFrame, errors: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) of every row."""
    rows, whole = fingerprint_groups(docs, errors, shingle)
    named = whole.join(whole.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("fp", "component_id")
    return rows.select("doc_id", "fp").join(named, "fp")


def drop_near_duplicates(docs: DataFrame, errors: int = 3, shingle: int = 3) -> DataFrame:
    """One document of each component, the one of smallest (doc_id, text hash), null ids last; all columns stay.

    Rows alike in doc_id and text are one document.
    """
    rows, whole = fingerprint_groups(docs, errors, shingle)
    return keep_first(docs, rows, whole, "fp")


def keep_first(docs: DataFrame, rows: DataFrame, whole: DataFrame, node: str) -> DataFrame:
    """The rows of ``docs`` that are first of their component: ``rows`` has each one's doc_id, text hash and node, ``whole`` each node's root."""
    order = (F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("h"))
    first = rows.groupBy(node).agg(F.min(F.struct(*order)).alias("o"))
    kept = first.join(whole, node).groupBy("root").agg(F.min("o").alias("o"))
    names = ["none", "id", "h"]
    kept = stage(kept.select("o.*").toDF(*names), "kept")
    mine = docs.select(whole_row(docs), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"))
    out = mine.join(kept, names, "left_semi")
    repeated = rows.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)
    if repeated:
        nth = F.row_number().over(Window.partitionBy(*names).orderBy(F.lit(0)))
        out = out.withColumn("nth", nth).filter("nth = 1")
    return out.select("row.*")
