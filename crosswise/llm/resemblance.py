"""Near-duplicates by the Jaccard similarity of word shingles, as the pipeline's stage takes them.

Two texts are alike if their sets of five-word shingles (of lower-cased words)
have a Jaccard similarity of ``least`` or more; documents that such links join are one group.

Candidates come from operator 9 first: five-word SimHash fingerprints grouped through Golay keys, each text of a group being
checked against the group's first. But a pair at 0.8 differs in about ten bits of 64, and Golay keys for so
many errors would list most of the code, so three errors alone leave six of seven such pairs apart. Therefore texts
that share one of 24 bands of five MinHash values are candidates too. A pair at 0.8 misses
all bands with a chance of 7 in 100,000, closer pairs with less; no other cut is made. Every
candidate link is then checked on the sets themselves before grouping.

A key of up to ``hot`` texts gives all its pairs. In a larger one each text is first
checked against the key's smallest, which settles a large group of copies in linear work; keys
that still hold several groups are cut into blocks, and every pair of blocks is compared in one bounded task.

Defined results: a text of fewer than five words is one shingle; null texts and texts
without words are alike; null doc_ids come last; rows alike in doc_id and text are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.llm.arrays import pieces_of, space_words, texts_of
from crosswise.llm.fuzzy import fingerprint_groups, keep_first
from crosswise.operators.components import connected_components
from crosswise.session import discard, ship, stage

BANDS, WIDTH = 24, 5
FACTORS = np.random.default_rng(20240509).integers(1, 1 << 63, BANDS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(texts: pa.Array, shingle: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the texts' shingles, text after text, and how many each text has."""
    from xxhash import xxh3_64_intdigest

    words, counts = space_words(texts)
    size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    body = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py().encode() if len(words) else b""
    begin = np.cumsum(size + 1) - size - 1
    n = np.where(counts > 0, np.maximum(counts - shingle + 1, 1), 0)
    first = np.repeat(np.cumsum(counts) - counts, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.repeat(np.minimum(counts, shingle), n) - 1
    at = zip(begin[first].tolist(), (begin[last] + size[last]).tolist())
    return np.fromiter((xxh3_64_intdigest(body[a:b]) for a, b in at), np.uint64, len(first)), n


def band_keys(texts: pa.Array, shingle: int = 5) -> np.ndarray:
    """One key for each text and band, made of the band's MinHash values."""
    hashes, n = shingles_of(texts, shingle)
    filled = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[filled]
    out = np.zeros((len(n), BANDS), np.uint64)
    for k, factor in enumerate(FACTORS):
        lowest = np.full(len(n), np.iinfo(np.uint64).max)
        if len(filled):
            # the upper half is folded down, else equal low bits would keep their order under every factor
            mixed = hashes * factor
            lowest[filled] = np.minimum.reduceat(mixed ^ (mixed >> np.uint64(31)), starts)
        out[:, k // WIDTH] = (out[:, k // WIDTH] ^ lowest) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
    return out.view(np.int64)


def jaccard(a: bytes, b: bytes) -> float:
    """Similarity of two sets given as sorted 64-bit hashes."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) and not len(y):
        return 1.0
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _alike(a: bytes, b: bytes, least: float) -> bool:
    small, large = sorted((len(a), len(b)))
    return small >= least * large and jaccard(a, b) >= least


def _banded(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, most=2 << 20):
                keys = band_keys(texts_of(piece), shingle)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
                yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), piece.column("h"), lists], names=["doc_id", "h", "keys"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, "doc_id long, h long, keys array<bigint>")


def _sets(docs: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(h, shingles) of the asked texts: each one's distinct hashes, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, most=2 << 20):
                hashes, n = shingles_of(texts_of(piece), shingle)
                at = np.concatenate(([0], np.cumsum(n)))
                made = [np.unique(hashes[a:b]).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.record_batch([piece.column("h"), pa.array(made, pa.binary())], names=["h", "shingles"])

    asked = asked.toDF("g", "i")
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(asked, (F.col("h") == F.col("g")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    return texts.select("h", "text").mapInArrow(run, "h long, shingles binary").dropDuplicates(["h"])


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            yield batch.select(["u", "v"]).filter(pa.array([_alike(x.as_py(), y.as_py(), least) for x, y in zip(a, b)], pa.bool_()))

    left, right = sets.toDF("u", "a"), sets.toDF("v", "b")
    return pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def _block_links(least: float):
    """Links between two blocks of a key, as few as join the groups: pairs of one group are not compared."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        root = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        (ha, ra, sa), (hb, rb, sb) = ([t.column(c).to_pylist() for c in t.column_names[3:]] for t in (left, right))
        u, v = [], []
        for x, x_root, x_set in zip(ha, ra, sa):
            for y, y_root, y_set in zip(hb, rb, sb):
                if find(x_root) != find(y_root) and _alike(x_set, y_set, least):
                    root[find(x_root)] = find(y_root)
                    u.append(x)
                    v.append(y)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _fuzzy_pairs(docs: DataFrame, shingle: int) -> DataFrame:
    """Each text with the first text of its group by operator 9."""
    rows, whole = fingerprint_groups(docs, 3, shingle)
    texts = stage(rows.join(whole.select("fp", "root"), "fp").groupBy("h").agg(F.min("root").alias("root")), "fuzzy-texts")
    first = texts.groupBy("root").agg(F.min("h").alias("low"))
    return texts.join(first, "root").filter("low < h").select(F.col("low").alias("u"), F.col("h").alias("v"))


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    roots = connected_components(links)
    return nodes.join(roots, nodes.h == roots.node, "left").select("h", F.coalesce("root", "h").alias("root"))


def groups(docs: DataFrame, least: float = 0.8, shingle: int = 5, hot: int = 32, block: int = 128) -> tuple[DataFrame, DataFrame]:
    """The rows' (doc_id, h), and for each text hash h its group's root."""
    ship(docs.sparkSession)
    rows = stage(_banded(docs, shingle), "bands")
    texts = stage(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "band-texts")
    keyed = texts.select("h", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("key"), "h")
    keyed = stage(keyed, "band-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("low")).filter("n > 1")
    shared = stage(keyed.join(sizes, "key"), "band-shared")
    some, many = shared.filter(F.col("n") <= hot), shared.filter(F.col("n") > hot)
    pairs = some.select("key", F.col("h").alias("u")).join(some.select("key", F.col("h").alias("v")), "key").filter("u < v").select("u", "v")
    stars = many.filter("low < h").select(F.col("low").alias("u"), F.col("h").alias("v"))
    found = pairs.unionAll(stars).unionAll(_fuzzy_pairs(docs, shingle))
    pairs = stage(found.distinct(), "resembling")
    nodes = stage(shared.select("h").unionAll(pairs.select("u")).unionAll(pairs.select("v")).distinct(), "resembling-texts")
    asked = texts.join(nodes, "h", "left_semi").select("h", "doc_id")
    sets = stage(_sets(docs, asked, shingle), "shingle-sets")
    links = stage(_checked(pairs, sets, least), "resembling-links")
    done = [texts, keyed, shared, pairs, nodes, sets]
    if many.head(1):
        now = stage(_rooted(nodes, links), "resembling-roots")
        held = many.join(now, "h")
        open_ = held.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("key")
        held = stage(held.join(open_, "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "resembling-open")
        if held.head(1):
            own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            full = held.join(sets, "h")
            lefts = full.select("key", own.alias("i"), other.alias("j"), "h", "root", "shingles").filter("i <= j")
            rights = full.select("key", other.alias("i"), own.alias("j"), "h", "root", "shingles").filter("i <= j")
            lefts, rights = (t.toDF(*(f"{side}_{c}" for c in t.columns)) for t, side in ((lefts, "l"), (rights, "r")))
            more = lefts.groupBy("l_key", "l_i", "l_j").cogroup(rights.groupBy("r_key", "r_i", "r_j")).applyInArrow(_block_links(least), "u long, v long")
            links = links.unionAll(stage(more, "resembling-blocks"))
    whole = stage(_rooted(texts.select("h"), links), "resembling-groups")
    discard(*done)
    return rows.select("doc_id", "h"), whole


def drop_resembling(docs: DataFrame, least: float = 0.8, shingle: int = 5, hot: int = 32, block: int = 128) -> DataFrame:
    """One document of each group, the one of smallest (doc_id, text hash), null ids last; all columns stay."""
    rows, whole = groups(docs, least, shingle, hot, block)
    return keep_first(docs, rows, whole, "h")
