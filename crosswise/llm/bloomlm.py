"""Language-model scoring from a log-frequency Bloom filter (operator 5).

Counts of n-grams are quantised by logarithm: an n-gram of count c has level
1 + floor(log_base(c)), and the pairs (n-gram, 1), ..., (n-gram, level) are in a Bloom
filter. A count is read back by probing level 1, 2, ... until one is missing;
a false positive can only raise it, by one level with the filter's error rate.

Gathering. Each task hashes its tokens' n-grams to 64 bits and counts them; the
counts go, sorted and packed, to buckets by hash range. A bucket's task merges
them, writes its segment of the filter (sized for its own n-grams) and the exact
unigram counts that fall in it. Bucket numbers grow with the corpus, so a
bucket's size does not, and a frequent n-gram reaches its bucket once per batch, already counted.

Scoring. A filter of ``broadcast_bytes`` at most (made from ``broadcast_text`` bytes of text at most) is broadcast once and every
task probes it. Beyond that nothing is broadcast: batches of documents are packed and kept once; each sends its
distinct words and pairs with their training counts to the buckets; a bucket's task builds its segment,
answers every batch by probing it, and the answers go back to the batch. Keys are shuffled once,
already counted, and a batch asks for a frequent pair once. Both ways give the same scores.

The model: P(w | h) = m * f(h, w) / c(h) + (1 - m) * base(w), where f is the count
read back (no pair can be more frequent than its words, so f is cut at their counts),
m = share * c(h) / (c(h) + 1), and base(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)) with exact
unigram counts c. After an unknown word, and at a text's start, base alone. As in any Bloom filter
model, false positives (0.4 % of unseen pairs of known words) make the sum over all w exceed 1 a little.

Tokens are words between ASCII white space, A-Z lower-cased, then one end. The
same 64-bit hash stands for a word throughout (128-bit digests of it were not needed: two of
10^7 words collide with probability 3e-6).

Defined results: a null or empty text is its end alone; a null doc_id is never
held out and its row trains; repeated rows count and are scored each; a very long text is a batch of its own; with no
training rows all counts are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.llm.arrays import pieces_of, space_words, texts_of, trim
from crosswise.session import ship, stage

END = np.uint64(0x9D5C1F0A3B7E2468)
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def hashed_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's tokens as hashes, the end at last, and its number of tokens."""
    from xxhash import xxh3_64_intdigest

    words, counts = space_words(texts)
    coded = words.dictionary_encode()
    unique = np.fromiter(map(xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    flat = unique[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    return np.insert(flat, np.cumsum(counts), END), counts + 1


def pairs_of(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token with the one before it, and which tokens have one before them."""
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(counts) - counts] = False
    key = np.zeros(len(tokens), np.uint64)
    key[1:] = mixed(tokens[:-1] * np.uint64(3) + mixed(tokens[1:]))
    return key, inner


def levels_of(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(base) + 1e-9).astype(np.int64)


def counts_of(levels: np.ndarray, base: float) -> np.ndarray:
    """The middle of a level's counts; 0 for none."""
    low = np.ceil(base ** (levels - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(base**levels - 1e-9) - 1)
    return np.where(levels > 0, np.sqrt(low * high), 0.0)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of the key, so sorted keys are sorted by bucket too."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class Segment:
    """A Bloom filter over (key, level) pairs, of a power of two of bits."""

    @staticmethod
    def build(keys: np.ndarray, levels: np.ndarray, bits_a_pair: float, probes: int) -> np.ndarray:
        """64-bit words of the filter; its size follows the number of pairs."""
        pairs = int(levels.sum())
        words = max(1, int(np.ceil(pairs * bits_a_pair / 64)))
        out = np.zeros(words, np.uint64)
        for level in range(1, int(levels.max(initial=0)) + 1):
            own = keys[levels >= level]
            for word, bit in Segment.places(own, level, probes, np.uint64(words)):
                np.bitwise_or.at(out, word, bit)
        return out

    @staticmethod
    def places(keys: np.ndarray, level: int, probes: int, words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word and bit of each probe, by double hashing."""
        h = mixed(keys + np.uint64(level * int(MIX) % (1 << 64)))
        step = mixed(h) | np.uint64(1)
        for k in range(probes):
            x = mixed(h + np.uint64(k) * step)
            yield ((x >> np.uint64(32)) * words >> np.uint64(32)).astype(np.int64), np.uint64(1) << (x & np.uint64(63))


@dataclass(frozen=True)
class Options:
    base: float = 2.0
    bits_a_pair: float = 12.0
    probes: int = 6
    share: float = 0.15
    bucket_tokens: int = 2_000_000
    batch_tokens: int = 1_500_000
    broadcast_bytes: int = 16 << 20
    broadcast_text: int = 64 << 20


def _train_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True)))


def _counted(tokens: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words and distinct pairs of some texts, sorted, and how often they occur in texts of weight 1."""
    pair, inner = pairs_of(tokens, counts)
    if weight is None:
        return [np.unique(x, return_counts=True) for x in (tokens, pair[inner])]
    each, out = np.repeat(weight, counts), []
    for x, w in ((tokens, each), (pair[inner], each[inner])):
        key, at = np.unique(x, return_inverse=True)
        out.append((key, np.bincount(at, w, len(key)).astype(np.int64)))
    return out


def _by_bucket(counted: list, buckets: int) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, kind, number of keys, packed keys and counts) for sorted keys of kind 0, words, and 1, pairs."""
    for kind, (key, total) in enumerate(counted):
        cut = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            some = slice(cut[b], cut[b + 1])
            yield b, kind, int(cut[b + 1] - cut[b]), _press(np.diff(key[some], prepend=np.uint64(0)), total[some].astype(np.uint32))


def _keys_in(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    gaps, counts = _unpress(body, (8, 4), n)
    return np.cumsum(gaps, dtype=np.uint64), counts


def _segment(parts: Iterator[tuple[int, np.ndarray, np.ndarray]], o: Options) -> dict:
    """A bucket's segment, exact word counts and totals, from (kind, keys, counts) of all batches."""
    held = {0: [(np.zeros(0, np.uint64), np.zeros(0))], 1: [(np.zeros(0, np.uint64), np.zeros(0))]}
    for kind, keys, counts in parts:
        held[kind].append((keys, counts.astype(np.float64)))
    found = []
    for kind in (0, 1):
        key, at = np.unique(np.concatenate([k for k, _ in held[kind]]), return_inverse=True)
        total = np.bincount(at, np.concatenate([c for _, c in held[kind]]), len(key)).astype(np.int64)
        found.append((key[total > 0], total[total > 0]))  # a key of held-out texts alone is only asked for
    (one, n_one), (two, n_two) = found
    bits = Segment.build(two, levels_of(n_two, o.base), o.bits_a_pair, o.probes)
    return {"distinct": len(one), "tokens": int(n_one.sum()), "bits": bits.tobytes(), "words": one.tobytes(), "counts": n_one.astype("<i8").tobytes()}


def _bucket_number(docs: DataFrame, o: Options) -> tuple[int, int]:
    """Bytes of text, and the number of buckets."""
    size = int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return size, max(1, -(-size // 6 // o.bucket_tokens))


def gather(docs: DataFrame, buckets: int, o: Options) -> DataFrame:
    """Per bucket: the filter's segment, exact unigram hashes (sorted) and counts, and totals."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> Iterator[pa.RecordBatch]:
            tokens, counts = (np.concatenate(x) for x in zip(*held))
            rows = list(_by_bucket(_counted(tokens, counts), buckets))
            for at in range(0, len(rows), 256):
                yield pa.record_batch([pa.array(x) for x in zip(*rows[at : at + 256])], names=["bucket", "kind", "n", "body"])

        held, waiting = [], 0
        for batch in batches:
            for piece in pieces_of(batch):
                held.append(hashed_tokens(texts_of(piece)))
                waiting += len(held[-1][0])
                if waiting > o.batch_tokens:
                    yield from out(held)
                    held, waiting = [], 0
        if held:
            yield from out(held)

    def merged(table: pa.Table) -> pa.Table:
        rows = zip(*(table.column(c).to_pylist() for c in ("kind", "n", "body")))
        made = {"bucket": int(table.column("bucket")[0].as_py())} | _segment(((kind, *_keys_in(n, body)) for kind, n, body in rows), o)
        return pa.table({k: [v] for k, v in made.items()})

    ship(docs.sparkSession)
    parts = _train_rows(docs).select("text").mapInArrow(packed, "bucket long, kind long, n long, body binary")
    return stage(parts.groupBy("bucket").applyInArrow(merged, "bucket long, distinct long, tokens long, bits binary, words binary, counts binary"), "lm-buckets")


def _press(*columns: np.ndarray) -> bytes:
    """Columns of numbers as byte planes, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() for x in columns]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpress(raw: bytes, widths: tuple[int, ...], n: int) -> list[np.ndarray]:
    """The columns, as unsigned numbers of these widths."""
    import zstandard

    body, out, at = zstandard.ZstdDecompressor().decompress(raw), [], 0
    for w in widths:
        out.append(np.ascontiguousarray(np.frombuffer(body, np.uint8, n * w, at).reshape(w, n).T).view(f"<u{w}").reshape(-1))
        at += n * w
    return out


class Block:
    """The filter's segments and the unigram counts of consecutive buckets from ``low`` on; a bucket may have none."""

    def __init__(self, low: int, rows: list[tuple[bytes, bytes, bytes] | None], buckets: int):
        self.low, self.buckets = low, buckets
        part = lambda k, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[k], kind) for r in rows if r)])
        self.bits, self.words, self.counts = part(0, np.uint64), part(1, np.uint64), part(2, "<i8")
        self.size = np.array([len(r[0]) // 8 if r else 0 for r in rows], np.uint64)
        self.start = np.cumsum(self.size).astype(np.int64) - self.size.astype(np.int64)

    def count(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of this block's words, 0 for others."""
        if not len(self.words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], 0).astype(np.int64)

    def level(self, keys: np.ndarray, probes: int) -> np.ndarray:
        """The level of each key by probing 1, 2, ... until one is missing; 0 for other blocks' keys."""
        out = np.zeros(len(keys), np.int64)
        bucket = bucket_of(keys, self.buckets) - self.low
        live = np.flatnonzero((bucket >= 0) & (bucket < len(self.size)))
        live = live[self.size[bucket[live]] > 0]
        level = 0
        while len(live):
            level += 1
            b = bucket[live]
            there = np.ones(len(live), bool)
            for word, bit in Segment.places(keys[live], level, probes, self.size[b]):
                there &= self.bits[self.start[b] + word] & bit != 0
            live = live[there]
            out[live] = level
        return out


@dataclass(frozen=True)
class Totals:
    tokens: int
    distinct: int

    @property
    def floor(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scored_rows(names: pa.Array, sizes: np.ndarray, counts: np.ndarray, levels: np.ndarray, totals: Totals, o: Options) -> pa.RecordBatch:
    """From each token's count and its pair's level, text after text."""
    start = np.cumsum(sizes) - sizes
    base = (counts + 0.5) / totals.floor
    context = np.zeros(len(counts), np.int64)
    context[1:] = counts[:-1]
    context[start] = 0
    seen = np.minimum(counts_of(levels, o.base), np.minimum(counts, context))
    mass = o.share * context / (context + 1)
    likely = mass * seen / np.maximum(context, 1) + (1 - mass) * base
    made = [np.add.reduceat(x, start) for x in ((counts > 0).astype(np.int64), np.log10(base), np.log10(likely))]
    return pa.record_batch([names, *(pa.array(x) for x in (sizes, *made))], names=[x.split()[0] for x in SCORED.split(", ")])


def _broadcast_scores(rows: DataFrame, block: Block, totals: Totals, o: Options) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch, most=4 << 20):
                tokens, sizes = hashed_tokens(texts_of(piece))
                pair, inner = pairs_of(tokens, sizes)
                levels = np.zeros(len(tokens), np.int64)
                levels[inner] = shared.value.level(pair[inner], o.probes)
                yield scored_rows(piece.column("doc_id"), sizes, shared.value.count(tokens), levels, totals, o)

    return rows.mapInArrow(run, SCORED)


def _packed_batches(rows: DataFrame, o: Options) -> DataFrame:
    """(batch, ids, texts): documents by the batch, packed, in one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)

        def out(held: list, batch: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table)
            return pa.record_batch([pa.array([batch]), pa.array([press.compress(sink.getvalue())], pa.binary())], names=["batch", "body"])

        held, waiting, batch = [], 0, TaskContext.get().partitionId() << 32
        for rows_ in batches:
            for piece in pieces_of(rows_, most=1 << 20):
                held.append(piece)
                waiting += piece.nbytes
                if waiting > 6 * o.batch_tokens:
                    yield out(held, batch)
                    held, waiting, batch = [], 0, batch + 1
        if held:
            yield out(held, batch)

    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1, F.lit(True))
    return rows.select("doc_id", "text", trains.alias("trains")).mapInArrow(run, "batch long, body binary")


def _unpacked(body: bytes) -> pa.RecordBatch:
    import zstandard

    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompressobj().decompress(body)) as reader:
        return reader.read_all().combine_chunks().to_batches()[0]


def _partitioned_scores(rows: DataFrame, buckets: int, o: Options) -> tuple[DataFrame, Totals]:
    packed = stage(_packed_batches(rows, o), "lm-batches")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, body in zip(*(batch.column(c).to_pylist() for c in ("batch", "body"))):
                own = _unpacked(body)
                tokens, sizes = hashed_tokens(texts_of(own))
                weight = own.column("trains").to_numpy(zero_copy_only=False).astype(np.float64)
                made = [(number, *row) for row in _by_bucket(_counted(tokens, sizes, weight), buckets)]
                del own, tokens
                trim()
                for at in range(0, len(made), 256):
                    yield pa.record_batch([pa.array(x) for x in zip(*made[at : at + 256])], names=["batch", "bucket", "kind", "n", "body"])

    def answer(table: pa.Table) -> pa.Table:
        of = int(table.column("bucket")[0].as_py())
        columns = {c: table.column(c).to_pylist() for c in ("batch", "kind", "n", "body")}
        parts = lambda: ((kind, *_keys_in(n, body)) for kind, n, body in zip(*(columns[c] for c in ("kind", "n", "body"))))
        own = _segment(parts(), o)
        block = Block(of, [(own["bits"], own["words"], own["counts"])], buckets)
        del own
        made = [_press(block.level(keys, o.probes).astype(np.uint8) if kind else block.count(keys)) for kind, keys, _ in parts()]
        tokens, distinct = int(block.counts.sum()), len(block.words)
        del block
        trim()
        return pa.table(
            [pa.array(x, t) for x, t in (
                ([*columns["batch"], None], pa.int64()), ([of] * (len(made) + 1), pa.int64()), ([*columns["kind"], 2], pa.int64()), ([*columns["n"], 0], pa.int64()),
                ([*made, None], pa.binary()), ([None] * len(made) + [tokens], pa.int64()), ([None] * len(made) + [distinct], pa.int64()),
            )],
            names=["batch", "bucket", "kind", "n", "body", "tokens", "distinct"],
        )

    keys = "batch long, bucket long, kind long, n long, body binary"
    answers = stage(packed.mapInArrow(ask, keys).groupBy("bucket").applyInArrow(answer, keys + ", tokens long, distinct long"), "lm-answers")
    sums = answers.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v")).first()
    totals = Totals(int(sums.n or 0), int(sums.v or 0))

    def judge(documents: pa.Table, told: pa.Table) -> pa.Table:
        made = []
        for body in documents.column("body").to_pylist():
            own = _unpacked(body)
            tokens, sizes = hashed_tokens(texts_of(own))
            pair, inner = pairs_of(tokens, sizes)
            found = sorted(zip(*(told.column(c).to_pylist() for c in ("kind", "bucket", "n", "body"))), key=lambda x: x[:2])
            count, level = (np.concatenate([np.zeros(0, np.int64), *(_unpress(raw, (w,), n)[0].astype(np.int64) for k, _, n, raw in found if k == kind)]) for kind, w in ((0, 8), (1, 1)))
            levels = np.zeros(len(tokens), np.int64)
            levels[inner] = level[np.unique(pair[inner], return_inverse=True)[1]]
            made.append(scored_rows(own.column("doc_id"), sizes, count[np.unique(tokens, return_inverse=True)[1]], levels, totals, o))
        trim()
        if not made:
            return pa.table({name: pa.array([], pa.float64() if "score" in name else pa.int64()) for name in (x.split()[0] for x in SCORED.split(", "))})
        return pa.Table.from_batches(made)

    replies = answers.filter("kind < 2").select("batch", "bucket", "kind", "n", "body")
    return packed.groupBy("batch").cogroup(replies.groupBy("batch")).applyInArrow(judge, SCORED), totals


def bloom_scores(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ship(docs.sparkSession)
    size, buckets = _bucket_number(rows, o)
    scored = None
    if size <= o.broadcast_text:
        gathered = gather(rows, buckets, o)
        whole = F.sum(F.length("bits") + F.length("words") + F.length("counts"))
        sums = gathered.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), whole.alias("size")).first()
        if (sums.size or 0) <= o.broadcast_bytes:
            totals = Totals(int(sums.n or 0), int(sums.v or 0))
            found = {r.bucket: (r.bits, r.words, r.counts) for r in gathered.select("bucket", "bits", "words", "counts").collect()}
            scored = _broadcast_scores(rows, Block(0, [found.get(k) for k in range(buckets)], buckets), totals, o)
    if scored is None:
        scored, totals = _partitioned_scores(rows, buckets, o)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
