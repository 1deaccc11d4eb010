"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 8).

Every word is the bag of its hashed character n-grams (with word ends marked)
and itself; its vector is the mean of theirs. A bag of words is averaged and
goes into a two-class softmax. Embeddings and softmax are trained jointly, in
numpy, so an unseen spelling gets the vectors of the n-grams it shares. Only
n-grams whose document counts differ between the classes get a vector; the rest would
let a small sample be learned by heart. The likelihood ratio asked for follows from the sample:
an n-gram in ``few`` texts of the rarer class and in none of the other has it, however few or many labels there are.

A few words decide, and in a long text they would drown in one average. So a
text is a row of windows of ``window`` words, each averaged into the same
softmax, and the text is as toxic as its worst window; training starts on all windows
of a text together and goes on with its worst one.

The model is fitted on a bounded sample: the ``most_rows`` labelled rows whose
hashed doc_id is smallest, of both classes as they come, whole texts of ``most_bytes`` together; a text that
does not fit in what the rows before it left of that is passed over. They alone reach the driver. The model has a bounded size (at most 2^buckets_log2
floats) and is broadcast in the closure; scoring is one pass without a shuffle.

Defined results: a null or empty text, and one without any n-gram that has a vector, gets the score of an
empty average (the bias alone, held below 0.5); without labelled rows of both
classes every score is the share of the class that is there (0 without any); labels that are null
are no labels, and of several labels of one doc_id the largest counts; repeated doc_ids are scored each; a very
long text is cut into windows like any other; other columns are ignored, or
kept by ``drop_toxic`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.llm.arrays import filtered, pieces_of, ragged, space_words, texts_of
from crosswise.session import ship


@dataclass(frozen=True)
class Settings:
    shortest: int = 3
    longest: int = 5
    buckets_log2: int = 20
    dim: int = 4
    few: int = 3
    window: int = 24
    warm_steps: int = 40
    steps: int = 150
    rate: float = 0.3
    seed: int = 11


@dataclass(frozen=True)
class Model:
    """The trained softmax over averages, folded: the log odds that each n-gram's bucket adds, and the bias."""

    buckets: np.ndarray
    odds: np.ndarray
    bias: float


def subwords(words: pa.Array, s: Settings, step: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of each word's n-grams and itself, word after word, and how many each word has.

    Words are taken ``step`` at a time, which bounds the memory in between.
    """
    parts = [_subwords(words.slice(k, step), s) for k in range(0, len(words), step)]
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _subwords(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    n = len(words)
    marked = ["<%s>" % w for w in words.to_pylist()]
    points = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, n)
    end = np.cumsum(size)
    room = np.repeat(end, size) - np.arange(len(points))  # code points from here to the word's end
    word = np.repeat(np.arange(n, dtype=np.int32), size)
    prime, shift = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - s.buckets_log2)
    rolled = np.zeros(len(points), np.uint64)
    ids, owner = [], []
    for k in range(s.longest):
        ahead = np.zeros_like(points)
        ahead[: max(0, len(points) - k)] = points[k:]
        rolled = (rolled ^ ahead) * prime + np.uint64(k)
        if k + 1 >= s.shortest:
            fits = room > k
            ids.append(((rolled[fits] ^ (rolled[fits] >> np.uint64(29))) * prime >> shift).astype(np.int32))
            owner.append(word[fits])
    power = np.cumprod(np.concatenate(([1], np.full(int(size.max()), 0x100000001B3, np.uint64))), dtype=np.uint64)
    whole = np.add.reduceat(points * power[room], end - size)
    ids.append((whole * prime >> shift).astype(np.int32))
    owner.append(np.arange(n, dtype=np.int32))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=n)


def windows_of(counts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut texts of so many words into windows of even size, ``window`` words at most: each window's size, and its text."""
    windows = -(-counts // window)
    text = np.repeat(np.arange(len(counts)), windows)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows)
    return (nth + 1) * counts[text] // windows[text] - nth * counts[text] // windows[text], text


def telling(word: np.ndarray, counts: np.ndarray, labels: np.ndarray, gram: np.ndarray, grams: np.ndarray, s: Settings) -> np.ndarray:
    """Which buckets occur in unequal shares of the two classes' texts, by the likelihood ratio of their counts.

    The ratio asked for is the one that ``few`` texts of the rarer class and none of the other give in this sample.
    """
    start = np.cumsum(grams) - grams
    seen = np.zeros((2, 1 << s.buckets_log2), np.int32)
    at = np.concatenate(([0], np.cumsum(counts)))
    for k in range(len(counts)):
        own = np.unique(word[at[k] : at[k + 1]])
        seen[labels[k], np.unique(gram[ragged(start[own], grams[own])])] += 1
    n = np.bincount(labels, minlength=2).astype(float)[:, None]
    some = np.flatnonzero(seen.any(axis=0))
    seen = seen[:, some].astype(float)
    total = seen.sum(axis=0)
    ratio = np.zeros(len(some))
    for table, share in ((seen, total), (n - seen, n.sum() - total)):
        expected = n * share / n.sum()
        ratio += 2 * np.where(table > 0, table * np.log(np.maximum(table, 1) / np.maximum(expected, 1e-12)), 0).sum(axis=0)
    out = np.zeros(1 << s.buckets_log2, bool)
    asked = 2 * max(1, min(s.few, n.min())) * np.log(n.sum() / max(1, n.min()))
    out[some[ratio >= asked - 1e-9]] = True
    return out


class Adam:
    def __init__(self, values: list[np.ndarray], rate: float):
        self.values, self.rate, self.t = values, rate, 0
        self.m = [np.zeros_like(v) for v in values]
        self.v = [np.zeros_like(v) for v in values]

    def step(self, grads: list[np.ndarray]) -> None:
        self.t += 1
        for x, m, v, g in zip(self.values, self.m, self.v, grads):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def _softmax(hidden: np.ndarray, out: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logits = hidden @ out + bias
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _sum_by(key: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(key, rows[:, d], n) for d in range(rows.shape[1])], axis=1)


def _worst(odds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The window of largest odds (the last of equals) of each text, whose windows begin at ``first``."""
    most = np.repeat(np.maximum.reduceat(odds, first), np.diff(np.append(first, len(odds))))
    return np.maximum.reduceat(np.where(odds == most, np.arange(len(odds)), -1), first)


def fit(texts: list[str | None], labels: np.ndarray, s: Settings) -> Model:
    """Train embeddings and softmax jointly.

    The softmax is linear, so the log odds of an average are the average of the
    n-grams' own; the product of embeddings and softmax weights is all that scoring needs.
    """
    toxic = float(np.mean(labels)) if len(labels) else 0.0
    if not 0 < toxic < 1:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((toxic + 1e-6) / (1 - toxic + 1e-6))))
    words, counts = space_words(pa.array([t or "" for t in texts], pa.string()))
    coded = words.dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    labels, counts = np.asarray(labels, np.int64)[counts > 0], counts[counts > 0]
    gram, grams = subwords(coded.dictionary, s)
    kept = telling(word, counts, labels, gram, grams, s)
    buckets = np.flatnonzero(kept)
    mine = kept[gram]
    own = np.repeat(np.arange(len(grams), dtype=np.int32), grams)[mine]
    gram = np.searchsorted(buckets, gram[mine])
    every, grams = grams, np.bincount(own, minlength=len(grams))
    size, text = windows_of(counts, s.window)
    spot = np.repeat(np.arange(len(size)), size)
    told = np.flatnonzero(grams[word] > 0)  # n-grams without a vector of their own have a zero vector
    spoken, word = np.unique(word[told], return_inverse=True)
    spot, part = spot[told], 1.0 / size[spot[told], None]
    held = np.bincount(spot, minlength=len(size))
    begin = np.cumsum(held) - held
    # Distinct words as means of their n-grams, then windows as means of their words.
    n = grams[spoken]
    member = gram[ragged((np.cumsum(grams) - grams)[spoken], n)]
    of_word = np.repeat(np.arange(len(spoken)), n)
    share = np.repeat(1.0 / every[spoken], n)[:, None]
    rng = np.random.default_rng(s.seed)
    table = rng.uniform(-0.1, 0.1, (len(buckets), s.dim))
    out, bias = rng.uniform(-0.1, 0.1, (s.dim, 2)), np.log(np.array([1 - toxic, toxic]))
    goal = np.eye(2)[labels]
    first = np.searchsorted(text, np.arange(len(counts)))
    adam = Adam([table, out, bias], s.rate)
    for step in range(s.warm_steps + s.steps):
        vectors = _sum_by(of_word, table[member] * share, len(spoken))
        hidden = _sum_by(spot, vectors[word] * part, len(size))
        if step < s.warm_steps:
            pooled = _sum_by(text, hidden, len(counts))
        else:
            worst = _worst(hidden @ (out[:, 1] - out[:, 0]), first)
            pooled = hidden[worst]
        d = (_softmax(pooled, out, bias) - goal) / len(goal)
        back = d @ out.T
        if step < s.warm_steps:
            some, d_hidden = slice(None), back[text[spot]]
        else:  # only the worst windows' words are to blame
            some = ragged(begin[worst], held[worst])
            d_hidden = np.repeat(back, held[worst], axis=0)
        d_vectors = _sum_by(word[some], d_hidden * part[some], len(spoken))
        adam.step([_sum_by(member, d_vectors[of_word] * share, len(buckets)), pooled.T @ d, d.sum(axis=0)])
    return Model(buckets, table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0]))


def predict(texts: pa.Array, model: Model, s: Settings) -> np.ndarray:
    """Each text's probability of being toxic."""
    words, counts = space_words(texts)
    odds = np.full(len(texts), min(model.bias, -1e-6))
    if len(words):
        coded = words.dictionary_encode()
        gram, grams = subwords(coded.dictionary, s)
        table = np.zeros(1 << s.buckets_log2)
        table[model.buckets] = model.odds
        of_word = np.add.reduceat(table[gram], np.cumsum(grams) - grams) / grams
        size, text = windows_of(counts, s.window)
        part = np.add.reduceat(of_word[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(size) - size) / size
        filled = np.flatnonzero(counts > 0)
        worst = np.maximum.reduceat(part, np.searchsorted(text, filled))
        known = np.add.reduceat((of_word != 0)[coded.indices.to_numpy(zero_copy_only=False)], np.cumsum(counts[filled]) - counts[filled]) > 0
        odds[filled] = np.where(known, model.bias + worst, odds[filled])
    return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_bytes: int) -> tuple[list, np.ndarray]:
    """At most ``most_rows`` labelled rows to learn from, those first in hashed order; never a held-out row.

    Held out are rows whose crc32 of the doc_id's text leaves 0 when divided by 5.
    """
    named = labels.filter(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    named = named.groupBy("doc_id").agg(F.max(label).alias("y"))
    n = named.count()
    if n > most_rows:  # narrow first by the hash alone, so that few texts travel
        share = min(1.0, 1.2 * most_rows / n)
        named = named.filter(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < int(share * 2**62))
    rows = docs.select("doc_id", "text").join(F.broadcast(named.limit(2 * most_rows)), "doc_id").withColumn("h", F.xxhash64("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")
    first = rows.select("doc_id", "h", size).orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(most_rows).collect()
    chosen, left = [], most_bytes
    for r in first:
        if r["size"] <= left:
            chosen.append((r.doc_id, r.h))
            left -= r["size"]
    keys = docs.sparkSession.createDataFrame(sorted(set(chosen)), "doc_id long, h long")
    got = rows.join(F.broadcast(keys), ["doc_id", "h"]).select("doc_id", "h", "text", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(len(chosen)).collect()
    return [r.text for r in got], np.array([r.y for r in got], np.int64)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = 4000, most_bytes: int = 64 << 20, settings: Settings = Settings()) -> Model:
    return fit(*labelled_sample(docs, labels, label, most_rows, most_bytes), settings)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """doc_id and score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of(batch):
                made = pa.array(predict(texts_of(piece), model, settings))
                yield pa.record_batch([piece.column("doc_id").cast(pa.int64()), made], names=["doc_id", "score"])

    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""

    ship(docs.sparkSession)
    return filtered(docs, lambda: lambda piece: pa.array(predict(texts_of(piece), model, settings) < threshold))
