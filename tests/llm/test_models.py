import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosswise.llm import bloomlm, fixity, interleave, multiset, toxicity
from crosswise.llm.queries import QUERIES, SQL

from .conftest import prose


def brute_scores(tokens, held, share=0.15):
    """Base score and score of each text by plain counting: a pair's count is the middle of its power of two."""
    seen = [t for t, h in zip(tokens, held) if not h]
    c, pairs = Counter(x for t in seen for x in t), Counter(p for t in seen for p in zip(t, t[1:]))
    floor = sum(c.values()) + 0.5 * (len(c) + 1)
    out = []
    for t in tokens:
        base = [(c[x] + 0.5) / floor for x in t]
        likely = list(base)
        for k in range(1, len(t)):
            before, n = c[t[k - 1]], pairs[t[k - 1], t[k]]
            level = n.bit_length()
            f = min(math.sqrt(2 ** (level - 1) * (2**level - 1)) if n else 0, before, c[t[k]])
            m = share * before / (before + 1)
            likely[k] = m * f / max(before, 1) + (1 - m) * base[k]
        out.append((sum(map(math.log10, base)), sum(map(math.log10, likely))))
    return out


@pytest.mark.parametrize("limits", [{}, {"broadcast_bytes": 0}, {"broadcast_text": 0}])
def test_language_model(make, odd, limits):
    rng = random.Random(11)
    words = [prose(rng, 1) for _ in range(60)]
    texts = [" ".join(rng.choice(words[: rng.choice([5, 60])]) for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", " ".join(words * 200)]
    o = bloomlm.Options(bucket_tokens=100, bits_a_pair=64, probes=12, batch_tokens=400, **limits)
    docs = make(texts, extra=["1 AS kind", "'x' AS bucket"])
    scored = bloomlm.bloom_scores(docs, o)
    assert str(scored._jdf.queryExecution().optimizedPlan()).count("MapInArrow") <= 1 and scored.columns[0] == "doc_id"
    got = {r.doc_id: r for r in scored.collect()}
    tokens = [[*(t or "").encode().lower().split(), None] for t in texts]
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(len(texts))]
    c = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    for k, (t, (base, score)) in enumerate(zip(tokens, brute_scores(tokens, held))):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(t), sum(c[x] > 0 for x in t), sum(c.values()))
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)
    both = [sorted((r.doc_id if r.doc_id is not None else -1, r.n_known, round(r.score, 6)) for r in bloomlm.bloom_scores(odd, bloomlm.Options(broadcast_text=n)).collect()) for n in (-1, 1 << 30)]
    assert both[0] == both[1] and len(both[0]) == odd.count()
    assert bloomlm.bloom_scores(odd.limit(0), o).count() == 0


def test_bloom_levels_never_too_low():
    rng = np.random.default_rng(12)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    counts = rng.zipf(1.5, 5000).clip(1, 10**6)
    level = bloomlm.levels_of(counts, 2.0)
    bits = bloomlm.Segment.build(keys, level, 12.0, 6)
    words = np.zeros(0, np.uint64).tobytes()
    block = bloomlm.Block(0, [(bits.tobytes(), words, words)], 1)
    got = block.level(keys, 6)
    assert (got >= level).all() and (got == level).mean() > 0.98
    assert (block.level(rng.integers(0, 1 << 63, 5000).astype(np.uint64), 6) > 0).mean() < 0.02


def lanes(spark, *texts):
    return [r.f for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", multiset.fingerprint(F.col("t")).alias("f")).orderBy("k").collect()]


def test_multiset_is_homomorphic(spark):
    a, b, c, d, e = lanes(spark, "one. two, three\n", " two, three\none.", "one. two,", "x", None)
    assert len(a) == len(b) and d != e
    rows = spark.createDataFrame([("p. q.", "p.", " q.", "")], "t string, a string, b string, e string")
    f = {n: multiset.fingerprint(F.col(n)) for n in "tabe"}
    back = multiset.added(multiset.removed(f["t"], f["a"]), f["a"])
    r = rows.select(f["t"].alias("whole"), back.alias("back"), multiset.likeness(f["t"], f["t"]).alias("same"), multiset.likeness(f["t"], f["e"]).alias("far")).first()
    assert r.whole == r.back and r.same == 1.0 and 0 <= r.far < 1
    reorder = lanes(spark, "x.y.z.", "z.x.y.")
    assert reorder[0] == reorder[1]
    long = lanes(spark, "ab. " * 1000, "ab. " * 999)
    assert long[0] != long[1] and long[0][-1] == 1001


@pytest.mark.parametrize("ids", [list(range(30)), [5] * 10 + [None] * 3 + list(range(-10**15, -10**15 + 17))])
def test_next_document(make, ids):
    rng = random.Random(13)
    texts = [prose(rng, rng.randint(0, 30)) for _ in range(30)]
    docs = make(texts, ids)
    h = {t: r for t, r in docs.select("text", F.xxhash64("text")).collect()}
    order = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
    body = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    got = sorted((r.text, r.next_text) for r in multiset.with_next(body, ["text"], rows_a_range=4).collect())
    assert got == sorted((order[k][1], order[(k + 1) % 30][1]) for k in range(30))


def test_an_outlying_id_leaves_ranges_even(spark):
    ids = [*range(4000), 10**17, -(10**18), *[77] * 1500]
    body = spark.createDataFrame([(i, k) for k, i in enumerate(ids)], "doc_id long, h long")
    bounds = multiset.range_bounds(body, 250, 64)
    sizes = [r.n for r in body.groupBy(multiset._range_of(bounds).alias("g")).agg(F.count("h").alias("n")).collect()]
    assert 15 <= len(sizes) <= 24 and max(sizes) < 2 * 250 + 100


def brute_lanes(text):
    """A text's fingerprint, piece by piece: 4 identity lanes, 64 longs of two likeness lanes, and the number of pieces."""
    import re

    import xxhash

    pieces = re.split(multiset.PIECE, text or "")
    hashes = [[xxhash.xxh64_intdigest(p.encode(), xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42)) for k in range(4)] for p in pieces]
    out = [sum((h[k] >> shift) & 0xFFFFFFFF for h in hashes) % (1 << 32) for k in (0, 1) for shift in (0, 32)]
    bits = [[sum(h[k] >> b & 1 for h in hashes) for b in range(64)] for k in (2, 3)]
    return [*out, *(own[m] + (own[m + 32] << 31) for own in bits for m in range(32)), len(pieces)], [2 * x - len(pieces) for own in bits for x in own]


def brute_likeness(a, b):
    x, y = np.array(a, float), np.array(b, float)
    return 1.0 if a == b else min(1.0, max(0.0, float(x @ y) / math.sqrt(float(x @ x) * float(y @ y)) if (x @ x) * (y @ y) else 0.0))


def test_fingerprints_equal_brute_force(spark, make, tmp_path):
    rng = random.Random(15)
    texts = ["".join(rng.choice(["ab", " ", ". ", ",", "\n", "é", "😀", "x!", "c?\n"]) for _ in range(rng.choice([0, 1, 2, 9, 60, 900]))) for _ in range(40)] + [None, None, "", "same. text", "same. text"]
    make(texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op6_multiset_hash"](spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    code = lambda lanes: "".join(f"{x:016x}" for x in lanes)
    for k, text in enumerate(texts):
        t, after = text or "", texts[(k + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        (own, a), (other, b), (_, c) = brute_lanes(t), brute_lanes(edited), brute_lanes(after)
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (code(own), code(other))
        assert r.near_edited == pytest.approx(1.0 if own == other else brute_likeness(a, b)) and r.near_next == pytest.approx(1.0 if t == after else brute_likeness(a, c))


def test_edited_texts(make, odd):
    docs = make(["abcdef", "xy", ""])
    got = {r.doc_id: r for r in multiset.fingerprints(docs).collect()}
    assert [got[k].edited for k in range(3)] == ["abcxy", "x", ""]
    assert multiset.fingerprints(odd).count() == odd.count() and multiset.fingerprints(odd.limit(0)).count() == 0
    assert multiset.fingerprints(docs.filter("doc_id = 1")).first().edited == "xx"


def test_toxicity_generalises(spark, make, odd):
    rng = random.Random(14)
    bad = ["idiot", "moron", "scum"]
    texts, labels = [], []
    for k in range(500):
        w = prose(rng, rng.randint(5, 120)).split()
        y = rng.random() < 0.3
        for _ in range(1 + len(w) // 40 if y else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append(int(y))
    docs = make(texts)
    named = spark.createDataFrame([(k, y) for k, y in enumerate(labels)] + [(900, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, named)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    out = [k for k in range(500) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([(got[k] >= 0.5) == labels[k] for k in out]) > 0.97
    s = toxicity.Settings()
    assert toxicity.predict(pa.array(["an idiott here", "the moronn"]), model, s).min() > toxicity.predict(pa.array([prose(rng, 4)]), model, s)[0]
    scored = toxicity.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns
    none = toxicity.train(docs.limit(0), named)
    assert toxicity.score(docs, none).filter("score >= 0.5").count() == 0
    assert toxicity.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("rows_a_bucket", [7, 4096])
def test_interleaving(spark, rows_a_bucket):
    rows = [(k, f"t{k}" if k % 7 else None, "hot" if k % 3 else ["a", "b", None][k % 9 // 3]) for k in range(501)] + [(1, "t1", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = interleave.interleave(docs, shards=10, rows_a_bucket=rows_a_bucket).collect()
    assert len(got) == 502
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len(by) == 10
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    for source in ("hot", "a", None):
        counts = [sum(r.source == source for r in own) for own in by.values()]
        assert max(counts) - min(counts) <= 4  # one at either end of a shard
    again = {(r.doc_id, r.size, r.shard, r.slot) for r in interleave.interleave(docs.repartition(2), shards=10, rows_a_bucket=rows_a_bucket).collect()}
    assert len(again ^ {(r.doc_id, r.size, r.shard, r.slot) for r in got}) <= 4  # rows alike may change places
    assert interleave.interleave(docs.limit(0)).count() == 0
    assert all(r.size == 16 + len((r.doc_id % 7 and f"t{r.doc_id}" or "")) for r in got)


def record(page, digest, length=100):
    return page, hashlib.sha256(digest.encode()).hexdigest(), length


def test_merkle_audit(spark):
    rows = [record(k, f"d{k}") for k in range(300)] + [record(None, "n"), record(None, "m"), record(7, "other"), record(7, "d7"), record(7, "d7")]

    def laid(some):
        frame = spark.createDataFrame(some, "page_id long, digest string, length long")
        return fixity.lay_out(frame, 8)

    def found(a, b):
        return sorted((r.page_id, r.status, r.copies, r.expected, r.found) for r in fixity.audit(a, b, 256, 4).collect())

    whole = laid(rows)
    assert whole.count() == 303 and whole.filter("page_id = 7 AND copies = 3").count() == 1
    assert found(whole, laid(rows)) == []
    # Each replica is laid out apart: a record that is lost or damaged is one row, whatever moves behind it.
    lost = laid([r for r in rows if r[0] != 5])
    assert found(whole, lost) == [(5, "missing", 1, rows[5][1], None)] and found(lost, whole) == [(5, "extra", 1, None, rows[5][1])]
    bad = [(r[0], "bad" if r[0] in (9, 200) else r[1], 3 if r[0] == 9 else r[2]) for r in rows[:-1] if r[0] != 5]
    assert found(whole, laid(bad)) == [(5, "missing", 1, rows[5][1], None), (7, "missing", 1, rows[7][1], None), (9, "corrupt", 1, rows[9][1], "bad"), (200, "corrupt", 1, rows[200][1], "bad")]
    assert fixity.audit(whole.limit(0), whole.limit(0)).count() == 0
    tree = fixity.MerkleTree(whole.select(F.lit(0).alias("replica"), "*"), 256, 4)
    assert tree.levels[-1].count() == 1


def test_warc_records_null_and_extra_columns(spark):
    df = spark.createDataFrame([(None, None, 1), ("u", None, 2), (None, "é", 3)], "url string, html string, offset int")
    got = [r.b for r in df.orderBy("offset").select(fixity.warc_record(F.col("url"), F.col("html")).alias("b")).collect()]
    assert got[0].endswith("URI: \r\nContent-Length: 0\r\n\r\n\r\n\r\n") and "URI: u\r" in got[1] and "Length: 2\r" in got[2]


@pytest.mark.parametrize("packed", [False, True])
def test_warc_files_are_read(spark, tmp_path, packed):
    import gzip

    bodies = [f"WARC/1.1\r\nWARC-Target-URI: http://x/{k}\r\nContent-Length: {n}\r\n\r\n{'y' * n}\r\n\r\n".encode() for k, n in enumerate((0, 5, 100_000))]
    stored = [gzip.compress(b) if packed else b for b in bodies]
    (tmp_path / "a.warc").write_bytes(b"".join(stored))
    (tmp_path / "b.warc").write_bytes(b"".join(stored[:2]) + stored[2][:50])
    rows = fixity.read_warc(spark, f"{tmp_path}/*.warc").collect()
    ends = np.cumsum([0, *map(len, stored)]).tolist()
    a = sorted((r.offset, r.length, r.uri, r.digest) for r in rows if r.file.endswith("a.warc"))
    assert a == [(ends[k], len(stored[k]), f"http://x/{k}", hashlib.sha256(b).hexdigest()) for k, b in enumerate(bodies)]
    b = sorted((r.offset, r.length, r.digest) for r in rows if r.file.endswith("b.warc"))
    assert b[:2] == [(x[0], x[1], x[3]) for x in a[:2]] and b[2][:2] == (ends[2], 50) and b[2][2] != a[2][3]


def test_audit_query_equals_its_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.sql(SQL["op1_merkle_audit"])
    df = QUERIES["op1_merkle_audit"](spark, d)
    assert sorted(map(repr, df.select(*want.columns).collect())) == sorted(repr(r) for r in df.select(*want.columns).collect())
    assert sorted(tuple(r) for r in df.select(*want.columns).collect()) == sorted(want.fetchall())


def insult(rng):
    return "".join(rng.choice("bcdfgjkqxz") + rng.choice("aeiou") for _ in range(4))


@pytest.mark.parametrize("clean, toxic, rare, times", [(58, 10, 2, 5), (900, 100, 5, 4)])
def test_toxicity_learns_from_few_labels_and_rare_words(clean, toxic, rare, times):
    rng = random.Random(13)
    names = [insult(rng) for _ in range(rare + 3)]

    def text(word):
        words = prose(rng, rng.randint(30, 120)).split()
        if word:
            words[rng.randrange(len(words))] = word
        return " ".join(words)

    said = [w for w in names[:rare] for _ in range(times)]
    said += [names[rare + k % 3] for k in range(toxic - len(said))]
    texts, labels = [text(None) for _ in range(clean)] + [text(w) for w in said], np.array([0] * clean + [1] * len(said))
    s = toxicity.Settings()
    model = toxicity.fit(texts, labels, s)
    bad = toxicity.predict(pa.array([text(w) for w in names[:rare] for _ in range(10)]), model, s) >= 0.5
    good = toxicity.predict(pa.array([text(None) for _ in range(300)]), model, s) >= 0.5
    assert bad.mean() > 0.9 and good.mean() < 0.03


def test_toxic_documents_are_rejected_with_few_labels(spark):
    found = QUERIES["op8_subword_toxicity"](spark, "/root/testdata/sf0.001")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").filter("toxic = 1")
    assert found.join(labels, "doc_id").filter("predicted = 1").count() > 0.5 * labels.count()
