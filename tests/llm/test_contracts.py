"""The registered queries and the pipeline on small tables, against plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crosswise.llm import chunks, fixity, fuzzy, interleave, multiset, packing, planes, resemblance, suffixes, toxicity
from crosswise.llm.queries import QUERIES, vocabulary
from crosswise.llm.stages import STAGES
from crosswise.llm.tokens import PartEncoder

from .conftest import prose
from .test_search import brute_print, brute_windows, groups

CLASHES = ["h", "g", "id", "i", "fp", "row", "spans", "none", "nth", "n", "kind", "batch", "shard", "slot", "size", "score", "range", "lanes", "__h", "__spans", "__hit", "__items", "__best", "__id", "__none", "a.b", "c`d"]


def quoted(name):
    return "`" + name.replace("`", "``") + "`"


@pytest.fixture()
def tables(spark, make, tmp_path):
    """Documents with ties, empty and null texts, copies, a long text, benchmark passages and toxic words; written as the tables of a scale."""
    rng = random.Random(21)
    bad = ["zixoqa", "fubajo", "koxite"]
    items = [(k, prose(rng, n)) for k, n in enumerate((5, 12, 30, 40))] + [(None, prose(rng, 20)), (9, None)]
    passage = [prose(rng, 80) for _ in range(3)]
    texts = [None, "", " ", prose(rng, 9000)]
    for k in range(110):
        words = prose(rng, rng.randint(60, 160)).split()
        if k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad)
        if k % 9 == 1:
            words[20:20] = rng.choice(items[:5])[1].split()
        if k % 11 == 2:
            words[30:30] = passage[k % 3].split()
        texts.append(" ".join(words))
    texts += [texts[5], texts[6] + " more", texts[6], texts[7].replace(" ", "\n", 3)]
    docs = make(texts, extra=[f"{k} AS {quoted(c)}" for k, c in enumerate(CLASHES)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, 1, int(any(b in (t or "") for b in bad))) for k, t in enumerate(texts)]
    spark.createDataFrame([*labels, (0, 1, None), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), texts, items, labels


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_planes_and_packing(spark, tables):
    sf_dir, texts, _, _ = tables
    for name, query in (("word_bpe_49k.json", "op2_bit_planes"), ("byte_bpe_50k.json", "op7_best_fit_decreasing")):
        tok = PartEncoder(vocabulary(name)).tok
        want = [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
        rows = QUERIES[query](spark, sf_dir).collect()
        if query.startswith("op2"):
            start = np.cumsum([0, *map(len, want)]).tolist()
            assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == [(k, start[k], len(w), crc(w)) for k, w in enumerate(want)]
            continue
        spent = defaultdict(int)
        for r in rows:
            assert r.ids_crc32 == crc(want[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id]) and r.length > 0
            spent[r.doc_id] += r.length
        assert spent == {k: len(w) for k, w in enumerate(want)}
        windows = defaultdict(list)
        for r in rows:
            windows[r.sequence_id].append((r.offset, r.length))
        for own in windows.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= 2048


def test_search_queries(spark, tables):
    sf_dir, texts, items, _ = tables
    short = [t if k != 3 else "" for k, t in enumerate(texts)]  # the plain versions are slow on long texts
    want = brute_windows(short, items)
    got = {r.doc_id: tuple(r)[1:6] for r in QUERIES["op3_suffix_arrays"](spark, sf_dir).collect()}
    assert len(got) == len(texts) and all(got[k] == w[:5] for k, w in enumerate(want) if k != 3)
    prints = [brute_print(t) for t in texts]
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op9_golay_simhash"](spark, sf_dir).collect()}
    assert found == {k: (f"{p:016x}", c) for k, (p, c) in enumerate(zip(prints, groups(prints)))}


def test_sharding_and_toxicity_queries(spark, tables):
    sf_dir, texts, _, labels = tables
    rows = QUERIES["op10_interleave"](spark, sf_dir).collect()
    body = [(t or "").encode() for t in texts]
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in rows) == [(k, len(b) + 16, zlib.crc32(b), "rows", None) for k, b in enumerate(body)]
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    scored = QUERIES["op8_subword_toxicity"](spark, sf_dir).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    right = [r.predicted == labels[r.doc_id][2] for r in scored if r.held_out and r.doc_id != 3]
    assert len(scored) == len(texts) and np.mean(right) > 0.9


def brute_pipeline(texts, items, model):
    """doc_id -> what its text is after four stages."""
    scores = toxicity.predict(pa.array([t or "" for t in texts]), model, toxicity.Settings())
    docs = {k: t for k, t in enumerate(texts) if scores[k] < 0.5}
    sets = {}
    for k, t in docs.items():
        w = (t or "").lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and (sets[a] == sets[b] or (sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = {k: t for k, t in docs.items() if find(k) == k}
    seen, cut = {}, {}
    for k, t in docs.items():  # in ascending order: what of 50 words stood before goes
        w = (t or "").split()
        gone = set()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if run in seen:
                gone |= set(range(i, i + 50))
            seen.setdefault(run, k)
        cut[k] = [x for i, x in enumerate(w) if i not in gone]
    hits = brute_windows([" ".join(w) if len(w) < 2000 else "" for w in cut.values()], items)
    return {k: w for (k, w), h in zip(cut.items(), hits) if not h[1]}


def test_pipeline_equals_brute_force(spark, tables):
    sf_dir, texts, items, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    want = brute_pipeline(texts, items, model)
    now = docs
    for _, step in STAGES[:-1]:
        now = step(spark, now, sf_dir)
        assert now.columns == docs.columns
    rows = now.collect()
    assert {r.doc_id: (r.text or "").split() for r in rows} == want and len(rows) == len(want)
    assert all(r["__h"] == CLASHES.index("__h") and r["a.b"] == CLASHES.index("a.b") and r["row"] == CLASHES.index("row") for r in rows)
    tok = PartEncoder(vocabulary("byte_bpe_50k.json")).tok
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
    packed = sorted((r.doc_id, r.start, bytes(r.ids)) for r in corpus_pipeline.run(spark, sf_dir).collect())
    whole = defaultdict(bytes)
    for k, start, part in packed:
        assert len(whole[k]) == 4 * start
        whole[k] += part
    assert {k: np.frombuffer(b, "<u4").tolist() for k, b in whole.items()} == ids


def test_pipeline_on_an_empty_table(spark, tables):
    sf_dir, *_ = tables
    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, step in STAGES:
        now = step(spark, now, sf_dir)
    assert now.count() == 0


def test_every_operator_takes_any_column_names(spark, tables):
    sf_dir, texts, _, _ = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 12")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for out in (chunks.drop_repeats(docs), suffixes.decontaminate(docs, bench), suffixes.decontaminate(docs, bench, block_bytes=10), toxicity.drop_toxic(docs, model), fuzzy.drop_near_duplicates(docs), resemblance.drop_resembling(docs)):
        assert out.columns == docs.columns
        assert all(r["__spans"] == CLASHES.index("__spans") and r["c`d"] == CLASHES.index("c`d") for r in out.collect())
    for out in (chunks.repeats(docs), suffixes.contamination(docs, bench, block_bytes=10), toxicity.score(docs, model), fuzzy.near_duplicates(docs), interleave.interleave(docs), multiset.fingerprints(docs), packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")), planes.token_planes(docs, vocabulary("word_bpe_49k.json"))):
        assert out.count() >= 0
    pages = spark.createDataFrame([(1, "d", 5)], "page_id long, digest string, length long").select("*", F.lit(1).alias("a_b"), F.lit(2).alias("more"))
    assert fixity.audit(fixity.lay_out(pages, 1), fixity.lay_out(pages, 1)).count() == 0


@pytest.mark.parametrize("text", ["a", "a a a", " ".join(f"w{k}" for k in range(16_384)) + " a"])
def test_toxicity_scores_one_letter_words(text):
    texts = [f"{'idiot' if k % 2 else 'friend'} {k}" for k in range(10)]
    model = toxicity.fit(texts, np.array([k % 2 for k in range(10)]), toxicity.Settings())
    got = toxicity.predict(pa.array([text, "an idiot", "a friend"]), model, toxicity.Settings())
    assert 0 <= got[0] <= 1 and (len(text) > 9 or got[0] < 0.5) and got[1] > got[2]


def test_toxicity_learns_from_long_texts_within_its_bytes(spark):
    long = "gentle words here " * 40_000
    rows = [(k, long if k == 1 else f"text {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, toxic int")
    trained = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5]
    got, y = toxicity.labelled_sample(docs, labels, "toxic", 4000, 64 << 20)
    assert sorted(map(len, got)) == sorted(len(t) for k, t in rows if k in trained) and len(y) == len(got)
    few, _ = toxicity.labelled_sample(docs, labels, "toxic", 4000, 100)
    assert sum(map(len, few)) <= 100 and len(toxicity.labelled_sample(docs, labels, "toxic", 5, 64 << 20)[0]) == 5


@pytest.mark.parametrize("hot", [512, 2])
def test_keys_crowded_on_the_listing_side_lose_no_link(spark, hot):
    rng = random.Random(31)
    center = rng.getrandbits(64)
    prints = {center}
    for _ in range(150):
        p = center
        for bit in rng.sample(range(64), rng.randint(1, 5)):
            p ^= 1 << bit
        prints.add(p)
    prints = sorted(prints)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    found = fuzzy.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), hot=hot, block=16).collect()
    at = {signed(p): k for k, p in enumerate(prints)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert (prints[at[r.u]] ^ prints[at[r.v]]).bit_count() <= 3
        a, b = sorted((find(at[r.u]), find(at[r.v])))
        root[b] = a
    assert [find(k) for k in range(len(prints))] == groups(prints)


def test_words_beside_are_asked_once(spark, make):
    rng = random.Random(32)
    text = prose(rng, 100)
    docs = make([text, prose(rng, 20) + " " + text] * 12, [1, 2] * 12)
    found = chunks.repeats(docs).collect()
    assert [(r.doc_id, r.start, r.n_words, r.first_doc_id, r.first_start) for r in found] == [(2, 20, 100, 1, 0)]


def test_periodic_junk_is_found_at_any_phase(make):
    rng = random.Random(33)
    junk = "na hey " * 200
    docs = make([prose(rng, 30) + " " + junk + prose(rng, 30), prose(rng, 41) + " hey " + junk + prose(rng, 12), "x y z a b c d " * 60])
    cut = {r.doc_id: len(r.text.split()) for r in chunks.drop_repeats(docs).collect()}
    assert cut[1] < 41 + 12 + 100 and cut[2] < 100
