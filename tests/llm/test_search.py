import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from crosswise.llm import chunks, fuzzy, suffixes
from crosswise.llm.queries import op9_golay_simhash  # noqa: F401

from .conftest import prose


def brute_windows(texts, items, width=10):
    """n_words, n_hit, n_items, items_sha256, contaminated, and the longest match (words, start, item) of each text, word by word."""
    windows = {}
    for name, text in items:
        w = suffixes.words_of(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(name)
    out = []
    for t in texts:
        w, hit, names, best = suffixes.words_of(t), set(), set(), None
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        for name, text in items:
            v = suffixes.words_of(text)
            for i in range(len(w)):
                for j in range(len(v)):
                    n = 0
                    while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                        n += 1
                    if n >= min(width, len(v)):
                        found = (-n, i, name is None, name or 0)
                        best = min(best, found) if best else found
        digest = hashlib.sha256(",".join(sorted(str(x) for x in names if x is not None)).encode()).hexdigest()
        longest = (-best[0], best[1], None if best[2] else best[3]) if best else (0, None, None)
        out.append((len(w), len(hit), len(names), digest, bool(hit), *longest))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, make, block_bytes):
    rng = random.Random(4)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 25, 40]))) for k in range(12)] + [(90, ""), (91, None), (92, "...")]
    items += [(99, items[0][1]), (None, prose(rng, 30)), (None, items[4][1]), (13, items[5][1] + " " + prose(rng, 6)), *((200 + k, prose(rng, 11)) for k in range(25))]
    words = [t.split() for _, t in items[:12]] + [items[16][1].split()]
    texts = [None, "", prose(rng, 40), items[16][1], prose(rng, 3000) + " " + items[6][1] + " " + prose(rng, 30_000)]
    for _ in range(25):
        w = rng.choice(words)
        a = rng.randrange(len(w))
        texts.append(prose(rng, rng.randint(0, 9)) + " " + " ".join(w[a : a + rng.randint(1, 30)]).upper() + ", " + prose(rng, 5))
    docs = make(texts + texts[8:10], [*range(len(texts)), 8, 9], extra=["'k' AS contaminated", "1 AS hits", "2 AS h", "3 AS `a.b`", "4 AS __hit"])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = suffixes.contamination(docs, bench, block_bytes=block_bytes, shard_bytes=300)
    assert str(found._jdf.queryExecution().optimizedPlan()).count("MapInArrow") <= 1  # blocks are no chain of workers
    rows = found.collect()
    got = {r.doc_id: tuple(r)[1:] for r in rows}
    want = brute_windows(texts[:4] + [texts[4][:0]] + texts[5:], items)
    want[4] = got[4]  # its words are too many for the plain version; below
    assert len(rows) == len(texts) + 2 and [got[k] for k in range(len(texts))] == want
    n = len(items[6][1].split())
    assert got[4][1] == n and got[4][5:7] == (n, 3000)
    kept = suffixes.decontaminate(docs, bench, block_bytes=block_bytes)
    assert kept.columns == docs.columns
    clean = [k for k, w in enumerate(want) if not w[1]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean + [k for k in (8, 9) if k in clean])
    assert suffixes.contamination(docs.limit(0), bench).count() == 0
    assert suffixes.decontaminate(docs, bench.limit(0)).count() == len(texts) + 2


def brute_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, errors=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= errors:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def test_golay_decoder_is_perfect():
    index = fuzzy.golay_decoder()
    assert np.bincount(index, minlength=4096).tolist() == [2048] * 4096


@pytest.mark.parametrize("hot", [512, 2])
def test_every_link_is_found(spark, hot):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(160):
        p = rng.choice(prints)
        for b in rng.sample(range(64), rng.randint(0, 4)):
            p ^= 1 << b
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = fuzzy.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot=hot).collect()
    at = {p: k for k, p in enumerate(signed)}
    pairs = {tuple(sorted((at[r.u], at[r.v]))) for r in found}
    want = {(j, i) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3}
    assert pairs <= want
    if hot == 512:
        assert pairs == want
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == groups(prints)


def test_near_duplicates(make, odd):
    rng = random.Random(7)
    base = [prose(rng, 400) for _ in range(6)]
    texts = base + [base[0]] * 3 + [b.replace(b.split()[50], "changed", 1) for b in base]
    docs = make(texts)
    want = groups([brute_print(t) for t in texts])
    assert {r.doc_id: r.component_id for r in fuzzy.near_duplicates(docs).collect()} == dict(enumerate(want))
    assert sorted(r.doc_id for r in fuzzy.drop_near_duplicates(docs).collect()) == sorted(set(want))
    kept = fuzzy.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert len({brute_print(r.text) for r in odd.collect()}) >= kept.count() > 2
    assert sum(r.doc_id == 3 for r in kept.collect()) == 1
    assert fuzzy.near_duplicates(odd.limit(0)).count() == 0 and fuzzy.drop_near_duplicates(odd.limit(0)).count() == 0


def test_repeats_across_documents(make):
    rng = random.Random(8)
    passages = [prose(rng, n).split() for n in (50, 55, 70, 120)]
    texts, holds = [], []
    for k in range(40):
        p = rng.choice(passages) if k % 2 else []
        texts.append(" ".join(prose(rng, rng.randint(20, 90)).split() + p + prose(rng, rng.randint(20, 90)).split()))
        holds.append(passages.index(p) if p else None)
    short = prose(rng, 30)
    texts += [short + " " + prose(rng, 60), prose(rng, 60) + " " + short, None, ""]
    found = chunks.repeats(make(texts)).collect()
    seen, want = set(), set()
    for k, h in enumerate(holds):
        if h is not None and h in seen:
            want.add(k)
        seen.add(h)
    assert {r.doc_id for r in found} == want
    for r in found:
        h = holds[r.doc_id]
        words, p = texts[r.doc_id].split(), passages[h]
        at = next(i for i in range(len(words)) if words[i : i + len(p)] == p)
        assert (r.start, r.n_words) == (at, len(p)) and holds[r.first_doc_id] == h
        assert texts[r.first_doc_id].split()[r.first_start : r.first_start + 50] == p[:50]


def test_drop_repeats(make, odd):
    rng = random.Random(9)
    p, a, b = prose(rng, 60), prose(rng, 40), prose(rng, 40)
    docs = make([f"{a} {p} end", f"{b}\n{p}\n{a}", None], extra=["1 AS h"])
    got = {r.doc_id: r.text for r in chunks.drop_repeats(docs).collect()}
    assert got[0] == f"{a} {p} end" and got[1] == f"{b}\n{a}" and got[2] is None
    kept = chunks.drop_repeats(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert chunks.drop_repeats(odd.limit(0)).count() == 0


def test_chunks_resist_insertions():
    rng = random.Random(10)
    text = prose(rng, 3000)
    o = chunks.Options()
    before = set(chunks.chunks_of(text.encode(), o)[0].tolist())
    after = set(chunks.chunks_of(("inserted words " + text).encode(), o)[0].tolist())
    assert len(before - after) <= 3
    digest, first, n = chunks.chunks_of(("a " * 500).encode(), o)
    assert n.sum() == 500 and n.max() <= o.longest


@pytest.mark.parametrize("low, high, lines", [(26, 30, 2), (18, 25, 3), (6, 9, 8)])
def test_repeats_whose_lines_stood_apart_before(make, low, high, lines):
    rng = random.Random(14)
    single = [prose(rng, rng.randint(low, high)) for _ in range(60)]
    texts = [f"{prose(rng, 20)}\n{line}\n{prose(rng, 20)}" for line in single]
    passages = [p for p in ("\n".join(rng.sample(single, lines)) for _ in range(45)) if len(p.split()) > 50][:30]
    assert len(passages) == 30
    for _ in range(2):
        texts += [f"{prose(rng, 25)}\n{p}\n{prose(rng, 25)}" for p in passages]
    found = {}
    for r in chunks.repeats(make(texts)).collect():
        found.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    second = len(texts) - len(passages)
    whole = [set(range(25, 25 + len(p.split()))) <= found.get(second + k, set()) for k, p in enumerate(passages)]
    assert all(whole), whole.count(False)
    assert not set(found) & set(range(len(single)))
