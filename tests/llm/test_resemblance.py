import random

import pytest

from crosswise.llm import resemblance
from crosswise.llm.stages import near_duplicate_stage

from .conftest import prose


def brute_groups(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= least * len(a | b):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return [find(i) for i in range(len(texts))]


def edited(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = prose(rng, 1) + "x"
    return " ".join(words)


@pytest.mark.parametrize("hot, block", [(32, 128), (2, 3)])
def test_stage_groups_by_jaccard(spark, make, hot, block):
    rng = random.Random(12)
    texts = [None, "", "  ", "one two", "One  two", "one two three"]
    for _ in range(8):  # chains of edits, whose ends need not be alike, and edits at both sides of 0.8
        t = prose(rng, 300)
        texts += [t, edited(rng, t, 4), edited(rng, t, 6), edited(rng, t, 12), edited(rng, t, 30)]
        for _ in range(4):
            t = edited(rng, t, 3)
            texts.append(t)
    texts += [texts[6], texts[6].upper()]
    want = brute_groups(texts)
    assert 10 < len(set(want)) < len(texts) - 30
    docs = make(texts, extra=["'x' AS h"])
    kept = resemblance.drop_resembling(docs, hot=hot, block=block)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))
    if hot == 32:
        assert sorted(r.doc_id for r in near_duplicate_stage(spark, docs, "").collect()) == sorted(set(want))


def test_stage_on_odd_rows(spark, make, odd):
    kept = near_duplicate_stage(spark, odd, "")
    assert kept.columns == odd.columns
    got = sorted((r.doc_id if r.doc_id is not None else 99, (r.text or "")[:3]) for r in kept.collect())
    texts = [r.text for r in odd.collect()]
    assert len(got) == len(set(brute_groups(texts))) and sum(k == 3 for k, _ in got) == 1
    assert near_duplicate_stage(spark, odd.limit(0), "").count() == 0
    t = prose(random.Random(1), 80)
    assert near_duplicate_stage(spark, make([t, t + " end", "other"], [None, None, 1]), "").count() == 2
