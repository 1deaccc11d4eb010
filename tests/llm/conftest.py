import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "an the tion er ing ed or st re nd ou ha es ti sh en al ka mo vi".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture()
def make(spark):
    def build(texts, ids=None, extra=None):
        rows = [(k if ids is None else ids[k], t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        return df if extra is None else df.selectExpr("*", *extra)

    return build


@pytest.fixture()
def odd(make):
    """Nulls, empties, ties, repeated rows, a very long text, and columns whose names operators also use."""
    rng = random.Random(5)
    long = prose(rng, 30_000)
    texts = [None, "", " ", "one", "one", "é ñ ß\n\n x", long, prose(rng, 80), prose(rng, 80)]
    return make(texts, [None, 1, 2, 3, 3, 4, 5, 6, None], ["1 AS score", "'f' AS fp", "2 AS shard", "3 AS h", "'x' AS spans", "4 AS size"])
