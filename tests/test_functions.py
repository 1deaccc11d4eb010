import pytest
from pyspark.sql import functions as F

from crosswise.functions import scores as S
from crosswise.functions import text as T
from crosswise.sources import paths


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("raw, want", [("N-tert- butyl", "n-tert-butyl"), ("  DIPEA. ", "dipea"), ("  ", None), (None, None), ("a  b", "a b"), ("ﬁne", "fine")])
def test_canonical_name(spark, raw, want):
    assert one(spark, T.canonical_name(F.lit(raw).cast("string"))) == want


def test_folding(spark):
    assert one(spark, T.casefold(F.lit("Straße"))) == "strasse"
    assert one(spark, T.step_label(F.lit(" Step_A "))) == "step a"
    assert one(spark, T.diagnostic_label(F.lit(None).cast("string"), F.lit("S1"))) == " | s1"


def test_atom_maps_and_ratio(spark):
    assert one(spark, T.strip_atom_maps(F.lit("[CH3:1][CH2:2][OH:3]"))) == "[CH3][CH2][OH]"
    assert one(spark, T.levenshtein_ratio(F.lit(""), F.lit(""))) == 1.0
    assert one(spark, S.name_score(F.lit("a"), F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("name, want", [("Hal", True), ("compound of formula (I)", True), ("formula II", True), ("ethanol", False), ("", True), (None, True), ("R-OH", True)])
def test_markush(spark, name, want):
    assert one(spark, T.looks_like_markush(F.lit(name).cast("string"))) is want


@pytest.mark.parametrize("a, b, want", [((0, 10), (5, 15), 6 / 16), ((5, 15), (12, 25), 4 / 21), ((0, 10), (12, 25), 0.0), ((1, 10), (6, 15), 5 / 15), ((3, 1), (1, 3), 0.0)])
def test_interval_jaccard(spark, a, b, want):
    assert one(spark, S.interval_jaccard(*map(F.lit, (*a, *b)))) == pytest.approx(want)


@pytest.mark.parametrize("other, want", [(51, 1.0), (54, 0.75), (58, 0.40), (70, 0.0), (None, None)])
def test_yield(spark, other, want):
    assert one(spark, S.yield_score(F.lit(50.0), F.lit(other).cast("double"))) == want


def test_reactants(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    none = F.array().cast("array<string>")
    assert one(spark, S.set_score(arr("CCO", "benzene"), arr("CCO"), none, none)) == 0.5
    assert one(spark, S.set_score(none, none, none, none)) is None
    assert one(spark, S.set_score(none, none, arr("a"), none)) == 0.0


def test_cosines_and_blend(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, S.cosine(v(1, 0), v(0, 1, 0))) is None
    assert one(spark, S.cosine(v(0, 0), v(1, 0))) is None
    assert one(spark, S.cosine(v(0, 0), v(1, 0), 0.0)) == 0.0
    assert one(spark, S.weighted([(0.30, F.lit(1.0)), (0.15, F.lit(0.0)), (0.3, F.lit(None).cast("double"))])) == pytest.approx(0.30 / 0.45)
    assert one(spark, S.weighted([(0.4, F.lit(1.0)), (0.2, F.lit(0.0))])) == pytest.approx(0.4 / 0.6)


def test_conditions(spark):
    none, no = F.lit(None).cast("double"), F.lit(None).cast("boolean")
    assert one(spark, S.temperature_score(none, F.lit(True), F.lit(28.0), no)) == 1.0
    assert one(spark, S.time_score(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, S.atmosphere(F.lit(" N2 "))) == "inert"
    assert one(spark, S.atmosphere(F.lit("steam"))) is None
    assert one(spark, T.classes_match(F.lit("Suzuki coupling"), F.lit("suzuki"))) is True


def test_paths(spark):
    name = F.lit("CN105884573B")
    assert one(spark, paths.uuid5(name)) == "4506b18c-80c1-5905-ad34-cecfd06ac15b"
    assert one(spark, paths.country_code(name)) == "CN"
    assert one(spark, paths.base_path(name)) == "literature/patents/CN/99/4506b18c-80c1-5905-ad34-cecfd06ac15b"
    assert one(spark, paths.country_code(F.lit("1"))) == "XX"


def test_composites_are_exact_to_the_last_bit(spark):
    """Equal weights sum to 1, steps are decimal numbers and products are summed with one rounding each, so near-ties are ordered as SQL orders them."""
    import math

    from crosswise.operators.reactions import AXES

    weights = [(S.AXIS_WEIGHTS[k], F.lit(x)) for k, x in zip(AXES, (0.3, 0.0, 0.0, 0.0, 0.75, 0.0))]
    vectors = spark.createDataFrame([([0.04, 0.07, 0.34], [0.09, 0.02, 0.98]), ([0.1, 0.03, 0.58], [0.07, 0.06, 0.14])], "a array<double>, b array<double>")
    found = vectors.select("a", "b", S.weighted(weights, (4,)).alias("w"), S.fused_dot(F.col("a"), F.col("b")).alias("dot"), S.cosine(F.col("a"), F.col("b")).alias("cos")).collect()
    for r in found:
        assert r.w == 0.4 * 0.3 + 0.0375

        def dot(x, y):
            out = 0.0
            for p, q in zip(x, y):
                out = math.fma(p, q, out)
            return out

        assert r.dot == dot(r.a, r.b) and r.cos == dot(r.a, r.b) / math.sqrt(dot(r.a, r.a) * dot(r.b, r.b))
