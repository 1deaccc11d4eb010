"""Scores of pairs as column expressions; NULL means that a signal is missing, not that it is zero."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from crosswise.functions.text import blank_to_null, levenshtein_ratio

#: Weights of the six axes, the match threshold, and the near-miss band of names.
AXIS_WEIGHTS = {"name": 0.40, "smiles": 0.15, "reactants": 0.15, "procedure": 0.20, "yield": 0.05, "conditions": 0.05}
MATCH_AT = 0.55
NEAR_MISS = (0.40, 0.70)
ROOM_C = 25.0


@dataclass(frozen=True)
class MatchConfig:
    """Thresholds, weights and switches of the tiered matcher (fixed default values)."""

    tau_provenance: float = 0.50
    tau_jaccard: float = 0.85
    tau_combined: float = 0.70
    w_product_name: float = 0.30
    w_procedure: float = 0.30
    w_compound: float = 0.25
    w_reaction: float = 0.15
    enable_provenance: bool = True
    enable_compound_jaccard: bool = True
    enable_combined: bool = True

    def signature(self) -> str:
        """All ten fields, for cache keys."""
        return repr(self)


def _size(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays as sets; ``empty`` where both are empty (1 pairwise, 0 across runs)."""
    a, b = (F.coalesce(x, F.array().cast("array<string>")) for x in (a, b))
    return shared_rate(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), empty)


def shared_rate(shared: Column, n: Column, m: Column, empty: float = 0.0) -> Column:
    """The Jaccard index of two sets of n and m members, of which some are shared."""
    return F.when(n + m == 0, F.lit(empty)).otherwise(F.try_divide(shared.cast("double"), (n + m - shared).cast("double")))


def interval_jaccard(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Of inclusive intervals: 0 without overlap or for a reversed one, NULL where an end is unknown."""
    shared = F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)
    union = (e1 - s1 + 1) + (e2 - s2 + 1) - shared
    known = s1.isNotNull() & e1.isNotNull() & s2.isNotNull() & e2.isNotNull()
    return F.when(known, F.when((e1 < s1) | (e2 < s2) | (shared == 0), F.lit(0.0)).otherwise(shared.cast("double") / union))


def dot(a: Column, b: Column) -> Column:
    """Left-to-right sum of products, so equal inputs give equal doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def fused_dot(a: Column, b: Column) -> Column:
    """Left-to-right sum of products, each multiplied and added with one rounding, as SQL engines do in ``list_dot_product``.

    Orders and thresholds depend on the last bit of scores, so ``dot``'s two roundings would not do. Rows are not pruned or moved across it.
    """
    fma = lambda x, y, s: F.call_function("java_method", F.lit("java.lang.Math"), F.lit("fma"), x, y, s).cast("double")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")))
    plain = lambda s, p: F.when(s == 0, p["x"] * p["y"] + 0.0).otherwise(fma(p["x"], p["y"], s))  # noqa: E731  added to 0 there is one rounding anyway
    return F.aggregate(pairs, F.lit(0.0), lambda s, p: F.when(s.isNotNull() & p["x"].isNotNull() & p["y"].isNotNull(), plain(s, p)))


def cosine(a: Column, b: Column, missing: float | None = None, norms: tuple[Column, Column] | None = None) -> Column:
    """``missing`` where a vector is absent, empty, of another length or zero; ``norms``: both vectors' ``fused_dot`` with themselves, where known."""
    own, other = norms or (fused_dot(a, a), fused_dot(b, b))
    norm = own * other
    usable = (_size(a) > 0) & (_size(a) == _size(b)) & (norm > 0)
    return F.when(usable, fused_dot(a, b) / F.sqrt(norm)).otherwise(F.lit(missing).cast("double"))


def name_score(a: Column, b: Column) -> Column:
    """Of canonical names."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(a == b, F.lit(1.0)).otherwise(levenshtein_ratio(a, b))


def equal_score(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), (a == b).cast("double"))


def set_score(sa: Column, sb: Column, na: Column, nb: Column) -> Column:
    """Structures if both sides have some, else names; NULL if nothing, 0 if one side only."""
    structures = (_size(sa) > 0) & (_size(sb) > 0)
    a, b = (F.when(structures, s).otherwise(n) for s, n in ((sa, na), (sb, nb)))
    return F.when((_size(a) == 0) & (_size(b) == 0), F.lit(None).cast("double")).when((_size(a) == 0) | (_size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b))


def stepped(a: Column, b: Column, steps: list[tuple[float, float]]) -> Column:
    """The score of the first step whose width the difference does not exceed, else 0."""
    out = F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
    for width, score in steps:
        out = out.when(F.abs(a - b) <= width, F.lit(score))
    return out.otherwise(F.lit(0.0))


def yield_score(a: Column, b: Column) -> Column:
    return stepped(a, b, [(2.0, 1.0), (5.0, 0.75), (10.0, 0.40)])


def temperature_score(a: Column, a_room: Column, b: Column, b_room: Column) -> Column:
    a_room, b_room = F.coalesce(a_room, F.lit(False)), F.coalesce(b_room, F.lit(False))
    at = [F.when(room, F.lit(ROOM_C)).otherwise(t) for t, room in ((a, a_room), (b, b_room))]
    return F.when(a_room & b_room, F.lit(1.0)).otherwise(stepped(*at, [(5.0, 1.0), (10.0, 0.5)]))


def time_score(a: Column, b: Column) -> Column:
    larger = F.greatest(F.abs(a), F.abs(b))
    near = F.when(larger == 0, F.lit(1.0)).otherwise((F.try_divide(F.abs(a - b), larger) <= 0.20).cast("double"))
    return F.when(a.isNotNull() & b.isNotNull(), near)


def atmosphere(raw: Column) -> Column:
    """inert, air, h2, nh3 or vac; the order of tests matters; NULL for others."""

    def kind(x: Column) -> Column:
        return (
            F.when(x.contains("argon") | x.isin("ar") | x.contains("nitrogen") | x.isin("n2"), "inert")
            .when(x == "air", "air").when(x.contains("hydrogen") | x.isin("h2"), "h2")
            .when(x.contains("ammonia") | x.isin("nh3"), "nh3").when(x.contains("vacuum"), "vac")
        )

    # as an item of an array the folded text is made once, not once for each test
    return F.get(F.transform(F.array(F.lower(blank_to_null(raw))), kind), 0)


def mean_present(*scores: Column) -> Column:
    num = den = F.lit(0.0)
    for x in scores:
        num, den = num + F.coalesce(x, F.lit(0.0)), den + x.isNotNull().cast("double")
    return F.try_divide(num, den)


#: Weights are decimal numbers: their sums, and their products with steps that are decimal numbers too, are rounded to so many places.
PLACES = 12


def weighted(parts: list[tuple[float, Column]], steps: tuple[int, ...] = ()) -> Column:
    """Weighted mean of the parts that are there, summed in order; NULL if none is or their weights are 0.

    The sum of the weights is exact (all six axes weigh 1, not 1.0000000000000002), and so are the
    products of the parts numbered in ``steps``, whose scores are decimal numbers.
    """
    num = den = F.lit(0.0)
    for k, (w, x) in enumerate(parts):
        product = F.lit(w) * x
        num = num + F.coalesce(F.round(product, PLACES) if k in steps else product, F.lit(0.0))
        den = den + F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0))
    return F.try_divide(num, F.round(den, PLACES))


def clamp01(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)
