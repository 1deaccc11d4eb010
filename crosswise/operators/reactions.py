"""Matching of records: 6-axis pairs with greedy assignment, tiered n-way edges with constrained clustering, line join, sweep.

Pairs are made inside a document only: by an equi-join on ``doc_id``, or (edges and clusters) from the array of its
records. The greedy passes are order-dependent: each document's surviving edges are sorted into one total order and folded
by a native ``aggregate``, without Python. A document has tens of records, and its edges were thresholded before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswise.functions import scores as S
from crosswise.functions.text import blank_to_null, class_words, diagnostic_label, step_label, words_match
from crosswise.session import stage

TIER_ORDER = ("provenance", "compound_jaccard", "combined")
AXES = ("name", "smiles", "reactants", "procedure", "yield", "conditions")


def synthetic_only(entries: DataFrame) -> DataFrame:
    return entries.filter(~F.coalesce("non_synthetic", F.lit(False)))


def skipped_counts(entries: DataFrame) -> DataFrame:
    """Per label how many records the matcher takes and how many it skips as not synthetic."""
    skipped = F.coalesce("non_synthetic", F.lit(False))
    return entries.groupBy("label").agg(F.count_if(~skipped).alias("kept"), F.count_if(skipped).alias("skipped"))


def _sides(entries: DataFrame, prefix: str, names: Iterable[str]) -> DataFrame:
    return entries.select("doc_id", *[F.col(c).alias(f"{prefix}_{c}") for c in names])


PAIR_FIELDS = ("ord", "name", "smiles", "reactant_smiles", "reactant_names", "procedure_vector", "yield_pct", "temperature_c", "room_temperature", "time_h", "atmosphere", "reaction_class", "diagnostic")


def pair_scores(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """All baseline-candidate pairs of each document with six axes and the composite.

    Names and structures are canonical already (``name``, ``smiles``, ``reactant_*``). What depends on one record is computed before the join.
    """
    own = lambda df: df.withColumns({"norm": S.fused_dot(F.col("procedure_vector"), F.col("procedure_vector")), "words": class_words(F.col("reaction_class")), "gas": S.atmosphere(F.col("atmosphere"))})
    names = (*(n for n in PAIR_FIELDS if n not in ("atmosphere", "reaction_class")), "norm", "words", "gas")
    p = _sides(own(baseline), "b", names).join(_sides(own(candidate), "c", names), "doc_id")
    b, c = (lambda n: F.col(f"b_{n}")), (lambda n: F.col(f"c_{n}"))
    conditions = S.mean_present(
        S.temperature_score(b("temperature_c"), b("room_temperature"), c("temperature_c"), c("room_temperature")),
        S.time_score(b("time_h"), c("time_h")),
        S.equal_score(b("gas"), c("gas")),
    )
    both = b("procedure_vector").isNotNull() & c("procedure_vector").isNotNull()
    axes = {
        "name": S.name_score(b("name"), c("name")),
        "smiles": S.equal_score(b("smiles"), c("smiles")),
        "reactants": S.set_score(b("reactant_smiles"), c("reactant_smiles"), b("reactant_names"), c("reactant_names")),
        "procedure": F.when(both, S.cosine(b("procedure_vector"), c("procedure_vector"), 0.0, (b("norm"), c("norm")))),
        "yield": S.yield_score(b("yield_pct"), c("yield_pct")),
        "conditions": conditions,
    }
    out = p.select(
        "doc_id", "b_ord", "c_ord", *[v.alias(f"axis_{k}") for k, v in axes.items()],
        F.coalesce(b("diagnostic") == c("diagnostic"), F.lit(False)).alias("label_match"),
        F.coalesce(b("smiles") == c("smiles"), F.lit(False)).alias("smiles_match"),
        F.abs(b("yield_pct") - c("yield_pct")).alias("yield_difference"),
        words_match(b("words"), c("words")).alias("class_match"),
    )
    return out.withColumn("composite", S.weighted([(S.AXIS_WEIGHTS[k], F.col(f"axis_{k}")) for k in AXES], (AXES.index("yield"),)))


def assign(pairs: DataFrame, threshold: float = S.MATCH_AT) -> DataFrame:
    """Greedy one-to-one assignment: best composite first, ties by candidate then baseline order."""

    kept = pairs.filter(F.col("composite") >= threshold)
    edge = F.struct((-F.col("composite")).alias("worst"), "c_ord", "b_ord", "composite")
    kinds = dict(pairs.dtypes)
    start = F.expr(f"named_struct('b', cast(array() as array<{kinds['b_ord']}>), 'c', cast(array() as array<{kinds['c_ord']}>), 'x', cast(array() as array<double>))")

    def take(done: Column, e: Column) -> Column:
        used = F.array_contains(done["b"], e["b_ord"]) | F.array_contains(done["c"], e["c_ord"])
        return F.when(used, done).otherwise(F.struct(F.array_append(done["b"], e["b_ord"]).alias("b"), F.array_append(done["c"], e["c_ord"]).alias("c"), F.array_append(done["x"], e["composite"]).alias("x")))

    won = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(edge)).alias("e")).select("doc_id", F.aggregate("e", start, take).alias("w"))
    rows = won.select("doc_id", F.explode(F.arrays_zip(F.col("w.b").alias("b_ord"), F.col("w.c").alias("c_ord"), F.col("w.x").alias("composite"))).alias("r"))
    return rows.select("doc_id", "r.b_ord", "r.c_ord", "r.composite")


def match_details(pairs: DataFrame, matches: DataFrame, baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Matches with their axes, then unmatched candidates and baselines (anti joins)."""
    won = matches.select("doc_id", "b_ord", "c_ord").join(pairs, ["doc_id", "b_ord", "c_ord"]).withColumn("match_type", F.lit("CONTENT_MATCH"))
    fp = candidate.select("doc_id", F.col("ord").alias("c_ord")).join(matches, ["doc_id", "c_ord"], "left_anti").withColumn("match_type", F.lit("FALSE_POSITIVE"))
    fn = baseline.select("doc_id", F.col("ord").alias("b_ord")).join(matches, ["doc_id", "b_ord"], "left_anti").withColumn("match_type", F.lit("FALSE_NEGATIVE"))
    return won.unionByName(fp, allowMissingColumns=True).unionByName(fn, allowMissingColumns=True)


def near_misses(pairs: DataFrame, matches: DataFrame) -> DataFrame:
    """Pairs with a middling name score that did not win."""
    low, high = S.NEAR_MISS
    return pairs.filter((F.col("axis_name") >= low) & (F.col("axis_name") < high)).join(matches, ["doc_id", "b_ord", "c_ord"], "left_anti")


def match_report(details: DataFrame, misses: DataFrame | None = None) -> DataFrame:
    """Per document: counts, precision, recall, F1 (0 on empty denominators) and averages over matches (NULL without any); with ``misses``, their number."""
    tp = F.col("match_type") == "CONTENT_MATCH"
    count = lambda kind: F.count_if(F.col("match_type") == kind)
    percent = lambda c: F.try_divide(100.0 * F.count_if(tp & c), F.count_if(tp & c.isNotNull()).cast("double"))
    out = details.groupBy("doc_id").agg(
        count("CONTENT_MATCH").alias("tp"), count("FALSE_POSITIVE").alias("fp"), count("FALSE_NEGATIVE").alias("fn"),
        F.avg(F.when(tp, F.col("axis_reactants"))).alias("avg_reactants"), percent(F.col("axis_reactants") == 1.0).alias("perfect_reactants_pct"),
        F.avg(F.when(tp, F.col("yield_difference"))).alias("yield_mae"), percent(F.col("yield_difference") <= 5.0).alias("yield_within_5_pct"),
        F.avg(F.when(tp, F.col("class_match").cast("double"))).alias("class_accuracy"), F.avg(F.when(tp, F.col("axis_procedure"))).alias("avg_procedure"),
        *[F.avg(F.when(tp, F.col(f"axis_{k}").isNotNull().cast("double"))).alias(f"coverage_{k}") for k in AXES],
    )
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    out = out.withColumn("precision", rate("tp", "fp")).withColumn("recall", rate("tp", "fn"))
    if misses is not None:
        out = out.join(misses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("near_misses")), "doc_id", "left").na.fill(0, ["near_misses"])
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def label_overlap(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per document the distinct diagnostic labels that both sides have."""
    keys = lambda df: df.filter(F.col("diagnostic").isNotNull()).select("doc_id", "diagnostic")
    return keys(baseline).intersect(keys(candidate)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("overlap"))


EDGE_FIELDS = ("ord", "label", "name", "start_line", "end_line", "compound_smiles", "procedure_vector", "reaction_vector")


VECTORS = {"norm": "procedure_vector", "reaction_norm": "reaction_vector"}


def _set_size() -> Column:
    return F.size(F.array_distinct("compound_smiles"))


def _own(entries: DataFrame) -> DataFrame:
    """``entries`` with what a record has by itself: the size of its set and its vectors' dot products with themselves."""
    return entries.withColumns({"n_compounds": _set_size(), **{n: S.fused_dot(F.col(v), F.col(v)) for n, v in VECTORS.items()}})


def _signals(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
    """What is cheap to say of a pair of records, of which ``a`` and ``b`` give the fields."""
    overlap = S.interval_jaccard(a("start_line"), a("end_line"), b("start_line"), b("end_line"))
    both = (F.coalesce(a("n_compounds"), F.lit(0)) > 0) & (F.coalesce(b("n_compounds"), F.lit(0)) > 0)
    sets = F.when(both, S.shared_rate(F.size(F.array_intersect(a("compound_smiles"), b("compound_smiles"))), a("n_compounds"), b("n_compounds")))
    return {"overlap": overlap, "sets": sets, "same": S.equal_score(a("name"), b("name"))}


def _cosines(a: Callable[[str], Column], b: Callable[[str], Column]) -> dict[str, Column]:
    return {n: S.cosine(a(v), b(v), norms=(a(n), b(n))) for n, v in VECTORS.items()}


def _blend(p: Callable[[str], Column], config: S.MatchConfig, alike: dict[str, Column] | None = None) -> Column:
    """The weighted mean of a pair's signals and cosines."""
    alike = alike or {n: S.clamp01(p(n)) for n in VECTORS}
    parts = [(config.w_product_name, p("same")), (config.w_procedure, alike["norm"]), (config.w_compound, p("sets")), (config.w_reaction, alike["reaction_norm"])]
    return F.coalesce(S.weighted(parts), F.lit(0.0))


def _fires(p: Callable[[str], Column], config: S.MatchConfig) -> list[Column]:
    """Whether a pair fires at the two tiers that need no cosine."""
    return [
        F.lit(config.enable_provenance) & F.coalesce(p("overlap") >= config.tau_provenance, F.lit(False)),
        F.lit(config.enable_compound_jaccard) & F.coalesce(p("sets") >= config.tau_jaccard, F.lit(False)),
    ]


def _may_fire(p: Callable[[str], Column], both: dict[str, Column], config: S.MatchConfig) -> Column:
    """Whether a pair fires at some tier if its cosines are 1, the most they can be, where ``both`` vectors are there: no other pair can fire."""
    may = F.lit(config.enable_combined)
    if min(config.w_product_name, config.w_procedure, config.w_compound, config.w_reaction) >= 0:
        most = _blend(p, config, {n: F.when(x, F.lit(1.0)) for n, x in both.items()})
        may = may & (most >= config.tau_combined - 1e-9)
    fires = _fires(p, config)
    return fires[0] | fires[1] | may


def _tiered(p: Callable[[str], Column], blend: Column, config: S.MatchConfig) -> tuple[Column, Column]:
    """The strongest tier that a pair fires at (NULL if none), and its score there."""
    fires = [*_fires(p, config), F.lit(config.enable_combined) & (blend >= config.tau_combined)]
    return F.when(fires[0], 0).when(fires[1], 1).when(fires[2], 2), F.when(fires[0], p("overlap")).when(fires[1], p("sets")).when(fires[2], blend)


def edge_scores(entries: DataFrame, config: S.MatchConfig = S.MatchConfig()) -> DataFrame:
    """Every pair of different labels of a document with what each tier says of it (thresholds and switches have no part in it)."""
    names = (*EDGE_FIELDS, "n_compounds", *VECTORS)
    own = _own(entries)
    p = _sides(own, "l", names).join(_sides(own, "r", names), "doc_id").filter("l_ord < r_ord and l_label <> r_label")
    a, b = (lambda n: F.col(f"l_{n}")), (lambda n: F.col(f"r_{n}"))
    ids = ("doc_id", "l_ord", "r_ord", "l_label", "r_label")
    # each cosine is a column of its own: the blend reads it several times
    p = p.select(*ids, *[v.alias(n) for n, v in (*_signals(a, b).items(), *_cosines(a, b).items())])
    return p.select(*ids, "overlap", "sets", _blend(F.col, config).alias("blend"))


def fired(scored: DataFrame, config: S.MatchConfig = S.MatchConfig()) -> DataFrame:
    """The scored pairs that fire at some tier: the strongest, with its own score."""
    tier, score = _tiered(F.col, F.col("blend"), config)
    return scored.select("doc_id", "l_ord", "r_ord", "l_label", "r_label", tier.alias("tier"), score.alias("score")).filter("tier is not null")


def _linked(e: Column) -> Column:
    """Single linkage of a document's sorted edges, strongest first, at most one record per label in a cluster: the clusters' records, labels and tier."""
    alone = lambda o, label: F.struct(F.array(o).alias("ords"), F.array(label).alias("labels"), F.lit(None).cast("int").alias("tier"))
    ends = F.array_distinct(F.flatten(F.transform(e, lambda x: F.array(alone(x["l_ord"], x["l_label"]), alone(x["r_ord"], x["r_label"])))))

    def join(groups: Column, e: Column) -> Column:
        a = F.get(F.filter(groups, lambda g: F.array_contains(g["ords"], e["l_ord"])), 0)
        b = F.get(F.filter(groups, lambda g: F.array_contains(g["ords"], e["r_ord"])), 0)
        both = F.struct(
            F.concat(a["ords"], b["ords"]).alias("ords"), F.concat(a["labels"], b["labels"]).alias("labels"), F.greatest(e["tier"], a["tier"], b["tier"]).alias("tier")
        )
        rest = F.filter(groups, lambda g: ~F.array_contains(g["ords"], e["l_ord"]) & ~F.array_contains(g["ords"], e["r_ord"]))
        # a cluster holds its own labels, so two records of one cluster overlap as well
        return F.when(F.arrays_overlap(a["labels"], b["labels"]), groups).otherwise(F.concat(rest, F.array(both)))

    return F.aggregate(e, ends, join)


def _edge(p: Callable[[str], Column], tier: Column, score: Column) -> Column:
    return F.struct(tier.alias("tier"), (-score).alias("weak"), *[p(c).alias(c) for c in ("l_ord", "r_ord", "l_label", "r_label")])


def _tier_name(tier: Column) -> Column:
    return F.when(tier.isNotNull(), F.element_at(F.array(*[F.lit(t) for t in TIER_ORDER]), tier + 1))


def _named(entries: DataFrame, found: DataFrame) -> DataFrame:
    """``entries`` with the clusters and tiers that the edges ``found`` give."""
    sorted_ = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(_edge(F.col, F.col("tier"), F.col("score")))).alias("e"))
    folded = sorted_.select("doc_id", F.explode(_linked(F.col("e"))).alias("g")).select("doc_id", F.explode("g.ords").alias("ord"), F.array_min("g.ords").alias("cluster_id"), "g.tier")
    return entries.select("doc_id", "ord", "label").join(folded, ["doc_id", "ord"], "left").select(
        "doc_id", "ord", "label", F.coalesce("cluster_id", "ord").alias("cluster_id"), _tier_name(F.col("tier")).alias("match_tier")
    )


def _with_edges(docs: DataFrame, config: S.MatchConfig) -> DataFrame:
    """``docs(doc_id, rs)``, a row for each document with the array of its records, with its sorted edges ``e``."""
    ids = ("l_ord", "r_ord", "l_label", "r_label", "overlap", "sets")

    def of(left: Column) -> Column:
        others = F.filter("rs", lambda r: (left["ord"] < r["ord"]) & (left["label"] != r["label"]))
        pairs = F.transform(others, lambda r: F.struct(
            left["ord"].alias("l_ord"), r["ord"].alias("r_ord"), left["label"].alias("l_label"), r["label"].alias("r_label"), left["at"].alias("l_at"), r["at"].alias("r_at"),
            *[v.alias(n) for n, v in _signals(left.getField, r.getField).items()], *[(left[v].isNotNull() & r[v].isNotNull()).alias(v) for v in VECTORS.values()],
        ))
        return F.filter(pairs, lambda p: _may_fire(p.getField, {n: p[v] for n, v in VECTORS.items()}, config))

    def cosines(p: Column) -> Column:
        fires = _fires(p.getField, config)
        side = lambda at: lambda n: F.get("norms" if n in VECTORS else "rs", at)[n]
        alike = _cosines(side(p["l_at"]), side(p["r_at"]))
        return F.struct(*[p[c].alias(c) for c in (*ids, "same")], *[F.when(~(fires[0] | fires[1]), v).alias(n) for n, v in alike.items()])

    # Norms are needed only in documents with a pair whose cosines count, there once a record. Each cosine and the blend are fields of their own: they are read several times.
    docs = docs.withColumn("rs", F.transform("rs", lambda r, k: r.withField("at", k)))
    docs = docs.withColumn("p", F.when(F.col("doc_id").isNotNull() & (F.size("rs") > 1), F.flatten(F.transform("rs", of))))
    weak = F.exists("p", lambda p: ~(_fires(p.getField, config)[0] | _fires(p.getField, config)[1]))
    docs = docs.withColumn("norms", F.when(weak, F.transform("rs", lambda r: F.struct(*[S.fused_dot(r[v], r[v]).alias(n) for n, v in VECTORS.items()]))))
    blended = F.transform(F.transform("p", cosines), lambda p: F.struct(*[p[c].alias(c) for c in ids], _blend(p.getField, config).alias("blend")))
    found = F.filter(F.transform(blended, lambda p: _edge(p.getField, *_tiered(p.getField, p["blend"], config))), lambda e: e["tier"].isNotNull())
    return docs.select("doc_id", "rs", F.when(F.size("p") > 0, F.array_sort(found)).alias("e"))


def _documents(entries: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """(doc_id, rs): each document's records in one array."""
    record = F.struct(*dict.fromkeys((*EDGE_FIELDS, *keep)), _set_size().alias("n_compounds"))
    return entries.groupBy("doc_id").agg(F.collect_list(record).alias("rs"))


def edges(entries: DataFrame, config: S.MatchConfig = S.MatchConfig()) -> DataFrame:
    """Every pair of different labels of a document that fires at some tier: the strongest, with its own score."""
    found = _with_edges(_documents(entries), config).select("doc_id", F.explode("e").alias("e"))
    return found.select("doc_id", "e.l_ord", "e.r_ord", "e.l_label", "e.r_label", "e.tier", (-F.col("e.weak")).alias("score"))


def cluster(entries: DataFrame, config: S.MatchConfig = S.MatchConfig(), keep: Iterable[str] = ()) -> DataFrame:
    """(doc_id, ord, label, cluster_id, match_tier) and the fields to ``keep``; a record that fires nothing is its own cluster with tier NULL.

    A document's records are brought together once; its pairs are made, tested and folded there, without a join.
    """
    keep = list(keep)
    docs = _with_edges(_documents(entries, keep), config)
    docs = docs.select("doc_id", "rs", F.when(F.size("e") > 0, _linked(F.col("e"))).alias("gs"))
    docs = docs.select("doc_id", "rs", F.transform("gs", lambda g: F.struct(g["ords"].alias("ords"), F.array_min(g["ords"]).alias("id"), g["tier"].alias("tier"))).alias("gs"))
    rows = docs.select("doc_id", "gs", F.explode("rs").alias("r"))
    rows = rows.withColumn("g", F.when(F.col("gs").isNotNull(), F.get(F.filter("gs", lambda g: F.array_contains(g["ords"], F.col("r")["ord"])), 0)))
    return rows.select("doc_id", "r.ord", "r.label", F.coalesce("g.id", "r.ord").alias("cluster_id"), _tier_name(F.col("g")["tier"]).alias("match_tier"), *[F.col("r")[c].alias(c) for c in keep])


def sweep(entries: DataFrame, field: str, values: list[float], base: S.MatchConfig = S.MatchConfig()) -> DataFrame:
    """Cluster diagnostics for each value of one threshold, with the change of the cluster count from value to value.

    Pairs are scored once, unless the values are weights of the score itself.
    """
    n_labels = entries.select("label").distinct().count()
    scored = None if field.startswith("w_") else stage(edge_scores(entries, base), "edge-scores")
    out = None
    for value in values:
        config = replace(base, **{field: value})
        found = _named(entries, fired(edge_scores(entries, config) if scored is None else scored, config))
        found = found.groupBy("doc_id", "cluster_id").agg(F.count(F.lit(1)).alias("size"), F.first("match_tier").alias("tier"))
        row = found.agg(
            F.lit(float(value)).alias("tau"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("size") > 1).alias("multi"), F.count_if(F.col("size") == 1).alias("singletons"),
            F.count_if(F.col("size") == n_labels).alias("full"), F.count_if(F.col("size") >= -(-n_labels // 2)).alias("majority"), F.avg("size").alias("mean_size"),
            *[F.count_if(F.col("tier") == t).alias(t) for t in TIER_ORDER],
        )
        out = row if out is None else out.unionAll(row)
    return out.withColumn("delta", F.col("clusters") - F.lag("clusters").over(Window.orderBy("tau")))


def line_join(records: DataFrame, steps: DataFrame, ascii_only: bool = False) -> DataFrame:
    """Left join of records to steps by (section, step_index), then by (section, folded step label); the first step of a key counts.

    An index hit without lines blocks the fallback: the record then has no lines.
    """
    steps = steps.withColumn("section", blank_to_null(F.col("section_label"))).filter("section is not null")
    lines = F.struct("start_line", "end_line")
    by_index = steps.filter("step_index is not null").groupBy("doc_id", "label", "section", F.col("step_index").alias("k")).agg(F.min_by(lines, "pos").alias("hit_index"))
    folded = steps.withColumn("k2", step_label(F.col("step_label"), ascii_only)).filter("k2 is not null")
    by_label = folded.groupBy("doc_id", "label", "section", "k2").agg(F.min_by(lines, "pos").alias("hit_label"))
    r = records.withColumn("section", blank_to_null(F.col("section_label"))).withColumn("k", F.col("step_index")).withColumn("k2", step_label(F.col("step_label"), ascii_only))
    r = r.join(by_index, ["doc_id", "label", "section", "k"], "left").join(by_label, ["doc_id", "label", "section", "k2"], "left")
    hit = F.coalesce("hit_index", "hit_label")
    known = hit["start_line"].isNotNull() & hit["end_line"].isNotNull()
    kind = F.when(F.col("hit_index").isNotNull(), "exact_index").otherwise("exact_label")
    return r.select(
        *records.columns, F.when(known, hit["start_line"]).alias("start_line"), F.when(known, hit["end_line"]).alias("end_line"), F.when(known, kind).alias("line_join")
    )


def join_coverage(joined: DataFrame) -> DataFrame:
    """Per label how many records have lines, by which key, and how many have none."""
    return joined.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("line_join") == "exact_index").alias("by_index"),
        F.count_if(F.col("line_join") == "exact_label").alias("by_label"), F.count_if(F.col("line_join").isNull()).alias("orphans"),
    )


def with_diagnostic(entries: DataFrame) -> DataFrame:
    return entries.withColumn("diagnostic", diagnostic_label(F.col("section_label"), F.col("step_label")))


def row_label(e: dict[str, Column]) -> Column:
    """What a record is called: id, section and step, product, or its shortened structure."""
    t = {k: blank_to_null(v) for k, v in e.items()}
    short = F.when(F.length(t["product_smiles"]) <= 48, t["product_smiles"]).otherwise(F.concat(F.substring(t["product_smiles"], 1, 45), F.lit("...")))
    both = F.when(t["section_label"].isNotNull() & t["step_label"].isNotNull(), F.concat(t["section_label"], F.lit(" | "), t["step_label"]))
    return F.coalesce(t["reaction_id"], both, t["section_label"], t["step_label"], t["product_name"], short, F.lit("(unnamed reaction)"))


def product_display(name: Column, smiles: Column) -> Column:
    """What a record's product is called: its name, else its shortened structure."""
    structure = blank_to_null(smiles)
    return F.coalesce(blank_to_null(name), F.when(F.length(structure) <= 40, structure).otherwise(F.concat(F.substring(structure, 1, 37), F.lit("..."))))


def reaction_key(product: Column, reactants: Column) -> Column:
    """product<<reactants, of canonical structures, sorted; NULL without a product or reactants."""
    have = F.filter(F.transform(reactants, blank_to_null), lambda x: x.isNotNull())
    return F.when(F.size(have) > 0, F.concat(blank_to_null(product), F.lit("<<"), F.array_join(F.array_sort(have), "|")))


def representatives(clustered: DataFrame) -> DataFrame:
    """One record per cluster and label: the longest ``row_label``, then the longest product name, then the first."""
    best = F.struct(F.length("row_label"), F.length(F.coalesce("product_name", F.lit(""))), -F.col("ord"))
    return clustered.groupBy("doc_id", "cluster_id", "label").agg(F.max_by("ord", best).alias("ord"), F.max_by("row_label", best).alias("row_label"))


def consensus_order(clustered: DataFrame) -> DataFrame:
    """Each document's clusters in order: most labels first, then the smallest name, then the labels, then the id (``clustered(doc_id, cluster_id, label, name)``)."""
    sized = clustered.groupBy("doc_id", "cluster_id").agg(F.array_sort(F.collect_set("label")).alias("labels"), F.min(F.coalesce("name", F.lit(""))).alias("name"))
    sized = sized.select("doc_id", "cluster_id", F.array_join("labels", ",").alias("membership"), F.size("labels").cast("long").alias("size"), "name")
    return sized.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size"), "name", "membership", "cluster_id")))
