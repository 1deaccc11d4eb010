import random

import pytest
from pyspark.sql import functions as F

from crosswise.functions import text
from crosswise.functions.scores import MatchConfig
from crosswise.operators import enrich, entities, lines, metrics, reactions, reports
from crosswise.operators.components import connected_components


def roots_of(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(60))
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: found.get(n, n) for n in nodes} == roots_of(edges, nodes)


def test_chain_and_empty_components(spark):
    chain = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") - 1).alias("v"))
    assert {r.root for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.filter("u < 0")).count() == 0


def test_paint_last_wins_and_clamps(spark):
    s = spark.createDataFrame([("d", "m", 0, "a", "x", -3, 2), ("d", "m", 1, "b", "y", 2, 9), ("d", "m", 2, "c", "z", 5, 4)], "doc_id string, label string, ord int, section_type string, section_label string, start_line int, end_line int")
    assert sorted((r.line, r.line_type) for r in lines.paint(s, 4).collect()) == [(1, "a"), (2, "b"), (3, "b"), (4, "b")]
    assert lines.reference_label(["x", "Claude"]) == "Claude" and lines.reference_label(["x", "y"]) == "x"
    with pytest.raises(ValueError):
        lines.reference_label(["x"], "z")


def entry(ord, label, identifier, inchi=None, smiles=None, formula=None, names=None):
    return ord, "d", label, identifier, inchi, smiles, formula, names or [identifier.lower()]


ENTRY = "ord long, doc_id string, label string, identifier string, inchi_key string, smiles string, molecular_formula string, names array<string>"


def test_weakest_tier_and_counts(spark):
    e = spark.createDataFrame([entry(0, "A", "one", inchi="K"), entry(1, "B", "two", inchi="K", names=["shared"]), entry(2, "C", "three", names=["shared"]), entry(3, "C", "alone"), entry(4, "C", "Alone")], ENTRY)
    got = {r.ord: (r.cluster_id, r.match_tier) for r in entities.resolve(e).collect()}
    assert got == {0: (0, "name"), 1: (0, "name"), 2: (0, "name"), 3: (3, "name"), 4: (3, "name")}
    m = entities.members(e, entities.resolve(e))
    assert {r.label: (r.raw, r.deduped, r.only) for r in entities.label_counts(e, m).collect()} == {"A": (1, 1, 0), "B": (1, 1, 0), "C": (3, 2, 1)}
    assert {r.label: (r.common, r.baseline_only, r.other_only, r.recall) for r in entities.pairwise_metrics(m, "C").collect()} == {"A": (1, 1, 0, 0.5), "B": (1, 1, 0, 0.5)}
    assert "matched_pairs" in reports.diff_json(m, "A", "C").first().json


@pytest.mark.parametrize("values, tie, want", [
    (["a", "A", "b"], None, "a"), (["a", "b"], "b", "b"), (["b", "a"], "z", "a"), ([None, "", "a"], None, None), (["a", None], "", None), (["x"], None, "x"), (["B", "b", None, None], "b", "B"),
])
def test_majority(spark, values, tie, want):
    votes = spark.createDataFrame([(0, k, v) for k, v in enumerate(values)], "key int, ord int, value string")
    ties = spark.createDataFrame([(0, tie)], "key int, tie string")
    assert metrics.majority(votes, ["key"], tiebreak=ties).first().winner == want


def test_presence_and_rank(spark):
    grid = spark.createDataFrame([("Claude", True, True), ("Claude", False, True), ("Claude", True, False), ("GPT", True, True), ("GPT", True, True), ("GPT", False, False)], "label string, present boolean, baseline boolean")
    assert {r.label: (r.precision, r.recall, r.f1) for r in metrics.presence_stats(grid).collect()} == {"Claude": (0.5, 0.5, 0.5), "GPT": (1.0, 1.0, 1.0)}
    stats = spark.createDataFrame([("A", 0.5, None), ("B", 0.9, float("nan")), ("C", 0.9, None), ("D", None, None)], "label string, f1 double, role double")
    got = {r.label: r["rank"] for r in metrics.ranked(stats, {"f1": 1.0, "role": 1.0}, ["f1", "role"]).collect()}
    assert got == {"B": 1, "C": 1, "A": 3, "D": 4}
    assert metrics.ranked(stats, {"f1": 0.0, "role": 0.0}, ["f1"]).filter("label = 'A'").first().composite == 0.5


def test_grid_edits(spark):
    rows = spark.createDataFrame([("Ethanol", 1), ("WATER", 2), ("acetone", 3)], "key string, n int")
    gone = spark.createDataFrame([("Acetone",), ("water",)], "key string")
    assert [r.key for r in metrics.drop_rows(rows, gone, "key").collect()] == ["Ethanol"]
    presence = spark.createDataFrame([("ethanol", True), ("acetone", False)], "key string, baseline boolean")
    assert [r.key for r in metrics.keep_confirmed(rows, presence, "key").collect()] == ["Ethanol"]
    options = spark.createDataFrame([("Reagent", 0), ("solvent", 1), ("reagent", 2), ("catalyst", 3), (" ", 4)], "v string, ord int")
    assert [r.shown for r in metrics.field_options(options, "v", "ord").orderBy("rank").collect()] == ["(none)", "catalyst", "Reagent", "solvent"]


def record(ord, label, start=None, end=None, name=None, smiles=()):
    return 0, ord, label, name, start, end, list(smiles), None, None


RECORD = "doc_id int, ord long, label string, name string, start_line int, end_line int, compound_smiles array<string>, procedure_vector array<double>, reaction_vector array<double>"


def clusters(spark, rows, config=MatchConfig()):
    found = reactions.cluster(spark.createDataFrame(rows, RECORD), config).collect()
    out = {}
    for r in found:
        out.setdefault(r.cluster_id, []).append(r.ord)
    return sorted(map(sorted, out.values())), {r.match_tier for r in found}


def test_single_linkage_chain(spark):
    rows = [record(0, "M1", 0, 10), record(1, "M2", 5, 15), record(2, "M3", 12, 25)]
    assert clusters(spark, rows, MatchConfig(tau_provenance=0.15, enable_combined=False)) == ([[0, 1, 2]], {"provenance"})


def test_one_per_label_and_jaccard(spark):
    rows = [record(0, "C", smiles="abcd"), record(1, "C", smiles="abcd"), record(2, "G", smiles="abcd")]
    assert clusters(spark, rows)[0] == [[0, 2], [1]]
    six = [record(0, "A", smiles="abcde"), record(1, "B", smiles="abcdf")]
    assert clusters(spark, six, MatchConfig(tau_jaccard=0.60, enable_combined=False))[0] == [[0, 1]]
    assert clusters(spark, six, MatchConfig(enable_combined=False))[0] == [[0], [1]]
    off = MatchConfig(enable_provenance=False, enable_compound_jaccard=False, enable_combined=False)
    assert clusters(spark, rows, off)[0] == [[0], [1], [2]]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_assignment(spark, seed):
    rng = random.Random(seed)
    pairs = [(0, b, c, rng.choice([0.5, 0.6, 0.6, 0.7, 0.9])) for b in range(6) for c in range(5) if rng.random() < 0.7]
    used_b, used_c, want = set(), set(), set()
    for _, b, c, s in sorted(pairs, key=lambda p: (-p[3], p[2], p[1])):
        if s >= 0.55 and b not in used_b and c not in used_c:
            used_b.add(b)
            used_c.add(c)
            want.add((b, c))
    df = spark.createDataFrame(pairs, "doc_id int, b_ord long, c_ord long, composite double")
    assert {(r.b_ord, r.c_ord) for r in reactions.assign(df).collect()} == want


def test_line_join(spark):
    steps = spark.createDataFrame([("d", "m", "S", 1, "Step_A", 50, 60, 0), ("d", "m", "S", 1, "x", 1, 2, 1), ("d", "m", "S", 2, "B", None, 9, 2), ("d", "m", "S", 7, "c d", 100, 110, 3)], "doc_id string, label string, section_label string, step_index int, step_label string, start_line int, end_line int, pos int")
    asks = spark.createDataFrame([("d", "m", 0, " S ", 1, "zz"), ("d", "m", 1, "S", 99, "C_D"), ("d", "m", 2, "S", 2, "c d"), ("d", "m", 3, "s", 1, "c d"), ("d", "m", 4, None, 1, "c d")], "doc_id string, label string, ord int, section_label string, step_index int, step_label string")
    got = {r.ord: (r.start_line, r.end_line, r.line_join) for r in reactions.line_join(asks, steps).collect()}
    none = (None, None, None)
    assert got == {0: (50, 60, "exact_index"), 1: (100, 110, "exact_label"), 2: none, 3: none, 4: none}


def test_enrichment_ladder(spark):
    schema = "doc_id int, ord long, label string, product_smiles string, product_name string, reactant_smiles array<string>, reactant_names array<string>, compounds array<struct<smiles:string,name:string,role:string,is_product:boolean>>"
    rows = [
        (0, 0, "m", "CCO ", "ethanol", [], ["base x"], [("CC", None, "solvent", False), ("CN", None, "Reagent", False)]),
        (0, 1, "m", None, None, [], [], [(None, "water", None, True)]),
        (0, 2, "m", None, "Hal", [], [], None),
    ]
    names = {"base x": "BX", "water": "O", "Hal": "bad"}
    got = {r.ord: (r.product_smiles, r.compound_smiles) for r in enrich.with_structures(spark.createDataFrame(rows, schema), names.get).collect()}
    assert got == {0: ("CCO", ["BX", "CCO", "CN"]), 1: ("O", ["O"]), 2: (None, None)}
    v = enrich.embedded(spark.createDataFrame([("aspirin",), ("aspirin",), (" ",), (None,)], "t string"), "t", "v").collect()
    assert len(v) == 4 and sum(r.v is not None for r in v) == 2


def test_report_text(spark):
    df = spark.createDataFrame([("a", 0.123456, None)], "m string, x double, y double")
    text = reports.markdown("R", {"t": df})
    assert "| a | 0.1235 | — |" in text


def test_names_fold_fully(spark):
    rows = [(1, "a", "Straße", ["ﬁne", None]), (2, "b", "x", None)]
    entries = spark.createDataFrame(rows, "ord long, label string, identifier string, aliases array<string>")
    assert {r.ord: r.names for r in entities.name_pool(entries).collect()} == {1: ["fine", "straße"], 2: ["x"]}
    grid = spark.createDataFrame([("m", "STRASSE", "straße"), ("m", "a", "b"), ("m", None, "b"), ("m", "q", None)], "label string, value string, baseline string")
    got = metrics.field_accuracy(grid).first()
    assert (got.n, got.hits) == (3, 1)
    keys = spark.createDataFrame([("STRASSE",), ("y",)], "key string")
    assert [r.key for r in metrics.drop_rows(keys, spark.createDataFrame([("straße",)], "key string"), "key").collect()] == ["y"]
    assert [r.key for r in metrics.keep_confirmed(keys, spark.createDataFrame([("straße", True)], "key string, baseline boolean"), "key").collect()] == ["STRASSE"]


def test_clusters_by_consensus_and_grid(spark):
    rows = [(1, "a", "Zeta"), (1, "b", "zeta-"), (2, "a", "Beta"), (3, "b", "alpha"), (4, "a", "n"), (4, "b", "m")]
    made = spark.createDataFrame(rows, "cluster_id long, label string, identifier string").selectExpr("*", "lower(identifier) AS canonical", "'name' AS match_tier")
    assert [r.cluster_id for r in entities.by_consensus(entities.cluster_table(made)).collect()] == [4, 1, 3, 2]
    grid = {r.cluster_id: r for r in entities.cluster_grid(made, ["b", "a", "c"]).collect()}
    assert (grid[1].membership, grid[1].size, grid[1].b, grid[1].a, grid[1].c) == ("a, b", 2, "zeta-", "Zeta", "") and len(grid) == 4
    assert {r.cluster_id for r in entities.cluster_grid(made, ["a"], 2).collect()} == {1, 4}


def test_labels_displays_and_keys(spark):
    base = {k: None for k in ("reaction_id", "section_label", "step_label", "product_name", "product_smiles")}
    cases = [({}, "(unnamed reaction)"), ({"reaction_id": " r "}, "r"), ({"section_label": "S", "step_label": "T"}, "S | T"), ({"step_label": "T"}, "T"), ({"product_name": " p "}, "p"), ({"product_smiles": "C" * 49}, "C" * 45 + "...")]
    df = spark.createDataFrame([(k, *{**base, **c}.values()) for k, (c, _) in enumerate(cases)], "k int, " + ", ".join(f"{c} string" for c in base))
    got = df.orderBy("k").select(reactions.row_label({c: F.col(c) for c in base}).alias("x"), reactions.product_display(F.col("product_name"), F.col("product_smiles")).alias("p")).collect()
    assert [r.x for r in got] == [w for _, w in cases] and [r.p for r in got] == [None, None, None, None, "p", "C" * 37 + "..."]
    keys = spark.createDataFrame([("P", ["b", None, " ", "a"]), (None, ["a"]), ("P", [])], "p string, r array<string>").select(reactions.reaction_key(F.col("p"), F.col("r")).alias("k"))
    assert [r.k for r in keys.collect()] == ["P<<a|b", None, None]


def test_edits_win_over_the_seed(spark):
    grid = spark.createDataFrame([(1, "a", True), (1, "b", False)], "c int, label string, present boolean")
    edits = spark.createDataFrame([(1, "b", True), (2, "a", False)], "c int, label string, present boolean")
    assert sorted(tuple(r) for r in metrics.apply_edits(grid, edits, ["c", "label"], "present").select("c", "label", "present").collect()) == [(1, "a", True), (1, "b", True)]


def test_colours_take_the_whole_digest(spark):
    import hashlib

    df = spark.createDataFrame([("Red",), ("(none)",), (" ",), (None,)], "v string")
    for palette in (8, 7):
        got = [r.i for r in df.select(text.colour_index(F.col("v"), palette).alias("i")).collect()]
        assert got == [int(hashlib.md5(b"red").hexdigest(), 16) % palette, None, None, None]


@pytest.mark.parametrize("seed", range(3))
def test_covered_lines_give_the_scores_and_regions_of_all_lines(spark, seed):
    """The forms without uncovered lines equal the plain ones; documents have good lines, gaps, runs outside the lines, and no reference."""
    rng, total = random.Random(seed), 12
    made = [
        (doc, label, k * 100 + j, rng.choice("xy") if doc % 3 else "x", rng.choice("pq"), at, at + rng.randrange(5))
        for doc in range(12) for k, label in enumerate(("ref", "m", "n")) if rng.random() < 0.8 for j in range(rng.randrange(1, 9)) for at in (rng.randrange(-2, 15),)
    ] + [(50, "m", 1, "x", "p", 40, 41), (51, "ref", 1, "x", "p", 1, 12), (51, "m", 1, "x", "p", 3, 12), (52, "ref", 1, "x", "p", 1, 12), (52, "m", 1, "x", "p", 1, 10)]
    s = spark.createDataFrame(made, "doc_id long, label string, ord int, section_type string, section_label string, start_line int, end_line int")
    similar = spark.createDataFrame([("p", "p", 1.0), ("p", "q", -0.5), ("q", "p", 0.3), ("q", "q", 0.9)], "a string, b string, sim double")
    scores = lines.line_scores(lines.paint(s, total), s.select("doc_id", "label").distinct(), total, "ref", similar)
    beside = lines.beside_reference(s, total, "ref")
    cell = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v
    rows = lambda df: sorted(tuple(map(cell, r)) for r in df.collect())
    assert rows(lines.covered_scores(beside, total, similar)) == rows(lines.run_scores(scores))
    regions = lines.flag_regions(scores, 0.2)
    assert rows(lines.covered_regions(beside, total, 0.2, similar)) == rows(regions) and regions.count() > 12


def test_uncovered_lines_are_not_made(spark):
    """Lines are neither filled up to the document's length nor shuffled: sections are dealt once."""
    s = spark.createDataFrame([(1, "ref", 0, "x", "p", 1, 2), (1, "m", 0, "x", "p", 2, 3)], "doc_id long, label string, ord int, section_type string, section_label string, start_line int, end_line int")
    plan = lines.covered_regions(lines.beside_reference(s, 100000, "ref"), 100000, 0.2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and lines.paint(s, 9)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_a_pair_of_records_has_each_cosine_once(spark):
    """The blend reads a cosine several times; it is computed once for each vector."""
    kinds = "doc_id long, ord long, label string, name string, start_line int, end_line int, compound_smiles array<string>, procedure_vector array<double>, reaction_vector array<double>"
    r = spark.createDataFrame([(1, 1, "a", "n", 1, 2, ["x"], [1.0, 0.5], None), (1, 2, "b", "n", 1, 2, ["x"], [1.0, 0.5], None)], kinds)
    scored = reactions.edge_scores(r)
    assert scored._jdf.queryExecution().optimizedPlan().toString().lower().count("sqrt(") == 2
    assert [(e.overlap, e.sets, round(e.blend, 9)) for e in scored.collect()] == [(1.0, 1.0, 1.0)]


KINDS = "doc_id long, ord long, label string, name string, start_line int, end_line int, compound_smiles array<string>, procedure_vector array<double>, reaction_vector array<double>"


@pytest.mark.parametrize("seed", range(3))
def test_clusters_within_documents_equal_those_of_scored_pairs(spark, seed):
    """Pairs that can't fire are left out before their cosines; the edges and clusters are those of all scored pairs."""
    rng = random.Random(seed)
    vector = lambda: rng.choice([None, [], [1.0, 0.5], [0.5, 1.0], [0.1, 0.7], [0.0, 0.0], [1.0]])
    span = lambda: rng.choice([(None, None), (1, 4), (2, 5), (4, 2), (3, 9)])
    made = [
        (rng.choice([None, doc, doc]), k, rng.choice("abcd"), rng.choice(["n", "m", None]), *span(), rng.choice([None, [], ["x"], ["x", "y"], ["x", "x", "z"]]), vector(), vector())
        for doc in range(25) for k in range(rng.randrange(1, 9))
    ]
    r = spark.createDataFrame(made, KINDS)
    rows = lambda df, *names: sorted(map(repr, df.select(*names).collect()))
    for config in (MatchConfig(), MatchConfig(tau_combined=0.0, tau_provenance=0.9), MatchConfig(enable_provenance=False, enable_combined=False), MatchConfig(w_compound=-0.25, enable_compound_jaccard=False)):
        scored = reactions.fired(reactions.edge_scores(r, config), config)
        assert rows(reactions.edges(r, config), *scored.columns) == rows(scored, *scored.columns)
        names = ("doc_id", "ord", "label", "cluster_id", "match_tier")
        assert rows(reactions.cluster(r, config), *names) == rows(reactions._named(r, scored), *names)


def test_records_are_brought_together_once(spark):
    """Clusters and their order take one shuffle, by document: no self-join, no joining back."""
    r = spark.createDataFrame([(1, 1, "a", "n", 1, 2, ["x"], [1.0], None), (1, 2, "b", "m", 1, 2, ["x"], [1.0], None)], KINDS)
    ordered = reactions.consensus_order(reactions.cluster(r, keep=["name"]))
    assert ordered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(x.cluster_id, x.membership, x.size, x.name, x.place) for x in ordered.collect()] == [(1, "a,b", 2, "m", 1)]


def test_atmospheres_are_read_once_a_record(spark):
    """What a record's atmosphere means is settled before the join, not for each pair and test."""
    kinds = "doc_id long, ord long, name string, smiles string, reactant_smiles array<string>, reactant_names array<string>, procedure_vector array<double>, yield_pct double, temperature_c double, room_temperature boolean, time_h double, atmosphere string, reaction_class string, diagnostic string"
    row = lambda o, gas: (1, o, "n", "s", ["x"], ["y"], [1.0], 1.0, None, None, None, gas, "c", "d")
    gases = [" ARGON ", "ar", "Nitrogen", "n2", "air ", "H2", "hydrogen gas", "NH3", "Vacuum", "steam", " ", None]
    pairs = reactions.pair_scores(spark.createDataFrame([row(0, "N2")], kinds), spark.createDataFrame([row(k, g) for k, g in enumerate(gases)], kinds))
    assert [r.axis_conditions for r in pairs.orderBy("c_ord").collect()] == [1.0] * 4 + [0.0] * 5 + [None] * 3
    scored = pairs.select("axis_conditions")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in scored.split("Join")[0] and "regexp_replace" in scored


def test_each_structure_is_canonicalised_once(spark, tmp_path):
    """However often a structure stands; records without candidates, repeated keys and missing keys keep their rows."""
    schema = "doc_id int, ord long, label string, product_smiles string, product_name string, reactant_smiles array<string>, reactant_names array<string>, compounds array<struct<smiles:string,name:string,role:string,is_product:boolean>>"
    log = tmp_path / "asked"

    def canonical(x):
        with open(log, "a") as out:
            out.write(f"{x}\n")
        return x.strip() if x else None

    rows = [(k, 0, "m", " CC ", None, ["CN"], [None], [("cat", None, "catalyst", False)]) for k in range(20)]
    rows += [(30, 0, "m", "CC", "n", None, None, None), (31, 0, "m", "CC", None, [], [], None), (31, 0, "p", None, None, ["CO"], [None], None), (None, 0, "m", " CC ", None, [], [], None)]
    got = enrich.with_structures(spark.createDataFrame(rows, schema), None, canonical)
    assert got.columns == ["doc_id", "ord", "label", "product_smiles", "product_name", "reactant_smiles", "reactant_names", "compounds", "compound_smiles"]
    found = sorted(((r.doc_id, r.label, r.product_smiles, r.compound_smiles) for r in got.collect()), key=repr)
    both = ["CC", "CO"]
    assert found == sorted([(k, "m", "CC", ["CC", "CN", "cat"]) for k in range(20)] + [(30, "m", "CC", None), (31, "m", "CC", both), (31, "p", "CC", both), (None, "m", " CC ", None)], key=repr)
    asked = log.read_text().splitlines()
    assert len(asked) == len(set(asked))


def test_places_are_those_of_the_lists(spark):
    """Places from the parallel sort equal the order in the one JSON text; clusters without a name come last; no task holds all clusters."""
    import json

    rng = random.Random(5)
    kinds = "cluster_id long, label string, canonical string, identifier string, ord long"
    made = [(k, label, rng.choice([None, "", "n", "m", "é", f"x{k % 7}"]), rng.choice("pqr"), 1000 * j + k) for k in range(60) for j, label in enumerate("AB") if rng.random() < 0.7]
    m = spark.createDataFrame(made, kinds)
    whole = json.loads(reports.diff_json(m, "A", "B").first().json)
    found = reports.diff_places(m, "A", "B")
    placed = {}
    for r in sorted(found.collect(), key=lambda r: (r.kind, r.place)):
        placed.setdefault(r.kind, []).append((r.place, r.b if r.kind == "second_only" else r.a))
    for kind, name, side in (("matched", "matched_pairs", "a"), ("first_only", "first_only", "a"), ("second_only", "second_only", "b")):
        assert placed[kind] == list(enumerate(x[side]["ord"] for x in whole[name]))
    names = {o: c for _, _, c, _, o in made}
    last = [names[o] is None for _, o in placed["first_only"]]
    assert any(last) and last == sorted(last)
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()


def test_long_keys_are_not_shuffled_whole(spark, monkeypatch):
    """Keys that are whole texts are compared by digest: equal ones link, others don't, and no staged key is long."""
    staged = {}
    monkeypatch.setattr(entities, "stage", lambda df, name, f=entities.stage: staged.setdefault(name, f(df, name)))
    long = "word " * 500
    e = spark.createDataFrame([entry(0, "A", "x", names=[long + "a"]), entry(1, "B", "y", names=[long + "a"]), entry(2, "C", "z", names=[long + "b"])], ENTRY)
    assert sorted((r.ord, r.cluster_id) for r in entities.resolve(e).collect()) == [(0, 0), (1, 0), (2, 2)]
    assert staged["tier-keys"].agg(F.max(F.length("key"))).first()[0] < 80
