"""The engine's queries over the sample tables, each with the SQL that defines its result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.functions import scores as S
from crosswise.functions import text as T
from crosswise.operators import entities, lines, metrics, reactions
from crosswise.plans import shapes
from crosswise.plans.registry import query
from crosswise.plans.shapes import REFERENCE, TOTAL_LINES, table
from crosswise.session import stage
from crosswise.sources import paths

THRESHOLD = 0.2


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# Line comparison


def _painted(spark, sf_dir):
    return lines.paint(shapes.sections(spark, sf_dir), TOTAL_LINES)


def _beside(spark, sf_dir):
    return lines.beside_reference(shapes.sections(spark, sf_dir), TOTAL_LINES, REFERENCE)


def _model_similarity(spark, sf_dir):
    return lines.pair_similarity(lines.met_labels(_beside(spark, sf_dir)), shapes.label_vectors(spark, sf_dir))


def _label_similarity(spark, sf_dir):
    return _model_similarity(spark, sf_dir).groupBy("a", "b").agg(F.avg("sim").alias("sim"))


def _compared(spark, sf_dir):
    """Covered lines and the similarity of the labels that meet on them; its table is written, so that its size is known before lines are joined to it."""
    return _beside(spark, sf_dir), stage(_label_similarity(spark, sf_dir), "similarity")


def _regions(spark, sf_dir):
    beside, similar = _compared(spark, sf_dir)
    return lines.covered_regions(beside, TOTAL_LINES, THRESHOLD, similar)


@query(f"WITH {shapes.PAINTED} SELECT * FROM painted")
def paint_lines(spark, sf_dir):
    return _painted(spark, sf_dir)


@query(f"WITH {shapes.SCORED} SELECT doc_id, label, count(*) FILTER (agree) AS n_agree, round(avg(agree::INT), 6) AS agreement FROM scores GROUP BY ALL")
def type_agreement(spark, sf_dir):
    return rounded(lines.covered_scores(_beside(spark, sf_dir), TOTAL_LINES).drop("mean_sim"), "agreement")


@query(f"WITH {shapes.SECTIONS} SELECT label, section_type, count(*) AS n FROM sections GROUP BY ALL")
def type_distribution(spark, sf_dir):
    return lines.type_distribution(shapes.sections(spark, sf_dir))


@query(f"WITH {shapes.SCORED} SELECT doc_id, label, count(*) FILTER (agree) AS n_agree, round(avg(agree::INT), 6) AS agreement, round(avg(sim), 6) AS mean_sim FROM scores GROUP BY ALL")
def run_scores(spark, sf_dir):
    beside, similar = _compared(spark, sf_dir)
    return rounded(lines.covered_scores(beside, TOTAL_LINES, similar), "agreement", "mean_sim")


@query(f"""WITH {shapes.SCORED}
SELECT DISTINCT s.a, s.b, round(s.sim, 6) AS sim
FROM painted p JOIN painted r ON p.doc_id = r.doc_id AND p.line = r.line AND r.label = '{REFERENCE}' AND p.label <> '{REFERENCE}'
JOIN alike s ON s.a = r.line_label AND s.b = p.line_label""")
def label_similarity(spark, sf_dir):
    return rounded(_label_similarity(spark, sf_dir), "sim")


@query(f"""WITH {shapes.SCORED},
met AS (SELECT DISTINCT r.line_label AS a, p.line_label AS b FROM painted p JOIN painted r ON p.doc_id = r.doc_id AND p.line = r.line AND r.label = '{REFERENCE}' AND p.label <> '{REFERENCE}')
SELECT a, b, x.model, round(list_dot_product(x.v, y.v), 6) AS sim FROM met JOIN vectors x ON x.label_text = a JOIN vectors y ON y.label_text = b AND y.model = x.model""")
def model_similarity(spark, sf_dir):
    return rounded(_model_similarity(spark, sf_dir), "sim")


FLAGGED = f"""{shapes.SCORED},
flagged AS (SELECT doc_id, line, bool_or(NOT agree) AS mismatch, bool_or(sim < {THRESHOLD}) AS low, min(sim) AS worst
            FROM scores GROUP BY ALL HAVING bool_or(NOT agree OR sim < {THRESHOLD})),
islands AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS island FROM flagged),
regions AS (SELECT doc_id, island, min(line)::INT AS start_line, max(line)::INT AS end_line, avg(worst) AS avg_sim,
                   CASE WHEN bool_or(mismatch) AND bool_or(low) THEN 'both' WHEN bool_or(mismatch) THEN 'type_mismatch' ELSE 'low_similarity' END AS issue_kind
            FROM islands GROUP BY ALL)"""


@query(f"""WITH {FLAGGED},
models AS (SELECT i.doc_id, i.island, string_agg(DISTINCT s.label, ',' ORDER BY s.label) AS disagreeing
           FROM islands i JOIN scores s USING (doc_id, line) WHERE NOT s.agree OR s.sim < {THRESHOLD} GROUP BY ALL)
SELECT doc_id, start_line, end_line, round(avg_sim, 6) AS avg_sim, issue_kind, disagreeing FROM regions JOIN models USING (doc_id, island)""")
def flag_regions(spark, sf_dir):
    return rounded(_regions(spark, sf_dir), "avg_sim")


@query(f"""WITH {FLAGGED},
inside AS (SELECT p.doc_id, r.start_line, p.label, p.line_type, count(*) AS n, min(p.line) AS first
           FROM painted p JOIN regions r ON p.doc_id = r.doc_id AND p.line BETWEEN r.start_line AND r.end_line GROUP BY ALL)
SELECT doc_id, start_line, label, arg_max(line_type, (n, -first)) AS dominant FROM inside GROUP BY doc_id, start_line, label""")
def region_dominant(spark, sf_dir):
    return lines.dominant_values(_painted(spark, sf_dir), _regions(spark, sf_dir))


@query("SELECT doc_id, len(string_split(text, chr(10))) AS n_lines FROM documents")
def line_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.line_count(F.col("text")).cast("long").alias("n_lines"))


# Entity resolution


def _resolved(spark, sf_dir):
    entries = shapes.entities(spark, sf_dir)
    return entries, entities.resolve(entries)


def _members(spark, sf_dir):
    entries, clusters = _resolved(spark, sf_dir)
    return entries, entities.members(entries, clusters, True)


@query(f"WITH {shapes.CLUSTERS} SELECT ord, cluster_id, match_tier FROM clusters")
def entity_clusters(spark, sf_dir):
    return _resolved(spark, sf_dir)[1]


@query(f"""WITH {shapes.CLUSTERS}
SELECT cluster_id, label, count(*) AS entries, any_value(match_tier) AS match_tier, arg_min(ord, (-length(identifier), ord)) AS ord,
       length(arg_min(identifier, (-length(identifier), ord))) AS n FROM clusters GROUP BY cluster_id, label""")
def entity_representatives(spark, sf_dir):
    return _members(spark, sf_dir)[1].withColumn("n", F.length("identifier").cast("long")).drop("canonical", "identifier")


@query(f"""WITH {shapes.CLUSTERS} SELECT cluster_id, string_agg(label, ',' ORDER BY label) AS membership, count(*) AS size, any_value(match_tier) AS match_tier
FROM members GROUP BY cluster_id""")
def cluster_table(spark, sf_dir):
    return entities.cluster_table(_members(spark, sf_dir)[1]).drop("name")


@query(f"""WITH {shapes.CLUSTERS}, sized AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS size FROM members),
own AS (SELECT label, count(*) AS deduped, count(*) FILTER (size = 1) AS "only" FROM sized GROUP BY label)
SELECT label, (SELECT count(*) FROM entries e WHERE e.label = own.label) AS raw, deduped, "only" FROM own""")
def label_counts(spark, sf_dir):
    return entities.label_counts(*_members(spark, sf_dir))


@query(f"""WITH {shapes.CLUSTERS}, base AS (SELECT cluster_id FROM members WHERE label = 'src0'), n AS (SELECT count(*) AS k FROM base),
c AS (SELECT label, count(*) FILTER (cluster_id IN (SELECT cluster_id FROM base)) AS common, count(*) AS total FROM members WHERE label <> 'src0' GROUP BY label)
SELECT label, common, k - common AS baseline_only, total - common AS other_only, round(common / k, 6) AS recall, round(common / total, 6) AS precision FROM c, n""")
def pairwise_metrics(spark, sf_dir):
    return rounded(entities.pairwise_metrics(_members(spark, sf_dir)[1], "src0"), "recall", "precision")


@query(f"""WITH {shapes.CLUSTERS}, t AS (SELECT string_agg(label, ',' ORDER BY label) AS membership FROM members GROUP BY cluster_id)
SELECT membership, count(*) AS n FROM t GROUP BY membership""")
def upset_intersections(spark, sf_dir):
    return entities.upset(entities.cluster_table(_members(spark, sf_dir)[1]))


@query(f"""WITH {shapes.CLUSTERS}, t AS (SELECT cluster_id, bool_or(label = 'src0') AS a, bool_or(label = 'src1') AS b FROM members GROUP BY cluster_id)
SELECT cluster_id, CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' ELSE 'second_only' END AS kind FROM t WHERE a OR b""")
def two_way_diff(spark, sf_dir):
    return entities.matched_pairs(_members(spark, sf_dir)[1], "src0", "src1").select("cluster_id", "kind")


@query(f"WITH {shapes.CLUSTERS}, s AS (SELECT cluster_id FROM members GROUP BY cluster_id HAVING count(*) = 1) SELECT cluster_id, label FROM members JOIN s USING (cluster_id)")
def only_entries(spark, sf_dir):
    return entities.only_entries(_members(spark, sf_dir)[1]).select("cluster_id", "label")


_SIDES = ("src0", "src1", "src2")
_OWN = ", ".join(f"coalesce(length(any_value(n) FILTER (label = '{x}')), 0) AS {x}" for x in _SIDES)


@query(f"""WITH {shapes.CLUSTERS}, picked AS (SELECT cluster_id, label, arg_min(identifier, (-length(identifier), ord)) AS n FROM clusters GROUP BY ALL)
SELECT cluster_id, string_agg(label, ', ' ORDER BY label) AS membership, count(*) AS size, {_OWN} FROM picked GROUP BY cluster_id HAVING count(*) >= 2""")
def cluster_grid(spark, sf_dir):
    grid = entities.cluster_grid(_members(spark, sf_dir)[1], list(_SIDES), 2)
    return grid.select("cluster_id", "membership", "size", *[F.length(x).alias(x) for x in _SIDES])


@query(f"""WITH {shapes.CLUSTERS}, t AS (SELECT cluster_id, string_agg(label, ',' ORDER BY label) AS m, bool_or(label = 'src3') AS has FROM members GROUP BY cluster_id)
SELECT 'exactly' AS kind, cluster_id FROM t WHERE m = 'src1,src2' UNION ALL SELECT 'containing', cluster_id FROM t WHERE has""")
def cluster_selectors(spark, sf_dir):
    found = _members(spark, sf_dir)[1]
    pick = lambda kind, df: df.select(F.lit(kind).alias("kind"), "cluster_id")
    return pick("exactly", entities.with_members(found, ["src2", "src1"])).unionAll(pick("containing", entities.containing(found, "src3")))


@query("SELECT source AS label, CASE WHEN doc_id % 7 = 0 THEN 'x' END AS identifier_type, count(*) AS n FROM documents GROUP BY ALL")
def identifier_types(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("label"), F.when(F.col("doc_id") % 7 == 0, "x").alias("identifier_type"))
    return entities.identifier_types(docs)


# Adjudication and metrics


VOTES = f"""{shapes.CELLS},
folds AS (SELECT cluster_id, lower(flag) AS fold, count(*) AS n, arg_min(flag, ord) AS shown FROM cells GROUP BY ALL),
ties AS (SELECT cluster_id, lower(arg_min(flag, ord)) AS tie FROM cells WHERE label = 'm0' GROUP BY ALL),
won AS (SELECT cluster_id, arg_min(shown, (-n, coalesce(fold <> tie, true)::INT, fold)) AS winner FROM folds LEFT JOIN ties USING (cluster_id) GROUP BY cluster_id)"""


def _winners(spark, sf_dir):
    cells = shapes.cells(spark, sf_dir)
    tie = cells.filter("label = 'm0'").groupBy("cluster_id").agg(F.min_by("flag", "ord").alias("tie"))
    return cells, metrics.majority(cells, ["cluster_id"], "flag", "ord", tie, ascii_only=True)


@query(f"WITH {VOTES} SELECT * FROM won")
def majority_vote(spark, sf_dir):
    return _winners(spark, sf_dir)[1]


GRID = f"""{shapes.CELLS},
labels AS (SELECT DISTINCT label FROM cells), have AS (SELECT DISTINCT cluster_id, label FROM cells),
per AS (SELECT cluster_id, count(*) AS k, bool_or(label = 'm0') AS tie FROM have GROUP BY ALL),
base AS (SELECT cluster_id, CASE WHEN k * 2 = (SELECT count(*) FROM labels) THEN tie ELSE k * 2 > (SELECT count(*) FROM labels) END AS baseline FROM per),
grid AS (SELECT b.cluster_id, l.label, baseline, h.label IS NOT NULL AS present FROM base b CROSS JOIN labels l LEFT JOIN have h ON h.cluster_id = b.cluster_id AND h.label = l.label)"""


def _grid(spark, sf_dir):
    return metrics.presence_grid(shapes.cells(spark, sf_dir), tie_label="m0")


@query(f"WITH {GRID} SELECT * FROM grid")
def presence_grid(spark, sf_dir):
    return _grid(spark, sf_dir)


@query(f"WITH {GRID} PIVOT (SELECT cluster_id, label, present FROM grid) ON label IN ('m0', 'm1', 'm2', 'm3', 'm4') USING any_value(present) GROUP BY cluster_id")
def presence_pivot(spark, sf_dir):
    return metrics.pivoted(_grid(spark, sf_dir), "cluster_id", "label", [f"m{k}" for k in range(5)], "present", False)


_FIELD = """folds_{0} AS (SELECT cluster_id, lower({0}) AS fold, count(*) AS n, arg_min({0}, ord) AS shown FROM one GROUP BY ALL),
won_{0} AS (SELECT cluster_id, arg_min(shown, (-n, coalesce(fold <> lower(tie), true)::INT, fold)) AS {0}
            FROM folds_{0} LEFT JOIN (SELECT cluster_id, {0} AS tie FROM one WHERE label = 'm0') USING (cluster_id) GROUP BY cluster_id)"""


@query(f"""WITH {GRID},
one AS (SELECT cluster_id, label, min(ord) AS ord, arg_min(flag, (ord, flag, status)) AS flag, arg_min(status, (ord, flag, status)) AS status FROM cells GROUP BY ALL),
{_FIELD.format("flag")}, {_FIELD.format("status")}
SELECT cluster_id, baseline AS present, flag, status FROM base JOIN won_flag USING (cluster_id) JOIN won_status USING (cluster_id)""")
def cluster_baselines(spark, sf_dir):
    first = lambda c: F.min_by(c, F.struct("ord", "flag", "status")).alias(c)
    one = shapes.cells(spark, sf_dir).groupBy("cluster_id", "label").agg(F.min("ord").alias("ord"), first("flag"), first("status"))
    return metrics.cluster_baselines(one, ["flag", "status"], tie_label="m0", ascii_only=True)


STATS = f"""{GRID},
c AS (SELECT label, count(*) FILTER (present AND baseline) AS tp, count(*) FILTER (present AND NOT baseline) AS fp, count(*) FILTER (NOT present AND baseline) AS fn FROM grid GROUP BY label),
stats AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM c),
full_stats AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM stats)"""


@query(f"WITH {STATS} SELECT label, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_stats")
def presence_stats(spark, sf_dir):
    return rounded(metrics.presence_stats(_grid(spark, sf_dir)), "precision", "recall", "f1")


ACCURACY = f"""{STATS.replace(shapes.CELLS, VOTES)},
own AS (SELECT cluster_id, label, arg_min(flag, ord) AS value FROM cells GROUP BY ALL),
accuracy AS (SELECT o.label, count(*) AS n, count(*) FILTER (lower(o.value) = lower(w.winner)) AS hits FROM own o JOIN won w USING (cluster_id) WHERE winner IS NOT NULL GROUP BY o.label)"""


def _accuracy(spark, sf_dir):
    cells, won = _winners(spark, sf_dir)
    own = cells.groupBy("cluster_id", "label").agg(F.min_by("flag", "ord").alias("value"))
    return metrics.field_accuracy(own.join(won.withColumnRenamed("winner", "baseline"), "cluster_id"), ascii_only=True)


@query(f"WITH {ACCURACY} SELECT label, n, hits, round(hits / n, 6) AS accuracy FROM accuracy")
def field_accuracy(spark, sf_dir):
    return rounded(_accuracy(spark, sf_dir), "accuracy")


RANKED = f"""{ACCURACY},
joined AS (SELECT label, precision, f1, hits / n AS accuracy FROM full_stats FULL JOIN accuracy USING (label)),
scored AS (SELECT label, (0.5 * coalesce(f1, 0) + 0.5 * coalesce(accuracy, 0)) / ((f1 IS NOT NULL)::INT * 0.5 + (accuracy IS NOT NULL)::INT * 0.5) AS composite, f1, accuracy FROM joined)"""


def _stats(spark, sf_dir):
    return metrics.join_stats(metrics.presence_stats(_grid(spark, sf_dir)).select("label", "f1"), _accuracy(spark, sf_dir).select("label", "accuracy"))


@query(f"WITH {RANKED} SELECT label, round(composite, 6) AS composite, rank() OVER (ORDER BY composite DESC NULLS LAST, f1 DESC NULLS LAST, accuracy DESC NULLS LAST) AS rank FROM scored")
def rank_models(spark, sf_dir):
    out = metrics.ranked(_stats(spark, sf_dir), {"f1": 0.5, "accuracy": 0.5}, ["f1", "accuracy"])
    return rounded(out.select("label", "composite", F.col("rank").cast("long").alias("rank")), "composite")


@query(f"WITH {RANKED} SELECT label, 'f1' AS metric, round(f1, 6) AS score FROM scored WHERE f1 IS NOT NULL UNION ALL SELECT label, 'accuracy', round(accuracy, 6) FROM scored WHERE accuracy IS NOT NULL")
def metrics_unpivot(spark, sf_dir):
    return rounded(metrics.melted(_stats(spark, sf_dir), "label", ["f1", "accuracy"]), "score")


@query(f"WITH {GRID} SELECT c.cluster_id, c.label, count(*) AS n FROM cells c WHERE EXISTS (SELECT 1 FROM base b WHERE b.baseline AND b.cluster_id = c.cluster_id) GROUP BY ALL")
def confirmed_rows(spark, sf_dir):
    key = lambda df: df.withColumn("key", F.col("cluster_id").cast("string"))
    kept = metrics.keep_confirmed(key(shapes.cells(spark, sf_dir)), key(_grid(spark, sf_dir)), "key", True)
    return kept.groupBy("cluster_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_name, count(*) AS n FROM part WHERE NOT EXISTS (SELECT 1 FROM (SELECT p_name AS d FROM part WHERE p_size = 1) x WHERE lower(x.d) = lower(p_name)) GROUP BY p_name")
def deleted_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    gone = part.filter("p_size = 1").select(F.upper("p_name").alias("p_name"))
    return metrics.drop_rows(part, gone, "p_name", True).groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH o AS (SELECT lower(p_type) AS fold, arg_min(p_type, p_partkey) AS shown FROM part GROUP BY 1)
SELECT row_number() OVER (ORDER BY fold)::INT AS rank, shown FROM o UNION ALL SELECT 0, '(none)'""")
def field_options(spark, sf_dir):
    return metrics.field_options(table(spark, sf_dir, "part"), "p_type", "p_partkey", True)


# Scalars


@query(r"""SELECT p_partkey, nullif(regexp_replace(regexp_replace(lower(trim(regexp_replace('  ' || p_name || ' - ' || p_brand || '. ', '\s+', ' ', 'g'))), '\s*-\s*', '-', 'g'), '[.,;]+$', ''), '') AS name FROM part""")
def canonical_name(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" - "), "p_brand", F.lit(". "))
    return table(spark, sf_dir, "part").select("p_partkey", T.canonical_name(raw, True).alias("name"))


@query("""SELECT l_orderkey, l_linenumber, round(CASE WHEN e1 < s1 OR e2 < s2 THEN 0 ELSE greatest(0, least(e1, e2) - greatest(s1, s2) + 1) /
  (e1 - s1 + 1 + e2 - s2 + 1 - greatest(0, least(e1, e2) - greatest(s1, s2) + 1)) END, 6) AS overlap
FROM (SELECT *, l_quantity::INT AS s1, l_quantity::INT + l_linenumber * 4 AS e1, l_linenumber * 6 AS s2, l_linenumber * 6 + (l_suppkey % 9)::INT AS e2 FROM lineitem)""")
def interval_jaccard(spark, sf_dir):
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    overlap = S.interval_jaccard(q, q + n * 4, n * 6, n * 6 + (F.col("l_suppkey") % 9).cast("int"))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", overlap.alias("overlap")), "overlap")


# Pairs of records


def _two_sides(spark, sf_dir):
    r = reactions.with_diagnostic(shapes.records(spark, sf_dir))
    return r.filter("label = 'm0'"), r.filter("label <> 'm0'")


RECORDS = f"""records AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(shapes.LINE_ORDER)}) AS ord, 'm' || (l_suppkey % 3) AS label, lower(p_name) AS name, p_brand AS smiles,
         [l_returnflag, l_linestatus, p_type] AS rs, list_distinct([l_returnflag, l_linestatus, p_brand, p_type]) AS cs, [l_discount, l_tax, l_quantity / 50] AS v,
         l_discount * 100 AS y, l_quantity AS t, l_tax = 0 AS room, l_tax * 100 AS h,
         CASE l_returnflag WHEN 'R' THEN 'inert' WHEN 'A' THEN 'air' END AS atm, l_returnflag AS sec, l_linestatus AS step, p_type,
         (l_quantity * 2)::INT AS s, (l_quantity * 2)::INT + l_linenumber * 3 AS e
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)"""

PAIRS = RECORDS + """,
raw AS (
  SELECT b.doc_id, b.ord AS b_ord, c.ord AS c_ord,
    CASE WHEN b.name = c.name THEN 1.0 ELSE 1.0 - levenshtein(b.name, c.name) / greatest(length(b.name), length(c.name)) END AS axis_name,
    (b.smiles = c.smiles)::INT::DOUBLE AS axis_smiles,
    len(list_intersect(list_distinct(b.rs), list_distinct(c.rs))) / len(list_distinct(list_concat(b.rs, c.rs))) AS axis_reactants,
    CASE WHEN list_dot_product(b.v, b.v) * list_dot_product(c.v, c.v) > 0 THEN list_dot_product(b.v, c.v) / sqrt(list_dot_product(b.v, b.v) * list_dot_product(c.v, c.v)) ELSE 0.0 END AS axis_procedure,
    CASE WHEN abs(b.y - c.y) <= 2 THEN 1.0 WHEN abs(b.y - c.y) <= 5 THEN 0.75 WHEN abs(b.y - c.y) <= 10 THEN 0.4 ELSE 0.0 END AS axis_yield,
    CASE WHEN b.room AND c.room THEN 1.0 WHEN abs(CASE WHEN b.room THEN 25 ELSE b.t END - CASE WHEN c.room THEN 25 ELSE c.t END) <= 5 THEN 1.0
         WHEN abs(CASE WHEN b.room THEN 25 ELSE b.t END - CASE WHEN c.room THEN 25 ELSE c.t END) <= 10 THEN 0.5 ELSE 0.0 END AS temp,
    CASE WHEN greatest(abs(b.h), abs(c.h)) = 0 THEN 1.0 WHEN abs(b.h - c.h) / greatest(abs(b.h), abs(c.h)) <= 0.2 THEN 1.0 ELSE 0.0 END AS hours,
    CASE WHEN b.atm IS NOT NULL AND c.atm IS NOT NULL THEN (b.atm = c.atm)::INT::DOUBLE END AS air
  FROM records b JOIN records c ON b.doc_id = c.doc_id AND b.label = 'm0' AND c.label <> 'm0'),
pairs AS (SELECT *, (temp + hours + coalesce(air, 0)) / (CASE WHEN air IS NULL THEN 2 ELSE 3 END) AS axis_conditions FROM raw),
scored_pairs AS (SELECT *, 0.4 * axis_name + 0.15 * axis_smiles + 0.15 * axis_reactants + 0.2 * axis_procedure + 0.05 * axis_yield + 0.05 * axis_conditions AS composite FROM pairs)"""


@query(f"""WITH {PAIRS} SELECT doc_id, b_ord, c_ord, round(axis_name::DOUBLE, 6) AS axis_name, round(axis_smiles, 6) AS axis_smiles, round(axis_reactants, 6) AS axis_reactants,
round(axis_procedure, 6) AS axis_procedure, round(axis_yield::DOUBLE, 6) AS axis_yield, round(axis_conditions::DOUBLE, 6) AS axis_conditions, round(composite::DOUBLE, 6) AS composite FROM scored_pairs""")
def pair_scores(spark, sf_dir):
    pairs = reactions.pair_scores(*_two_sides(spark, sf_dir)).drop("label_match", "smiles_match", "yield_difference", "class_match")
    return rounded(pairs, *[f"axis_{k}" for k in reactions.AXES], "composite")


#: Greedy assignment as a recursion over each document's sorted pairs: which records are taken so far.
MATCHED = "RECURSIVE " + PAIRS + f""",
sorted AS (SELECT doc_id, b_ord, c_ord, composite, row_number() OVER (PARTITION BY doc_id ORDER BY composite DESC, c_ord, b_ord) AS k FROM scored_pairs WHERE composite >= {S.MATCH_AT}),
fold AS (
  SELECT DISTINCT doc_id, 0::BIGINT AS k, []::BIGINT[] AS bs, []::BIGINT[] AS cs FROM sorted
  UNION ALL
  SELECT f.doc_id, s.k, CASE WHEN list_contains(bs, b_ord) OR list_contains(cs, c_ord) THEN bs ELSE list_append(bs, b_ord) END,
         CASE WHEN list_contains(bs, b_ord) OR list_contains(cs, c_ord) THEN cs ELSE list_append(cs, c_ord) END
  FROM fold f JOIN sorted s ON f.doc_id = s.doc_id AND s.k = f.k + 1),
lists AS (SELECT doc_id, arg_max(bs, k) AS bs, arg_max(cs, k) AS cs FROM fold GROUP BY doc_id),
matched AS (SELECT doc_id, unnest(bs) AS b_ord, unnest(cs) AS c_ord FROM lists)"""


def _matched(spark, sf_dir):
    base, other = _two_sides(spark, sf_dir)
    pairs = stage(reactions.pair_scores(base, other), "pair-scores")  # the pairs are scored once, however often they are read
    return base, other, pairs, reactions.assign(pairs)


@query(f"WITH {MATCHED} SELECT doc_id, b_ord, c_ord, round(composite::DOUBLE, 6) AS composite FROM matched JOIN scored_pairs USING (doc_id, b_ord, c_ord)")
def bipartite_match(spark, sf_dir):
    return rounded(_matched(spark, sf_dir)[3], "composite")


_CLASS = "list_distinct(list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]', ' ', 'g'), ' '), lambda w: w <> ''))"
_COVERAGE = ", ".join(f"round(avg((axis_{k} IS NOT NULL)::INT), 6) AS coverage_{k}" for k in reactions.AXES)


@query(f"""WITH {MATCHED},
words AS (SELECT doc_id, ord, y, {_CLASS.format("p_type")} AS ws FROM records),
won AS (SELECT p.*, abs(b.y - c.y) AS dy, (len(b.ws) > 0 AND len(c.ws) > 0 AND (list_has_all(b.ws, c.ws) OR list_has_all(c.ws, b.ws)))::INT AS same
        FROM matched m JOIN scored_pairs p USING (doc_id, b_ord, c_ord) JOIN words b ON b.doc_id = m.doc_id AND b.ord = m.b_ord JOIN words c ON c.doc_id = m.doc_id AND c.ord = m.c_ord),
sides AS (SELECT doc_id, count(*) FILTER (label = 'm0') AS nb, count(*) FILTER (label <> 'm0') AS nc FROM records GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS tp, round(avg(axis_reactants), 6) AS avg_reactants, round(100.0 * avg((axis_reactants = 1)::INT), 6) AS perfect_reactants_pct,
               round(avg(dy), 6) AS yield_mae, round(100.0 * avg((dy <= 5)::INT), 6) AS yield_within_5_pct, round(avg(same), 6) AS class_accuracy, round(avg(axis_procedure), 6) AS avg_procedure,
               {_COVERAGE} FROM won GROUP BY doc_id),
missed AS (SELECT p.doc_id, count(*) AS m FROM scored_pairs p LEFT JOIN matched w USING (doc_id, b_ord, c_ord)
           WHERE axis_name >= {S.NEAR_MISS[0]} AND axis_name < {S.NEAR_MISS[1]} AND w.doc_id IS NULL GROUP BY p.doc_id),
counted AS (SELECT *, coalesce(tp, 0) AS n, nc - n AS fp, nb - n AS fn, coalesce(n / nullif(n + fp, 0), 0) AS p, coalesce(n / nullif(n + fn, 0), 0) AS r FROM sides LEFT JOIN own USING (doc_id) LEFT JOIN missed USING (doc_id))
SELECT * EXCLUDE (nb, nc, n, p, r, m) REPLACE (n AS tp), coalesce(m, 0) AS near_misses, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM counted""")
def match_report(spark, sf_dir):
    base, other, pairs, won = _matched(spark, sf_dir)
    report = reactions.match_report(reactions.match_details(pairs, won, base, other), reactions.near_misses(pairs, won))
    return rounded(report, *[c for c, kind in report.dtypes if kind == "double"])


@query(f"""WITH {MATCHED} SELECT doc_id, b_ord, c_ord, round(axis_name::DOUBLE, 6) AS axis_name FROM scored_pairs p
WHERE axis_name >= {S.NEAR_MISS[0]} AND axis_name < {S.NEAR_MISS[1]} AND NOT EXISTS (SELECT 1 FROM matched m WHERE m.doc_id = p.doc_id AND m.b_ord = p.b_ord AND m.c_ord = p.c_ord)""")
def near_misses(spark, sf_dir):
    _, _, pairs, won = _matched(spark, sf_dir)
    return reactions.near_misses(pairs, won).select("doc_id", "b_ord", "c_ord", F.round("axis_name", 6).alias("axis_name"))


@query(f"""WITH {RECORDS}, k AS (SELECT doc_id, label = 'm0' AS base, lower(sec) || ' | ' || lower(step) AS d FROM records)
SELECT doc_id, count(*) AS overlap FROM (SELECT doc_id, d FROM k WHERE base INTERSECT SELECT doc_id, d FROM k WHERE NOT base) GROUP BY doc_id""")
def label_overlap(spark, sf_dir):
    return reactions.label_overlap(*_two_sides(spark, sf_dir))


EDGES = RECORDS + """,
p AS (
  SELECT l.doc_id, l.ord AS l_ord, r.ord AS r_ord,
    CASE WHEN l.e < l.s OR r.e < r.s THEN 0 ELSE greatest(0, least(l.e, r.e) - greatest(l.s, r.s) + 1) / (l.e - l.s + 1 + r.e - r.s + 1 - greatest(0, least(l.e, r.e) - greatest(l.s, r.s) + 1)) END AS overlap,
    len(list_intersect(l.cs, r.cs)) / len(list_distinct(list_concat(l.cs, r.cs))) AS sets, (l.name = r.name)::INT AS same,
    CASE WHEN list_dot_product(l.v, l.v) * list_dot_product(r.v, r.v) > 0 THEN least(1, greatest(0, list_dot_product(l.v, r.v) / sqrt(list_dot_product(l.v, l.v) * list_dot_product(r.v, r.v)))) END AS cos
  FROM records l JOIN records r ON l.doc_id = r.doc_id AND l.ord < r.ord AND l.label <> r.label),
blend AS (SELECT *, (0.3 * same + 0.3 * coalesce(cos, 0) + 0.25 * sets) / (CASE WHEN cos IS NULL THEN 0.55 ELSE 0.85 END) AS b FROM p)"""


@query(f"""WITH {EDGES} SELECT doc_id, l_ord, r_ord, CASE WHEN overlap >= 0.5 THEN 0 WHEN sets >= 0.85 THEN 1 ELSE 2 END AS tier,
round(CASE WHEN overlap >= 0.5 THEN overlap WHEN sets >= 0.85 THEN sets ELSE b END, 6) AS score FROM blend WHERE overlap >= 0.5 OR sets >= 0.85 OR b >= 0.7""")
def cluster_edges(spark, sf_dir):
    return rounded(reactions.edges(shapes.records(spark, sf_dir)).drop("l_label", "r_label"), "score")


def _clustered(tau: float, name: str = "") -> str:
    """Constrained single linkage as a recursion over each document's sorted edges: every record with its cluster's smallest record and tier."""
    return f""",
edges{name} AS (SELECT doc_id, l_ord, r_ord, CASE WHEN overlap >= {tau} THEN 0 WHEN sets >= 0.85 THEN 1 ELSE 2 END AS tier,
                CASE WHEN overlap >= {tau} THEN overlap WHEN sets >= 0.85 THEN sets ELSE b END AS score FROM blend WHERE overlap >= {tau} OR sets >= 0.85 OR b >= 0.7),
sorted{name} AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier, score DESC, l_ord, r_ord) AS k FROM edges{name}),
fold{name} AS (
  SELECT doc_id, 0::BIGINT AS k, list({{'o': ord, 'l': label, 'c': ord, 't': NULL::INT}}) AS st FROM records WHERE doc_id IN (SELECT doc_id FROM edges{name}) GROUP BY doc_id
  UNION ALL
  SELECT doc_id, k, CASE WHEN list_has_any(list_transform(list_filter(st, lambda x: x.c = ca), lambda x: x.l), list_transform(list_filter(st, lambda x: x.c = cb), lambda x: x.l)) THEN st
    ELSE list_transform(st, lambda x: CASE WHEN x.c = ca OR x.c = cb THEN {{'o': x.o, 'l': x.l, 'c': least(ca, cb), 't': greatest(tier, ta, tb)}} ELSE x END) END
  FROM (SELECT f.doc_id, s.k, st, s.tier, list_filter(st, lambda x: x.o = s.l_ord)[1].c AS ca, list_filter(st, lambda x: x.o = s.r_ord)[1].c AS cb,
               list_filter(st, lambda x: x.o = s.l_ord)[1].t AS ta, list_filter(st, lambda x: x.o = s.r_ord)[1].t AS tb
        FROM fold{name} f JOIN sorted{name} s ON f.doc_id = s.doc_id AND s.k = f.k + 1)),
ends{name} AS (SELECT doc_id, unnest(arg_max(st, k)) AS x FROM fold{name} GROUP BY doc_id),
clusters{name} AS (SELECT r.doc_id, r.ord, r.label, coalesce(x.c, r.ord) AS cluster_id, x.t AS t FROM records r LEFT JOIN ends{name} e ON e.doc_id = r.doc_id AND e.x.o = r.ord)"""


@query(f"WITH RECURSIVE {EDGES}{_clustered(0.5)} SELECT doc_id, ord, label, cluster_id, ['provenance', 'compound_jaccard', 'combined'][t + 1] AS match_tier FROM clusters")
def reaction_clusters(spark, sf_dir):
    return reactions.cluster(shapes.records(spark, sf_dir))


SWEEP = (0.25, 0.5, 0.75)


def _diagnosed(tau: float, name: str) -> str:
    return f"""SELECT {tau}::DOUBLE AS tau, count(*) AS clusters, count(*) FILTER (n > 1) AS multi, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n = k) AS "full",
count(*) FILTER (n >= ceil(k / 2)) AS majority, round(avg(n), 6) AS mean_size, count(*) FILTER (t = 0) AS provenance, count(*) FILTER (t = 1) AS compound_jaccard, count(*) FILTER (t = 2) AS combined
FROM (SELECT count(*) AS n, any_value(t) AS t, (SELECT count(DISTINCT label) FROM records) AS k FROM clusters{name} GROUP BY doc_id, cluster_id)"""


@query(f"""WITH RECURSIVE {EDGES}{"".join(_clustered(t, f"_{k}") for k, t in enumerate(SWEEP))}, rows AS ({" UNION ALL ".join(_diagnosed(t, f"_{k}") for k, t in enumerate(SWEEP))})
SELECT *, clusters - lag(clusters) OVER (ORDER BY tau) AS delta FROM rows""")
def threshold_sweep(spark, sf_dir):
    return rounded(reactions.sweep(shapes.records(spark, sf_dir), "tau_provenance", list(SWEEP)), "mean_size")


@query(f"""WITH {RECORDS} SELECT doc_id, ord, smiles || '<<' || array_to_string(list_sort(rs), '|') AS reaction_key,
CASE WHEN ord % 3 = 0 THEN name WHEN length(name || p_type) <= 40 THEN name || p_type ELSE substr(name || p_type, 1, 37) || '...' END AS product FROM records""")
def reaction_keys(spark, sf_dir):
    structure = F.concat("name", "reaction_class")
    shown = reactions.product_display(F.when(F.col("ord") % 3 == 0, F.col("name")), structure)
    return shapes.records(spark, sf_dir).select("doc_id", "ord", reactions.reaction_key(F.col("smiles"), F.col("reactant_smiles")).alias("reaction_key"), shown.alias("product"))


@query(f"""WITH RECURSIVE {EDGES}{_clustered(0.5)}, picked AS (
  SELECT c.doc_id, c.cluster_id, c.label, c.ord, sec || ' | ' || step AS row_label, name FROM clusters c JOIN records r ON r.doc_id = c.doc_id AND r.ord = c.ord)
SELECT doc_id, cluster_id, label, arg_min(ord, (-length(row_label), -length(name), ord)) AS ord, arg_min(row_label, (-length(row_label), -length(name), ord)) AS row_label
FROM picked GROUP BY doc_id, cluster_id, label""")
def reaction_representatives(spark, sf_dir):
    records = shapes.records(spark, sf_dir)
    none = F.lit(None).cast("string")
    called = reactions.row_label({"reaction_id": none, "section_label": F.col("section_label"), "step_label": F.col("step_label"), "product_name": F.col("name"), "product_smiles": F.col("smiles")})
    named = records.withColumns({"row_label": called, "product_name": F.col("name")})
    return reactions.representatives(reactions.cluster(named, keep=["row_label", "product_name"]))


@query(f"WITH {RECORDS} SELECT label, count(*) FILTER (t <= 45) AS kept, count(*) FILTER (t > 45) AS skipped FROM records GROUP BY label")
def synthetic_filter(spark, sf_dir):
    return reactions.skipped_counts(shapes.records(spark, sf_dir).withColumn("non_synthetic", F.col("temperature_c") > 45))


def _steps(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.lit(0).alias("doc_id"), F.lit("run").alias("label"), F.col("conv_id").cast("string").alias("section_label"), F.col("turn").alias("step_index"), F.col("role").alias("step_label"),
        F.when(F.col("turn") % 3 != 0, F.col("turn") * 10).alias("start_line"), (F.col("turn") * 10 + 5).alias("end_line"), F.struct("turn", "text").alias("pos"),
    )


def _asks(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    role = F.when(F.col("event_type") == "view", " User").when(F.col("event_type") == "click", "ASSISTANT").otherwise("system_x")
    return e.select(F.lit(0).alias("doc_id"), F.lit("run").alias("label"), F.col("event_id"), F.col("user_id").cast("string").alias("section_label"), (F.col("event_id") % 11).alias("step_index"), role.alias("step_label"))


JOINED = """steps AS (SELECT conv_id::VARCHAR AS section, turn AS k, role AS k2, CASE WHEN turn % 3 <> 0 THEN turn * 10 END AS s, turn * 10 + 5 AS e, turn, text FROM conversations),
by_index AS (SELECT section, k, arg_min(struct_pack(s := s, e := e), (turn, text)) AS hit FROM steps GROUP BY ALL),
by_label AS (SELECT section, k2, arg_min(struct_pack(s := s, e := e), (turn, text)) AS hit FROM steps GROUP BY ALL),
asks AS (SELECT event_id, user_id::VARCHAR AS section, event_id % 11 AS k, CASE event_type WHEN 'view' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'system x' END AS k2 FROM events),
found AS (SELECT event_id, coalesce(i.hit, l.hit) AS hit, CASE WHEN i.hit IS NOT NULL THEN 'exact_index' ELSE 'exact_label' END AS kind
          FROM asks a LEFT JOIN by_index i ON a.section = i.section AND a.k = i.k LEFT JOIN by_label l ON a.section = l.section AND a.k2 = l.k2),
joined AS (SELECT event_id, CASE WHEN ok THEN hit.s END AS start_line, CASE WHEN ok THEN hit.e END AS end_line, CASE WHEN ok THEN kind END AS line_join
           FROM (SELECT *, hit IS NOT NULL AND hit.s IS NOT NULL AND hit.e IS NOT NULL AS ok FROM found))"""


@query(f"WITH {JOINED} SELECT * FROM joined")
def line_join(spark, sf_dir):
    return reactions.line_join(_asks(spark, sf_dir), _steps(spark, sf_dir), True).select("event_id", "start_line", "end_line", "line_join")


@query(f"""WITH {JOINED} SELECT 'run' AS label, count(*) AS n, count(*) FILTER (line_join = 'exact_index') AS by_index, count(*) FILTER (line_join = 'exact_label') AS by_label,
count(*) FILTER (line_join IS NULL) AS orphans FROM joined""")
def line_join_coverage(spark, sf_dir):
    return reactions.join_coverage(reactions.line_join(_asks(spark, sf_dir), _steps(spark, sf_dir), True))


# Paths


@query("""WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(c_name)) AS s, upper(regexp_replace(c_name, '[^a-zA-Z]', '', 'g')) AS letters FROM customer)
SELECT c_custkey, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' || substr('89ab', ('0x' || substr(s, 17, 1))::INT % 4 + 1, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS uuid,
CASE WHEN length(letters) >= 2 THEN substr(letters, 1, 2) ELSE 'XX' END AS country FROM h""")
def uuid5_path(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", paths.uuid5(F.col("c_name")).alias("uuid"), paths.country_code(F.col("c_name")).alias("country"))


def _bases(spark, sf_dir):
    """Customers whose files lie in the computed bucket, in another one, or nowhere, by thirds."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"))
    other = F.pmod(paths.hash_bucket(F.col("name")) + 1 + F.col("c_custkey") % 100, F.lit(paths.BUCKETS)).cast("int")
    at = F.when(F.col("c_custkey") % 3 == 0, paths.base_path(F.col("name"))).when(F.col("c_custkey") % 3 == 1, paths.base_path(F.col("name"), other))
    return c, c.select("c_custkey", at.alias("base")).filter("base is not null")


@query("SELECT c_custkey, c_custkey % 3 = 1 AS moved, c_custkey % 3 < 2 AS found FROM customer")
def base_paths(spark, sf_dir):
    c, there = _bases(spark, sf_dir)
    found = paths.resolved_base(c.select("name"), there.select(F.concat("base", F.lit("/compounds.json")).alias("path")))
    return c.join(found, "name").select("c_custkey", "moved", "found")


@query("""SELECT c_custkey, unnest(['prepass', 'r1', 'compounds', 'reactions']) AS kind, unnest([c_custkey % 2 = 0, false, true, c_custkey % 5 = 0]) AS found,
unnest([CASE WHEN c_custkey % 2 = 0 THEN 'new' END, NULL, 'c', CASE WHEN c_custkey % 5 = 0 THEN 'r' END]) AS content FROM customer""")
def artifact_fetch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("literature/patents/XX/1/"), F.col("c_custkey").cast("string")).alias("base"))
    runs = c.select(F.col("c_custkey").alias("key"), "base", F.lit("p1").alias("pipeline"))
    run = lambda text: F.concat("base", F.lit(f"/extraction/p1/{text}"))
    files = [c.filter(test).select(run(name).alias("path"), F.lit(body).alias("content")) for test, name, body in (
        ("c_custkey % 2 = 0", "pre-pass-2024.json", "old"), ("c_custkey % 2 = 0", "pre-pass-2025.json", "new"), ("true", "compounds.json", "c"), ("c_custkey % 5 = 0", "reactions.json", "r"))]
    every = files[0].unionAll(files[1]).unionAll(files[2]).unionAll(files[3])
    return paths.fetch_artifacts(runs, every).select(F.col("key").alias("c_custkey"), "kind", "found", "content")


@query("SELECT c_custkey, c_custkey % 3 < 2 AS found, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'old' END AS content FROM customer")
def markdown_fetch(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("b/"), F.col("c_custkey").cast("string")).alias("base"))
    new, old = paths.markdown_paths(F.col("base"))
    files = c.filter("c_custkey % 3 = 0").select(new.alias("path"), F.lit("new").alias("content")).unionAll(c.filter("c_custkey % 3 < 2").select(old.alias("path"), F.lit("old").alias("content")))
    return paths.fetch_preferred(c.select(F.col("c_custkey").alias("key"), "base"), files).select(F.col("key").alias("c_custkey"), "found", "content")


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def variant_unwrap(spark, sf_dir):
    k = F.variant_get(F.try_parse_json("props"), "$.k", "int")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"))
