"""Deterministic projections of the sample tables into the engine's shapes, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TOTAL_LINES = 720
REFERENCE = "click"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sections: a user is a document, an event type a run, an hour of the month a line."""
    k = F.get_json_object("props", "$.k").cast("int")
    start = (F.unix_timestamp("ts") - F.lit(1704067200)) / 3600
    e = table(spark, sf_dir, "events")
    e = e.withColumn("start_line", F.floor(start).cast("int") + 1)
    return e.select(
        F.col("user_id").alias("doc_id"), F.col("event_type").alias("label"), F.col("event_id").alias("ord"),
        F.concat(F.lit("type"), F.floor(k / 25).cast("string")).alias("section_type"), F.concat(F.lit("label"), (k % 50).cast("string")).alias("section_label"),
        "start_line", (F.col("start_line") + F.floor(F.col("value")).cast("int") % 6).alias("end_line"),
    )


SECTIONS = """sections AS (
  SELECT user_id AS doc_id, event_type AS label, event_id AS ord,
         'type' || ((props->>'$.k')::INT // 25) AS section_type, 'label' || ((props->>'$.k')::INT % 50) AS section_label,
         (floor((epoch(ts) - 1704067200) / 3600)::INT + 1) AS start_line,
         (floor((epoch(ts) - 1704067200) / 3600)::INT + 1 + floor(value)::INT % 6) AS end_line
  FROM events)"""

PAINTED = SECTIONS + f""",
painted AS (
  SELECT doc_id, label, line, arg_max(section_type, ord) AS line_type, arg_max(section_label, ord) AS line_label
  FROM (SELECT *, unnest(range(greatest(1, start_line), least({TOTAL_LINES}, end_line) + 1)) AS line FROM sections)
  GROUP BY doc_id, label, line)"""

SCORED = PAINTED + f""",
vectors AS (SELECT 'label' || (vec_id % 50) AS label_text, 'm' || (vec_id // 50) AS model, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
alike AS (SELECT a.label_text AS a, b.label_text AS b, avg(list_dot_product(a.v, b.v)) AS sim FROM vectors a JOIN vectors b USING (model) GROUP BY ALL),
runs AS (SELECT DISTINCT doc_id, label FROM sections WHERE label <> '{REFERENCE}'),
frame AS (SELECT doc_id, label, unnest(range(1, {TOTAL_LINES + 1})) AS line FROM runs),
scores AS (
  SELECT f.doc_id, f.label, f.line, p.line_type, coalesce(p.line_type = r.line_type, false) AS agree,
         coalesce(a.sim, 0) AS sim
  FROM frame f LEFT JOIN painted p ON f.doc_id = p.doc_id AND f.label = p.label AND f.line = p.line
  LEFT JOIN painted r ON f.doc_id = r.doc_id AND r.label = '{REFERENCE}' AND f.line = r.line
  LEFT JOIN alike a ON r.line_label = a.a AND p.line_label = a.b)"""


def label_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the 50 label texts, one for each model: 50 vectors in a row are a model's."""
    v = table(spark, sf_dir, "embeddings")
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    return v.select(name("label", F.col("vec_id") % 50).alias("label_text"), name("m", F.floor(F.col("vec_id") / 50)).alias("model"), F.col("embedding").alias("vector"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries: a source is a run, the text's digest and forms of it are the keys."""
    d = table(spark, sf_dir, "documents")
    flat = F.lower(F.regexp_replace("text", r"[ \n]+", " "))
    name = F.array_join(F.array_sort(F.array_distinct(F.split(flat, " "))), " ")  # the same words in any order are one name
    return d.select(
        F.col("doc_id").alias("ord"), F.lit(0).alias("doc_id"), F.col("source").alias("label"), name.alias("identifier"),
        F.md5("text").alias("inchi_key"), F.md5(flat).alias("smiles"), F.md5(F.regexp_replace(flat, "[^a-z]", "")).alias("molecular_formula"),
        F.array(name).alias("names"),
    )


ENTITIES = r"""flat AS (SELECT doc_id AS ord, source AS label, md5(text) AS k0, lower(regexp_replace(text, '[ \n]+', ' ', 'g')) AS t FROM documents),
entries AS (SELECT ord, label, k0, md5(t) AS k1, md5(regexp_replace(t, '[^a-z]', '', 'g')) AS k2, array_to_string(list_sort(list_distinct(string_split(t, ' '))), ' ') AS k3 FROM flat)"""


def _prefix(k: int) -> str:
    """The recursive closure over keys of tiers up to k: every entry's smallest reachable entry."""
    keys = " UNION ALL ".join(f"SELECT ord, '{j}:' || k{j} AS key FROM entries" for j in range(k + 1))
    return f"""keys{k} AS ({keys}),
pairs{k} AS (SELECT DISTINCT a.ord AS u, b.m AS v FROM keys{k} a JOIN (SELECT key, min(ord) AS m FROM keys{k} GROUP BY key) b USING (key)),
both{k} AS (SELECT u, v FROM pairs{k} UNION SELECT v, u FROM pairs{k}),
reach{k} AS (SELECT ord AS u, ord AS r FROM entries UNION SELECT b.u, x.r FROM reach{k} x JOIN both{k} b ON b.v = x.u WHERE x.r < b.u OR x.r = b.v),
part{k} AS (SELECT u AS ord, min(r) AS c{k} FROM reach{k} GROUP BY u)"""


CLUSTERS = "RECURSIVE " + ENTITIES + ",\n" + ",\n".join(_prefix(k) for k in range(4)) + """,
parts AS (SELECT * FROM entries JOIN part0 USING (ord) JOIN part1 USING (ord) JOIN part2 USING (ord) JOIN part3 USING (ord)),
tiers AS (SELECT c3, CASE WHEN count(*) = 1 THEN NULL WHEN min(c0) = max(c0) THEN 'inchi_key' WHEN min(c1) = max(c1) THEN 'smiles'
                          WHEN min(c2) = max(c2) THEN 'molecular_formula' ELSE 'name' END AS match_tier FROM parts GROUP BY c3),
clusters AS (SELECT ord, c3 AS cluster_id, match_tier, label, k3 AS identifier FROM parts JOIN tiers USING (c3)),
members AS (SELECT DISTINCT cluster_id, label, match_tier FROM clusters)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as grid cells: a part is a cluster, supplier modulo 5 a run, return flag and line status its fields."""
    li = table(spark, sf_dir, "lineitem")
    label = F.concat(F.lit("m"), (F.col("l_suppkey") % 5).cast("string"))
    return li.select(F.col("l_partkey").alias("cluster_id"), label.alias("label"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"))


CELLS = "cells AS (SELECT l_partkey AS cluster_id, 'm' || (l_suppkey % 5) AS label, l_orderkey * 10 + l_linenumber AS ord, l_returnflag AS flag, l_linestatus AS status FROM lineitem)"


LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as records: an order is a document, supplier modulo 3 a run, and the place in the order's sorted lines the record's number (line numbers repeat)."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_brand", "p_type"), "l_partkey", "left")
    # Numbered by doc_id itself before anything wide is made: what follows by document then finds its rows together, and only columns of the tables are shuffled.
    li = li.withColumn("doc_id", F.col("l_orderkey"))
    li = li.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*LINE_ORDER)).cast("long"))
    text = lambda c: F.col(c).cast("string")
    vector = F.array(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50)
    start = (F.col("l_quantity") * 2).cast("int")
    return li.select(
        "doc_id", "ord", F.concat(F.lit("m"), (F.col("l_suppkey") % 3).cast("string")).alias("label"),
        F.lower("p_name").alias("name"), F.col("p_brand").alias("smiles"),
        F.array(text("l_returnflag"), text("l_linestatus"), F.col("p_type")).alias("reactant_smiles"), F.array(F.col("p_name")).alias("reactant_names"),
        F.array(text("l_returnflag"), text("l_linestatus"), F.col("p_brand"), F.col("p_type")).alias("compound_smiles"),
        vector.alias("procedure_vector"), F.lit(None).cast("array<double>").alias("reaction_vector"), (F.col("l_discount") * 100).alias("yield_pct"),
        F.col("l_quantity").alias("temperature_c"), (F.col("l_tax") == 0).alias("room_temperature"), (F.col("l_tax") * 100).alias("time_h"),
        F.when(F.col("l_returnflag") == "R", "Argon").when(F.col("l_returnflag") == "A", "air").alias("atmosphere"), F.col("p_type").alias("reaction_class"),
        F.col("l_returnflag").alias("section_label"), F.col("l_linestatus").alias("step_label"), start.alias("start_line"), (start + F.col("l_linenumber") * 3).alias("end_line"),
    )
