"""Queries that write the sample tables as JSON artifacts in the accepted shapes and read them back as typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswise.operators import lines
from crosswise.plans import shapes
from crosswise.plans.registry import query
from crosswise.plans.shapes import TOTAL_LINES, table
from crosswise.sources.payloads import bagged, read_artifacts


def shaped(rows: Column, inner: str, k: Column) -> Column:
    """Rows as a list, an object, a wrapped side, a list in a string, or (4) an export that found nothing."""
    held = F.concat(F.lit('{"' + inner + '":'), rows, F.lit("}"))
    side = F.concat(F.lit('{"baseline":{"found":true,"json":'), held, F.lit("}}"))
    return F.when(k == 0, rows).when(k == 1, held).when(k == 2, side).when(k == 3, F.to_json(F.struct(rows.alias("json")))).when(k == 4, '{"found":false,"json":null}')


def listed(df: DataFrame, *fields: Column) -> DataFrame:
    """One artifact per document and run: its rows, sorted by their fields, as a JSON list."""
    return df.groupBy("doc_id", "label").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*fields)))).alias("rows"))


def _empty(kind: str) -> str:
    return f"{kind} export has no data (found=false)"


def _sections(spark, sf_dir, kind: str) -> DataFrame:
    named = {"prepass": ("section_index", "section_label", "section_type", "sections"), "r1": ("step_index", "step_label", "section_label", "steps")}
    index, text, other, inner = named[kind]
    made = listed(shapes.sections(spark, sf_dir), F.col("ord").alias(index), F.col("section_label").alias(text), F.col("section_type").alias(other), F.col("start_line"), F.col("end_line"))
    k, rows = F.col("doc_id") % 6, F.col("rows")
    grouped = F.concat(F.lit('{"groups":[{"group_index":0,"sections":'), rows, F.lit("}]}")) if kind == "prepass" else F.concat(F.lit("["), rows, F.lit("]"))
    return made.select("doc_id", "label", F.when(k == 5, grouped).otherwise(shaped(rows, inner, k)).alias("content"))


READ_SECTIONS = shapes.SECTIONS + """,
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY {order}) - 1 AS nth FROM sections WHERE doc_id % 6 <> 4)
SELECT doc_id::VARCHAR AS doc_id, label, nth AS ord, ord::INT AS section_index, section_label, {fields}, start_line, end_line, NULL::VARCHAR AS error FROM good
UNION ALL SELECT DISTINCT doc_id::VARCHAR, label, NULL::BIGINT, NULL::INT, NULL, {nulls}, NULL::INT, NULL::INT, '{error}' FROM sections WHERE doc_id % 6 = 4"""


@query("WITH " + READ_SECTIONS.format(order="ord, section_label, section_type, start_line, end_line", fields="section_type", nulls="NULL", error=_empty("prepass")))
def prepass_scan(spark, sf_dir):
    return read_artifacts(_sections(spark, sf_dir, "prepass"), "prepass").drop("estimated_tokens", "parent_label")


@query("WITH " + READ_SECTIONS.format(order="start_line, end_line, ord, section_label, section_type", fields="section_type AS parent_label", nulls="NULL", error=_empty("r1")))
def r1_scan(spark, sf_dir):
    return read_artifacts(_sections(spark, sf_dir, "r1"), "r1").drop("estimated_tokens", "section_type")


@query(f"""WITH {shapes.PAINTED}, good AS (SELECT * FROM sections WHERE doc_id % 6 <> 4), runs AS (SELECT doc_id, label, count(*) AS sections, count(DISTINCT section_type) AS types FROM good GROUP BY ALL)
SELECT doc_id::VARCHAR AS doc_id, label, sections, types, (SELECT count(*) FROM painted p WHERE p.doc_id = runs.doc_id AND p.label = runs.label) AS covered,
       (SELECT count(*) FROM painted p WHERE p.doc_id = runs.doc_id AND p.label = runs.label AND line_type = 'type0') AS type0_lines FROM runs""")
def run_assembly(spark, sf_dir):
    run = lines.assemble(read_artifacts(_sections(spark, sf_dir, "prepass"), "prepass"), TOTAL_LINES)
    counts = run.types.groupBy("doc_id", "label").agg(F.sum("n").alias("sections"), F.count(F.lit(1)).alias("types"))
    covered = run.painted.groupBy("doc_id", "label").agg(F.count(F.lit(1)).alias("covered"), F.count_if(F.col("line_type") == "type0").alias("type0_lines"))
    return counts.join(covered, ["doc_id", "label"], "left").na.fill(0, ["covered", "type0_lines"])


@query(f"""WITH {shapes.SECTIONS} SELECT doc_id, label, ord, section_type, section_label, greatest(1, start_line) - 1 AS base, least({TOTAL_LINES}, end_line) - greatest(1, start_line) + 1 AS width
FROM sections WHERE greatest(1, start_line) <= least({TOTAL_LINES}, end_line)""")
def timeline_segments(spark, sf_dir):
    return lines.segments(shapes.sections(spark, sf_dir), TOTAL_LINES)


COMPOUNDS = """parts AS (SELECT p_brand AS label, replace(p_brand, 'Brand#', '')::INT % 5 AS k, p_partkey, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS identifier, p_type, p_size FROM part),
named AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY p_partkey, identifier, p_type, p_size) - 1 AS ord FROM parts WHERE identifier <> ' ' AND k <> 4)"""


@query(f"""WITH {COMPOUNDS}
SELECT label, ord, identifier, 'name' AS identifier_type, [p_type] AS aliases, p_size % 2 = 1 AS resolved, p_size::VARCHAR AS smiles, NULL::VARCHAR AS error FROM named
UNION ALL SELECT label, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN any_value(k) = 4 THEN '{_empty("compounds")}' ELSE 'compounds has no valid entries' END
FROM parts WHERE label NOT IN (SELECT label FROM named) GROUP BY label""")
def compounds_scan(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), F.col("p_brand").alias("label"), "p_partkey", F.when(F.col("p_partkey") % 7 == 0, " ").otherwise(F.col("p_name")).alias("identifier"), "p_type", "p_size")
    made = listed(p, F.col("p_partkey"), F.col("identifier"), F.array("p_type", F.lit(" ")).alias("aliases"), F.col("p_size").alias("smiles"), F.lit("name").alias("identifier_type"), (F.col("p_size") % 2 == 1).alias("resolved"))
    k = F.replace("label", F.lit("Brand#"), F.lit("")).cast("int") % 5
    found = read_artifacts(made.select("doc_id", "label", shaped(F.col("rows"), "compounds", k).alias("content")), "compounds")
    return found.select("label", "ord", "identifier", "identifier_type", "aliases", "resolved", "smiles", "error")


@query(f"""WITH lines AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(shapes.LINE_ORDER)}) - 1 AS ord FROM lineitem WHERE l_orderkey % 5 <> 4)
SELECT l_orderkey::VARCHAR AS doc_id, ord, l_linenumber::INT AS step_index, CASE WHEN l_partkey % 3 > 0 THEN 'p' || l_partkey END AS product_name, [l_returnflag, l_linestatus] AS reactant_names,
       l_discount AS yield_pct, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_tax END AS temperature_c, CASE WHEN l_linenumber % 3 <> 1 THEN l_linenumber % 3 = 2 END AS room_temperature,
       l_returnflag = 'R' AS non_synthetic, NULL::VARCHAR AS error FROM lines
UNION ALL SELECT DISTINCT l_orderkey::VARCHAR, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, '{_empty("reactions")}' FROM lineitem WHERE l_orderkey % 5 = 4""")
def reactions_scan(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"doc_id": F.col("l_orderkey"), "label": F.lit("run")})
    n = F.col("l_linenumber") % 3  # degrees inside the block, beside it, or as room temperature
    kind = F.when(n == 2, "room_temperature").otherwise("degrees")
    block = F.when(n != 1, F.struct(F.struct(F.when(n == 0, F.col("l_quantity")).alias("value_c"), kind.alias("type")).alias("temperature")))
    made = listed(
        li, *[F.col(c) for c in shapes.LINE_ORDER], F.col("l_linenumber").cast("string").alias("step_index"), F.concat(F.lit(" p"), F.when(F.col("l_partkey") % 3 > 0, F.col("l_partkey")).cast("string")).alias("product_name"),
        F.array("l_returnflag", F.lit(""), "l_linestatus").alias("reactant_names"), F.col("l_discount").alias("product_yield_pct"), F.when(n == 1, F.col("l_tax")).alias("temperature_c"),
        block.alias("conditions"), (F.col("l_returnflag") == "R").alias("non_synthetic"),
    )
    columns = ("step_index", "product_name", "reactant_names", "yield_pct", "temperature_c", "room_temperature", "non_synthetic")
    found = read_artifacts(made.select("doc_id", "label", shaped(F.col("rows"), "reactions", F.col("doc_id") % 5).alias("content")), "reactions", columns)
    return found.select("doc_id", "ord", *columns, "error")


@query(f"""WITH {shapes.SECTIONS}, runs AS (SELECT doc_id, label, min(ord) AS first FROM sections GROUP BY ALL)
SELECT doc_id, CASE WHEN bool_or(label = 'purchase') THEN 'purchase' ELSE arg_min(label, (first, label)) END AS reference FROM runs GROUP BY doc_id""")
def reference_runs(spark, sf_dir):
    runs = shapes.sections(spark, sf_dir).groupBy("doc_id", "label").agg(F.min("ord").alias("ord"))
    return lines.references(runs, "purchase")


@query("SELECT event_id, event_type AS label, CASE event_type WHEN 'view' THEN event_id WHEN 'click' THEN 1099511627776 + event_id WHEN 'error' THEN 2199023255552 + event_id END AS ord FROM events")
def bag_union(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("label"), F.col("event_id").alias("ord"))
    return bagged(rows, ["view", "click", "error"])
