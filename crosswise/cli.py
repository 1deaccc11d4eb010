"""Command line: compare runs of one document line by line, two compound lists, or sweep a record matcher's thresholds.

    python -m crosswise.cli lines --markdown doc.md Claude=a.json Other=b.json [--reference Claude] [--threshold 0.75] [--kind prepass]
    python -m crosswise.cli compounds first=a.json second=b.json [--json out.json]
    python -m crosswise.cli reactions A=a.json B=b.json --field tau_provenance --values 0.25 0.5 0.75 [--r1 A=steps.json]
"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswise.functions.text import canonical_name
from crosswise.operators import enrich, entities, lines, metrics, reactions, reports
from crosswise.session import build_session
from crosswise.sources.payloads import bagged, read_artifacts, read_files


def labelled(given: list[str]) -> dict[str, str]:
    """label=path arguments; labels must differ and there must be two at least."""
    pairs = [g.partition("=")[::2] for g in given]
    if len({label for label, _ in pairs}) != len(pairs) or len(pairs) < 2 or any(not p for _, p in pairs):
        raise SystemExit("give at least two label=path arguments with different labels")
    return dict(pairs)


def loaded(spark: SparkSession, runs: dict[str, str], kind: str) -> DataFrame:
    rows = read_artifacts(read_files(spark, {("doc", label): os.path.abspath(path) for label, path in runs.items()}), kind).cache()
    bad = rows.filter("error is not null").select("label", "error").collect()
    if bad:
        raise SystemExit("; ".join(f"{r.label}: {r.error}" for r in bad))
    return rows


def compare_lines(spark: SparkSession, runs: dict[str, str], markdown: str, kind: str, reference: str | None, threshold: float) -> str:
    text = spark.read.text(os.path.abspath(markdown), wholetext=True)
    total = text.select(F.size(F.split("value", "\n", -1))).first()[0]
    sections = loaded(spark, runs, kind)
    ref = lines.reference_label(list(runs), reference)
    painted = lines.paint(sections, total)
    texts = painted.filter("line_label <> ''").select(F.col("line_label").alias("label_text")).distinct()
    vectors = enrich.embedded(texts, "label_text", "vector").withColumn("model", F.lit("hashed"))
    scored = lines.line_scores(painted, sections.select("doc_id", "label").distinct(), total, ref, lines.label_similarity(painted, ref, vectors)).cache()
    tables = {
        "Types": lines.type_distribution(sections).orderBy("label", F.desc("n"), "section_type"),
        f"Scores against {ref}, {total} lines": lines.run_scores(scored).drop("doc_id").orderBy("label"),
        f"Flagged regions below {threshold}": lines.flag_regions(scored, threshold).drop("doc_id").orderBy("start_line"),
    }
    return reports.markdown("Line comparison", tables)


def compare_compounds(spark: SparkSession, runs: dict[str, str], out: str | None) -> str:
    rows = loaded(spark, runs, "compounds")
    entries = entities.name_pool(bagged(rows, list(runs))).cache()
    members = entities.members(entries, entities.resolve(entries)).cache()
    first, second = list(runs)[:2]
    if out:
        with open(out, "w", encoding="utf-8") as f:
            f.write(reports.diff_json(members, first, second).first().json)
    table = entities.cluster_table(members)
    tables = {
        "Runs": entities.label_counts(entries, members).orderBy("label"),
        f"Against {first}": entities.pairwise_metrics(members, first).orderBy("label"),
        "Memberships": entities.upset(table).orderBy(F.desc("n"), "membership"),
        "Identifier types": entities.identifier_types(entries).orderBy("label", "identifier_type"),
        "Clusters": entities.by_consensus(table).withColumn("match_tier", entities.tier_text(F.col("match_tier"))),
        "Presence": metrics.presence_stats(metrics.presence_grid(members, tie_label=first)).orderBy("label"),
    }
    return reports.markdown("Compound comparison", tables)


def record_entries(spark: SparkSession, runs: dict[str, str], r1: dict[str, str] | None = None) -> DataFrame:
    """Parsed records ready for matching: synthetic ones, with compound sets, lines and one order over all runs."""
    rows = reactions.synthetic_only(loaded(spark, runs, "reactions"))
    item = "array<struct<smiles:string,canonical_smiles:string,product_smiles:string,identifier:string,name:string,product_name:string,role:string,is_product:boolean>>"
    parsed = F.from_json(F.get_json_object("raw", "$.compounds"), item)
    shaped = F.transform(parsed, lambda c: F.struct(
        F.coalesce(c["smiles"], c["canonical_smiles"], c["product_smiles"]).alias("smiles"), F.coalesce(c["identifier"], c["name"], c["product_name"]).alias("name"),
        c["role"].alias("role"), F.coalesce(c["is_product"], F.lit(False)).alias("is_product"),
    ))
    rows = bagged(rows.withColumn("compounds", shaped), list(runs))
    rows = enrich.with_structures(rows).withColumn("name", canonical_name(F.col("product_name")))
    if r1:
        steps = read_artifacts(read_files(spark, {("doc", label): os.path.abspath(p) for label, p in r1.items()}), "r1")
        steps = steps.select("doc_id", "label", F.col("parent_label").alias("section_label"), F.col("section_index").alias("step_index"), F.col("section_label").alias("step_label"), "start_line", "end_line", F.col("ord").alias("pos"))
        return reactions.line_join(rows, steps)
    return rows.withColumns({"start_line": F.lit(None).cast("int"), "end_line": F.lit(None).cast("int")})


def sweep_reactions(spark: SparkSession, runs: dict[str, str], field: str, values: list[float], r1: dict[str, str] | None) -> str:
    entries = record_entries(spark, runs, r1).cache()
    tables = {"Compound sets": enrich.coverage(entries).orderBy("label"), f"Sweep of {field}": reactions.sweep(entries, field, values).orderBy("tau")}
    return reports.markdown("Record matching", tables)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="crosswise", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    modes = parser.add_subparsers(dest="mode", required=True)
    for name in ("lines", "compounds", "reactions"):
        modes.add_parser(name).add_argument("runs", nargs="+")
    a, b, c = (modes.choices[n] for n in ("lines", "compounds", "reactions"))
    a.add_argument("--markdown", required=True)
    a.add_argument("--kind", choices=("prepass", "r1"), default="prepass")
    a.add_argument("--reference")
    a.add_argument("--threshold", type=float, default=0.75)
    b.add_argument("--json")
    c.add_argument("--field", default="tau_provenance")
    c.add_argument("--values", type=float, nargs="+", default=[0.25, 0.5, 0.75])
    c.add_argument("--r1", nargs="*")
    args = parser.parse_args(argv)
    spark, runs = build_session("crosswise-cli"), labelled(args.runs)
    if args.mode == "lines":
        print(compare_lines(spark, runs, args.markdown, args.kind, args.reference, args.threshold))
    elif args.mode == "compounds":
        print(compare_compounds(spark, runs, args.json))
    else:
        print(sweep_reactions(spark, runs, args.field, args.values, dict(r.partition("=")[::2] for r in args.r1) if args.r1 else None))


if __name__ == "__main__":
    main()
