"""Line comparison: painting sections onto lines, agreement, similarity, and flagged regions.

Everything is keyed by ``doc_id``; lines of one document and run are the unit of each group, and a
run's uncovered lines are never stored: they are the rows that a left join misses.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswise.functions.scores import dot
from crosswise.session import stage


class Run(NamedTuple):
    """Parsed runs: their sections, the covered lines, and the counts of section types."""

    sections: DataFrame
    painted: DataFrame
    types: DataFrame


def type_distribution(sections: DataFrame) -> DataFrame:
    return sections.groupBy("label", "section_type").agg(F.count(F.lit(1)).alias("n"))


def paint(sections: DataFrame, total_lines: int | Column) -> DataFrame:
    """``sections(doc_id, label, ord, section_type, section_label, start_line, end_line)`` -> one row per covered line.

    Spans are cut to 1..total_lines; where sections overlap the later one (by ``ord``) wins. Sections are dealt by document
    before they become lines, so that lines are not shuffled, here or by readers that group by document.
    """
    n = F.lit(total_lines) if isinstance(total_lines, int) else total_lines
    low, high = F.greatest(F.lit(1), "start_line").cast("int"), F.least(n, "end_line").cast("int")
    lines = sections.filter(low <= high).repartition("doc_id").withColumn("line", F.explode(F.sequence(low, high)))
    top = F.max_by(F.struct("section_type", "section_label"), "ord").alias("s")
    return lines.groupBy("doc_id", "label", "line").agg(top).select("doc_id", "label", "line", F.col("s.section_type").alias("line_type"), F.col("s.section_label").alias("line_label"))


def assemble(parsed: DataFrame, total_lines: int | Column) -> Run:
    """Runs from the rows that a section reader gives: bad artifacts are left out; parsed rows are written once for both readers."""
    good = stage(parsed.filter("error is null"), "sections")
    types = good.groupBy("doc_id", "label", "section_type").agg(F.count(F.lit(1)).alias("n"))
    return Run(good, paint(good, total_lines), types)


def segments(sections: DataFrame, total_lines: int | Column) -> DataFrame:
    """A timeline's bars: each section's span cut to the document, from 0, and its width; sections outside have none."""
    n = F.lit(total_lines) if isinstance(total_lines, int) else total_lines
    low, high = F.greatest(F.lit(1), "start_line"), F.least(n, "end_line")
    return sections.filter(low <= high).select("doc_id", "label", "ord", "section_type", "section_label", (low - 1).alias("base"), (high - low + 1).alias("width"))


def reference_label(labels: list[str], wanted: str | None = None, preferred: str = "Claude") -> str:
    """The wanted label, else the preferred one, else the first; an unknown wanted label is an error."""
    if wanted is not None:
        if wanted not in labels:
            raise ValueError(f"reference label {wanted!r} is not among {labels}")
        return wanted
    return preferred if preferred in labels else labels[0]


def references(runs: DataFrame, preferred: str = "Claude") -> DataFrame:
    """Each document's reference run: the preferred label where it has one, else its first by ``ord`` (``runs(doc_id, label, ord)``)."""
    best = F.struct((F.col("label") != preferred).alias("other"), F.col("ord").alias("ord"), F.col("label").alias("label"))
    return runs.groupBy("doc_id").agg(F.min(best)["label"].alias("reference"))


def line_frame(runs: DataFrame, total_lines: int, reference: str) -> DataFrame:
    """Every line of every run that is compared: doc_id, label, line."""
    return runs.filter(F.col("label") != reference).select("doc_id", "label", F.explode(F.sequence(F.lit(1), F.lit(total_lines))).alias("line"))


def line_scores(painted: DataFrame, runs: DataFrame, total_lines: int, reference: str, similarity: DataFrame | None = None) -> DataFrame:
    """Per line and compared run: agree (both covered and of one type) and sim (0 where a label is missing or empty).

    ``similarity(a, b, sim)`` holds distinct label pairs; without it sim is 0.
    """
    ref = painted.filter(F.col("label") == reference).select("doc_id", "line", F.col("line_type").alias("ref_type"), F.col("line_label").alias("ref_label"))
    lines = line_frame(runs, total_lines, reference).join(painted, ["doc_id", "label", "line"], "left").join(ref, ["doc_id", "line"], "left")
    if similarity is not None:
        pair = similarity.select(F.col("a").alias("ref_label"), F.col("b").alias("line_label"), "sim")
        lines = lines.join(pair, ["ref_label", "line_label"], "left")
    else:
        lines = lines.withColumn("sim", F.lit(0.0))
    agree = F.coalesce(F.col("line_type") == F.col("ref_type"), F.lit(False))
    return lines.select("doc_id", "label", "line", "line_type", "line_label", agree.alias("agree"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def model_similarity(painted: DataFrame, reference: str, vectors: DataFrame) -> DataFrame:
    """Each model's dot product for each distinct (reference label, run label) that meet on a line: a, b, model, sim.

    ``vectors(label_text, model, vector)``: unit vectors. Each pair is computed once, however many lines share it.
    """
    ref = painted.filter(F.col("label") == reference).select("doc_id", "line", F.col("line_label").alias("a"))
    pairs = painted.filter((F.col("label") != reference) & (F.col("line_label") != "")).select("doc_id", "line", F.col("line_label").alias("b"))
    return pair_similarity(pairs.join(ref.filter("a != ''"), ["doc_id", "line"]).select("a", "b").distinct(), vectors)


def pair_similarity(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each model's dot product for distinct ``pairs(a, b)`` of labels: a, b, model, sim."""
    left = vectors.select(F.col("label_text").alias("a"), "model", F.col("vector").alias("va"))
    right = vectors.select(F.col("label_text").alias("b"), "model", F.col("vector").alias("vb"))
    return pairs.join(left, "a").join(right, ["b", "model"]).select("a", "b", "model", dot(F.col("va"), F.col("vb")).alias("sim"))


def label_similarity(painted: DataFrame, reference: str, vectors: DataFrame) -> DataFrame:
    """The models' mean similarity for each pair of labels."""
    return model_similarity(painted, reference, vectors).groupBy("a", "b").agg(F.avg("sim").alias("sim"))


def run_scores(scores: DataFrame) -> DataFrame:
    """Per document and run: share of agreeing lines and mean similarity, each line with equal weight."""
    return scores.groupBy("doc_id", "label").agg(
        F.count_if("agree").alias("n_agree"), F.avg(F.col("agree").cast("double")).alias("agreement"), F.avg("sim").alias("mean_sim")
    )


def flag_lines(scores: DataFrame, threshold: float) -> DataFrame:
    """Flagged lines with why and how bad: a line is flagged if any run disagrees or is below ``threshold``."""
    low = F.col("sim") < threshold
    return scores.groupBy("doc_id", "line").agg(
        F.bool_or(~F.col("agree")).alias("mismatch"), F.bool_or(low).alias("low"), F.min("sim").alias("worst")
    ).filter("mismatch or low")


def flag_regions(scores: DataFrame, threshold: float) -> DataFrame:
    """Maximal runs of flagged lines: start, end, kind of issue, disagreeing runs, mean of the lines' worst similarity."""
    flagged = flag_lines(scores, threshold)
    island = F.col("line") - F.row_number().over(Window.partitionBy("doc_id").orderBy("line"))
    lines = flagged.withColumn("island", island)
    kind = F.when(F.bool_or("mismatch") & F.bool_or("low"), "both").when(F.bool_or("mismatch"), "type_mismatch").otherwise("low_similarity")
    regions = lines.groupBy("doc_id", "island").agg(
        F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.avg("worst").alias("avg_sim"), kind.alias("issue_kind")
    )
    bad = scores.filter(~F.col("agree") | (F.col("sim") < threshold)).select("doc_id", "line", "label")
    models = bad.join(lines.select("doc_id", "line", "island"), ["doc_id", "line"]).groupBy("doc_id", "island").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("disagreeing")
    )
    return regions.join(models, ["doc_id", "island"]).drop("island")


def dominant_values(painted: DataFrame, regions: DataFrame, value: str = "line_type") -> DataFrame:
    """Per region and run the most common value; ties go to the value seen first; uncovered lines do not count."""
    spans = regions.select("doc_id", "start_line", "end_line")  # joined as spans: a document has few, and their lines may be all of its lines
    inside = painted.filter(F.col(value).isNotNull()).join(spans, "doc_id").filter("line between start_line and end_line")
    counts = inside.groupBy("doc_id", "start_line", "label", value).agg(F.count(F.lit(1)).alias("n"), F.min("line").alias("first"))
    return counts.groupBy("doc_id", "start_line", "label").agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("dominant"))


def beside_reference(sections: DataFrame, total_lines: int, reference: str) -> DataFrame:
    """Every run's covered lines with the reference's: doc_id, label, line, line_type, line_label, ref_type, ref_label.

    A run with sections outside the document has one row without a line, so that no run is lost. Sections are
    dealt by document once; what follows groups by document and shuffles nothing, and uncovered lines are never made.
    """
    low, high = F.greatest(F.lit(1), "start_line").cast("int"), F.least(F.lit(total_lines), "end_line").cast("int")
    lines = sections.repartition("doc_id").withColumn("line", F.explode_outer(F.when(low <= high, F.sequence(low, high))))
    top = F.max_by(F.when(F.col("line").isNotNull(), F.struct("section_type", "section_label")), "ord")
    own = lines.groupBy("doc_id", "line", "label").agg(top.alias("s"))
    ref = F.max(F.when((F.col("label") == reference) & F.col("doc_id").isNotNull(), F.col("s"))).over(Window.partitionBy("doc_id", "line"))
    out = own.withColumn("r", ref).filter(F.col("label") != reference)
    named = {"line_type": "s.section_type", "line_label": "s.section_label", "ref_type": "r.section_type", "ref_label": "r.section_label"}
    return out.select("doc_id", "label", "line", *[F.col(c).alias(n) for n, c in named.items()])


def met_labels(beside: DataFrame) -> DataFrame:
    """The distinct (reference label, run label) that meet on a line: a, b."""
    return beside.filter("line_label != '' and ref_label != ''").select(F.col("ref_label").alias("a"), F.col("line_label").alias("b")).distinct()


def _compared(beside: DataFrame, similarity: DataFrame | None) -> DataFrame:
    agree = F.coalesce(F.col("line_type") == F.col("ref_type"), F.lit(False))
    if similarity is None:
        return beside.select("doc_id", "label", "line", agree.alias("agree"), F.lit(0.0).alias("sim"))
    pair = similarity.select(F.col("a").alias("ref_label"), F.col("b").alias("line_label"), "sim")
    return beside.join(pair, ["ref_label", "line_label"], "left").select("doc_id", "label", "line", agree.alias("agree"), F.coalesce("sim", F.lit(0.0)).alias("sim"))


def covered_scores(beside: DataFrame, total_lines: int, similarity: DataFrame | None = None) -> DataFrame:
    """``run_scores`` of all lines from the covered ones: the others neither agree nor are similar."""
    out = _compared(beside, similarity).groupBy("doc_id", "label").agg(F.count_if("agree").alias("n_agree"), F.sum("sim").alias("sim"))
    return out.select("doc_id", "label", "n_agree", (F.col("n_agree") / total_lines).alias("agreement"), (F.col("sim") / total_lines).alias("mean_sim"))


def covered_regions(beside: DataFrame, total_lines: int, threshold: float, similarity: DataFrame | None = None) -> DataFrame:
    """``flag_regions`` of all lines from the covered ones.

    A line that no run covers is flagged (similarity 0 in every run), so regions are the gaps between good lines: lines where every run
    agrees and is similar enough. Rows of the covered lines are counted into the gap that they lie in.
    """
    low, zero_low = F.col("sim") < threshold, F.lit(0.0 < threshold)
    ok = F.col("agree") & ~low
    lines = _compared(beside, similarity).groupBy("doc_id", "line").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("n_agree"), F.bool_or(low).alias("low"), F.min("sim").alias("worst"),
        F.collect_list(F.when(ok, F.col("label"))).alias("oks"), F.collect_set("label").alias("labels"),
    )
    doc, on = Window.partitionBy("doc_id"), F.col("line").isNotNull()
    lines = lines.withColumn("runs", F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels").over(doc)))))
    n_runs = F.size("runs")
    lines = lines.withColumn("good", on & (F.size("oks") == n_runs))
    before = F.sum(F.col("good").cast("int")).over(doc.orderBy(F.asc_nulls_first("line")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines = lines.withColumn("gap", before - F.col("good").cast("int"))  # a good line ends the gap before it
    bad, partial = on & ~F.col("good"), F.col("n") < n_runs
    gaps = lines.groupBy("doc_id", "gap").agg(
        F.count_if(bad).alias("n"), F.max(F.when(F.col("good"), F.col("line"))).alias("stop"), F.first("runs").alias("runs"),
        F.coalesce(F.bool_or(bad & (F.col("n_agree") < n_runs)), F.lit(False)).alias("mismatch"), F.coalesce(F.bool_or(bad & (F.col("low") | (partial & zero_low))), F.lit(False)).alias("low"),
        F.coalesce(F.sum(F.when(bad, F.when(partial, F.least("worst", F.lit(0.0))).otherwise(F.col("worst")))), F.lit(0.0)).alias("worst"),
        F.flatten(F.collect_list(F.when(bad, F.col("oks")))).alias("oks"),
    )
    order = doc.orderBy("gap")
    gaps = gaps.withColumns({"start": F.coalesce(F.lag("stop").over(order), F.lit(0)) + 1, "last": F.lead("gap").over(order).isNull()})
    names = ("start", "end", "n", "mismatch", "low", "worst", "oks")
    own = F.struct("start", (F.coalesce("stop", F.lit(total_lines + 1)) - 1).alias("end"), *names[2:])
    rest = F.struct((F.col("stop") + 1).alias("start"), F.lit(total_lines).alias("end"), F.lit(0).cast("long").alias("n"), F.lit(False).alias("mismatch"), F.lit(False).alias("low"), F.lit(0.0).alias("worst"), F.array().cast("array<string>").alias("oks"))
    found = gaps.select("doc_id", "runs", F.explode(F.when(F.col("last") & F.col("stop").isNotNull(), F.array(own, rest)).otherwise(F.array(own))).alias("g")).select("doc_id", "runs", *[F.col(f"g.{c}").alias(c) for c in names])
    size = F.col("end") - F.col("start") + 1
    bare = F.col("n") < size  # some of its lines are covered by no run
    mismatch, is_low = F.col("mismatch") | bare, F.col("low") | (bare & zero_low)
    kind = F.when(mismatch & is_low, "both").when(mismatch, "type_mismatch").otherwise("low_similarity")
    labels = F.filter("runs", lambda run: F.size(F.filter("oks", lambda x: x == run)) < size)
    return found.filter(size > 0).select(
        "doc_id", F.col("start").alias("start_line"), F.col("end").alias("end_line"), (F.col("worst") / size).alias("avg_sim"), kind.alias("issue_kind"), F.array_join(labels, ",").alias("disagreeing")
    )
