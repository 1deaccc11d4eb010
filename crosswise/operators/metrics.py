"""Adjudication, grids, metrics and ranking. Grids stay long (row key, model, value); pivot is for output only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosswise.functions.text import casefold, strip

NONE = "(none)"


def vote_key(value: Column, ascii_only: bool = False) -> Column:
    """Folded vote; blank and missing values vote for none."""
    folded = casefold(strip(value), ascii_only)
    return F.when(value.isNull() | (strip(value) == ""), NONE).otherwise(folded)


def majority(votes: DataFrame, key: list[str], value: str = "value", order: str = "ord", tiebreak: DataFrame | None = None, ascii_only: bool = False) -> DataFrame:
    """The commonest folded value per key, shown as first seen; NULL if none wins.

    Ties go to the key's ``tiebreak(key..., tie)`` value if it is among them, else to the first by folded text.
    """
    counted = votes.withColumn("fold", vote_key(F.col(value), ascii_only)).groupBy(*key, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(strip(F.col(value)), F.col(order)).alias("shown")
    )
    if tiebreak is not None:
        counted = counted.join(tiebreak.select(*key, vote_key(F.col("tie"), ascii_only).alias("tie")), key, "left")
        preferred = F.coalesce(F.col("fold") == F.coalesce("tie", F.lit(NONE)), F.lit(False))
    else:
        preferred = F.col("fold") == NONE
    best = F.struct(-F.col("n"), (~preferred).cast("int"), F.col("fold"))
    won = counted.groupBy(*key).agg(F.min_by(F.struct("fold", "shown"), best).alias("w"))
    return won.select(*key, F.when(F.col("w.fold") != NONE, F.col("w.shown")).alias("winner"))


def presence_grid(members: DataFrame, cluster: str = "cluster_id", label: str = "label", tie_label: str | None = None) -> DataFrame:
    """Long presence grid with the adjudicated baseline: present in over half of the labels; on a tie, as ``tie_label`` has it."""
    labels = members.select(label).distinct()
    total = labels.agg(F.count(F.lit(1)).alias("n_labels"))
    have = members.select(cluster, label).distinct()
    per = have.groupBy(cluster).agg(F.count(F.lit(1)).alias("k"), F.max((F.col(label) == F.lit(tie_label)).cast("int")).alias("tie"))
    base = F.when(F.col("k") * 2 == F.col("n_labels"), F.coalesce(F.col("tie") == 1, F.lit(False))).otherwise(F.col("k") * 2 > F.col("n_labels"))
    # Labels are a handful of runs: the counted table of them is a dimension.
    grid = per.crossJoin(F.broadcast(total)).select(cluster, base.alias("baseline")).crossJoin(F.broadcast(labels))
    return grid.join(have.withColumn("present", F.lit(True)), [cluster, label], "left").na.fill(False, ["present"])


def cluster_baselines(members: DataFrame, fields: list[str], order: str = "ord", tie_label: str | None = None, n_labels: int | None = None, ascii_only: bool = False) -> DataFrame:
    """Per cluster whether it counts as present, and for each field the majority of the labels that are in it; ties go to ``tie_label``'s value.

    ``members`` has one row per cluster and label. ``n_labels``: how many labels were run, else those that occur.
    """
    total = n_labels if n_labels is not None else members.select("label").distinct().count()
    own = F.coalesce(F.col("label") == F.lit(tie_label), F.lit(False))
    k, tie = F.countDistinct("label"), F.bool_or(own)
    out = members.groupBy("cluster_id").agg(F.when(k * 2 == total, tie).otherwise(k * 2 > total).alias("present"))
    for field in fields:
        ties = members.filter(own).select("cluster_id", F.col(field).alias("tie"))
        won = majority(members, ["cluster_id"], field, order, ties, ascii_only).withColumnRenamed("winner", field)
        out = out.join(won, "cluster_id", "left")
    return out


def presence_stats(grid: DataFrame, label: str = "label") -> DataFrame:
    """Per model precision, recall and F1 against the baseline; NULL on empty denominators, F1 0 when both are 0."""
    counts = grid.groupBy(label).agg(
        F.count_if(F.col("present") & F.col("baseline")).alias("tp"), F.count_if(F.col("present") & ~F.col("baseline")).alias("fp"),
        F.count_if(~F.col("present") & F.col("baseline")).alias("fn"),
    )
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    out = counts.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))
    both = F.col("precision") + F.col("recall")
    f1 = F.when(both == 0, F.lit(0.0)).otherwise(F.try_divide(2 * F.col("precision") * F.col("recall"), both))
    return out.withColumn("f1", f1)


def field_accuracy(grid: DataFrame, label: str = "label", ascii_only: bool = False) -> DataFrame:
    """``grid(label, value, baseline)``: folded matches over rows whose baseline is not none; a missing value is a miss."""
    known = grid.filter(vote_key(F.col("baseline"), ascii_only) != NONE)
    hit = vote_key(F.col("value"), ascii_only) == vote_key(F.col("baseline"), ascii_only)
    return known.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits")).withColumn("accuracy", F.col("hits") / F.col("n"))


def pivoted(grid: DataFrame, key: str, label: str, labels: list[str], value: str, default=None) -> DataFrame:
    """One row per key, one column per label."""
    wide = grid.groupBy(key).pivot(label, labels).agg(F.first(value))
    return wide.select(key, *[F.coalesce(F.col(x), F.lit(default)).alias(x) if default is not None else F.col(x) for x in labels])


def field_options(values: DataFrame, value: str, order: str, ascii_only: bool = False) -> DataFrame:
    """Distinct values by folded text, shown as first seen, with none before all others: (rank, shown)."""
    seen = values.filter(vote_key(F.col(value), ascii_only) != NONE).groupBy(vote_key(F.col(value), ascii_only).alias("fold"))
    shown = seen.agg(F.min_by(strip(F.col(value)), F.col(order)).alias("shown"))
    # The options of one field are few: they are shown in one list.
    ranked = shown.withColumn("rank", F.row_number().over(Window.orderBy("fold"))).select("rank", "shown")
    return ranked.unionAll(values.sparkSession.range(1).select(F.lit(0).alias("rank"), F.lit(NONE).alias("shown")))


def keep_confirmed(rows: DataFrame, presence: DataFrame, key: str, ascii_only: bool = False) -> DataFrame:
    """Rows whose folded key is confirmed by the presence baseline; keys without a presence row are dropped."""
    keys = presence.filter("baseline").select(vote_key(F.col(key), ascii_only).alias("__k")).distinct()
    return rows.join(keys, vote_key(F.col(key), ascii_only) == F.col("__k"), "left_semi")


def drop_rows(rows: DataFrame, deleted: DataFrame, key: str, ascii_only: bool = False) -> DataFrame:
    """Rows whose folded key is not in the list of deleted ones."""
    keys = deleted.select(vote_key(F.col(key), ascii_only).alias("__k")).distinct()
    return rows.join(keys, vote_key(F.col(key), ascii_only) == F.col("__k"), "left_anti")


def apply_edits(grid: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Edited cells over a seeded grid: the edit where there is one."""
    changed = edits.select(*keys, F.col(value).alias("__new"), F.lit(True).alias("__edited"))
    return grid.join(changed, keys, "left").withColumn(value, F.when(F.col("__edited"), F.col("__new")).otherwise(F.col(value))).drop("__new", "__edited")


def clean(x: Column) -> Column:
    """NULL for NaN, which Spark would sort above all numbers."""
    return F.when(~F.isnan(x), x)


def ranked(stats: DataFrame, weights: dict[str, float], ties: list[str]) -> DataFrame:
    """Composite score and competition rank (1, 1, 3).

    The composite is the weighted mean of the metrics that are there (their plain mean if their weights
    sum to 0; all weights 0 count as equal); missing metrics sort lowest. ``ties`` break ties, descending.
    """
    if all(w == 0 for w in weights.values()):
        weights = {k: 1.0 for k in weights}
    there = {k: clean(F.col(k)).isNotNull() for k in weights}
    total = lambda f: sum((F.when(there[k], f(k)).otherwise(F.lit(0.0)) for k in weights), F.lit(0.0))
    num, den, n, plain = total(lambda k: F.lit(weights[k]) * F.col(k)), total(lambda k: F.lit(weights[k])), total(lambda k: F.lit(1.0)), total(F.col)
    composite = F.when(den != 0, F.try_divide(num, den)).otherwise(F.try_divide(plain, n))
    scored = stats.withColumn("composite", composite)
    # One row per model: the table being ranked is a report of a handful of rows.
    order = Window.orderBy(*[clean(F.col(c)).desc_nulls_last() for c in ["composite", *ties]])
    return scored.withColumn("rank", F.rank().over(order))


def join_stats(presence: DataFrame, *accuracies: DataFrame, label: str = "label") -> DataFrame:
    """Full outer join of metric tables on the model."""
    for x in accuracies:
        presence = presence.join(x, label, "full_outer")
    return presence


def melted(stats: DataFrame, label: str, metrics: list[str]) -> DataFrame:
    """(label, metric, score) of the metrics that are there."""
    return stats.unpivot([label], metrics, "metric", "score").filter(F.col("score").isNotNull())
