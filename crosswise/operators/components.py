"""Connected components by alternating large-star and small-star rounds.

Every round is a partial-aggregated minimum and an equi-join, so a vertex with
many neighbours is split by map-side combining and AQE; nothing is collected.
Rounds are written to the shared folder, which keeps the lineage one round deep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.session import stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(lowest, "u").filter(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(lowest, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(lowest.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` -> ``(node, root)`` for every non-minimal vertex of a component.

    ``root`` is the smallest vertex of the component; a vertex that is missing
    from the result is its own root. Self-loops, repeated and null edges have no effect.
    """
    now = stage(edges.filter(F.col("u") != F.col("v")).select("u", "v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        found = now.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
        ).first()
        mark = (found["n"], found["h"])
        if mark == before or mark[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
        now = stage(_small_star(_large_star(now)), "edges")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
