"""Sharding by proportional stratified interleaving (operator 10).

Rows of each source are put in a seeded random order; row r of n gets the
fractional rank (r + 0.5) / n; all rows are sorted by it and cut into shards of
equal row counts. Any stretch of that order holds each source in its share, so
every shard matches the mixture.

Both ranks are exact and made without a group in one task: rows fall into
buckets of hashed order within their source (a hot source has many), only
counts are summed up across buckets, and ``row_number`` runs inside a bucket.
The second sort does the same with buckets of the fractional rank. Both shuffles
carry ids and sizes, never texts.

Defined results: null texts count no bytes and have crc 0; null and repeated
doc_ids are rows like others; null sources are a source; ties in the seeded
order go by doc_id, crc and size (rows alike in all of these are
interchangeable); fewer rows than shards leave shards empty; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosswise.session import stage

#: Buckets are counted on the driver or in one window: this bounds them at any input size.
MOST_BUCKETS = 4096


def _bucket(order: str, buckets) -> F.Column:
    """The bucket of a uniform 62-bit order."""
    return F.least(F.floor(F.col(order) / F.lit(float(2**62)) * buckets).cast("int"), (buckets - 1).cast("int"))


def interleave(docs: DataFrame, shards: int = 40, seed: int = 7, rows_a_bucket: int = 4096, overhead: int = 16) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for each row of ``docs(doc_id, text, source)``."""
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select(
        "doc_id", "source",
        (F.octet_length(body) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("r", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"), 2))
    slim = stage(slim, "shard-rows")

    per_source = slim.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    per_source = per_source.withColumn("nb", F.least(F.ceil(F.col("n") / rows_a_bucket), F.lit(MOST_BUCKETS)).cast("int"))
    # Each bucket's offset in its source: counts of coarse cells, at most MOST_BUCKETS a source.
    cells = slim.withColumn("cell", _bucket("r", F.lit(MOST_BUCKETS))).groupBy("source", "cell").agg(F.count(F.lit(1)).alias("k"))
    cells = cells.join(per_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    cells = cells.withColumn("b", F.floor(F.col("cell") * F.col("nb") / MOST_BUCKETS).cast("int"))
    buckets = cells.groupBy("source", "b").agg(F.sum("k").alias("k"), F.first("n").alias("n"), F.first("nb").alias("nb"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("base", F.coalesce(F.sum("k").over(before), F.lit(0)))
    # A row finds its bucket by (source, cell), which spreads a hot source over many keys.
    ways = cells.select("source", "cell", "b").join(
        buckets.select(F.col("source").alias("s"), F.col("b").alias("b2"), "n", "base"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("b2")),
    ).select(F.col("source").alias("s"), F.col("cell").alias("c"), "b", "n", "base")
    placed = slim.withColumn("cell", _bucket("r", F.lit(MOST_BUCKETS))).join(
        ways, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))
    ).drop("s", "c", "cell")
    inside = Window.partitionBy("source", "b").orderBy("r", "doc_id", "text_crc32", "size")
    ranked = placed.withColumn("rank", F.col("base") + F.row_number().over(inside) - 1).withColumn("f", (F.col("rank") + 0.5) / F.col("n"))
    ranked = stage(ranked.select("doc_id", "source", "size", "text_crc32", "r", "f"), "shard-ranks")

    total = ranked.count()
    if not total:
        return ranked.select("doc_id", "source", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    nb = max(1, min(MOST_BUCKETS, -(-total // rows_a_bucket)))
    ranked = ranked.withColumn("g", F.least(F.floor(F.col("f") * nb), F.lit(nb - 1)).cast("int"))
    count = {row.g: row.k for row in ranked.groupBy("g").agg(F.count(F.lit(1)).alias("k")).collect()}  # at most MOST_BUCKETS rows
    bases, at = [], 0
    for g in range(nb):
        bases.append(at)
        at += count.get(g, 0)
    base = F.element_at(F.array(*[F.lit(x).cast("long") for x in bases]), F.col("g") + 1)
    nth = F.row_number().over(Window.partitionBy("g").orderBy("f", "source", "r", "doc_id", "text_crc32", "size"))
    # Shard s holds positions from ceil(s * total / shards): counts differ by one at most.
    dealt = ranked.withColumn("at", base + nth - 1).withColumn("shard", F.expr(f"cast(at * {shards} div {total} as int)"))
    slot = F.expr(f"at - (cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return dealt.select("doc_id", "source", "size", "text_crc32", "shard", slot.alias("slot"))
