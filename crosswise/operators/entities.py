"""N-way entity resolution by tiers of keys, and everything read off its clusters.

Entries that share a key are tied to the key itself (a star, never all pairs), so a
key that a third of the entries share costs one edge each. A cluster's tier is the weakest that was
needed: the smallest k for which the keys of tiers up to k already connect it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosswise.functions.text import canonical_name
from crosswise.operators.components import connected_components
from crosswise.session import stage

#: Tiers from strongest to weakest, and how they are shown.
TIERS = ("inchi_key", "smiles", "molecular_formula", "name")
TIER_TEXT = {"inchi_key": "InChIKey", "smiles": "SMILES", "molecular_formula": "Formula (weak)", "name": "Name"}


def tier_text(tier):
    out = F.when(tier.isNull() | (tier == "single-model"), "—")
    for code, text in TIER_TEXT.items():
        out = out.when(tier == code, text)
    return out.otherwise(tier)


def name_pool(entries: DataFrame, ascii_only: bool = False) -> DataFrame:
    """``entries(ord, identifier, aliases)`` with ``names``: the distinct canonical forms of the identifier and all aliases."""
    each = entries.select("ord", F.explode(F.concat(F.array("identifier"), F.coalesce("aliases", F.expr("cast(array() as array<string>)")))).alias("n"))
    pool = each.select("ord", canonical_name(F.col("n"), ascii_only).alias("n")).groupBy("ord").agg(F.array_sort(F.collect_set("n")).alias("names"))
    return entries.drop("names").join(pool, "ord", "left")


def tier_keys(entries: DataFrame) -> DataFrame:
    """``entries(ord, doc_id, inchi_key, smiles, molecular_formula, names)`` -> (ord, doc_id, tier, key), tier by strength."""
    keys = F.array(*[
        F.struct(F.lit(k).alias("tier"), F.filter(F.array(F.nullif(F.trim(F.col(t)), F.lit(""))), lambda x: x.isNotNull()).alias("keys"))
        for k, t in enumerate(TIERS[:-1])
    ], F.struct(F.lit(len(TIERS) - 1).alias("tier"), F.col("names").alias("keys")))
    return entries.select("ord", "doc_id", F.explode(keys).alias("t")).select("ord", "doc_id", "t.tier", F.explode("t.keys").alias("key"))


def resolve(entries: DataFrame) -> DataFrame:
    """(ord, cluster_id, match_tier): the smallest ``ord`` of the cluster, and its weakest needed tier (NULL for a lone entry)."""
    # Long keys (whole texts) are dealt and compared by their SHA-256; the prefix makes them longer than any key that stands for itself.
    short = F.when(F.length("key") > 64, F.concat(F.lit("sha256:"), F.sha2("key", 256))).otherwise(F.col("key"))
    keyed = stage(tier_keys(entries).withColumn("key", short), "tier-keys")
    # The smallest entry of a key by a partial aggregate; the join then splits a hot key.
    anchors = stage(keyed.groupBy("doc_id", "tier", "key").agg(F.min("ord").alias("anchor"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "tier-anchors")
    anchored = keyed.join(anchors, ["doc_id", "tier", "key"])
    edges = stage(anchored.filter("ord <> anchor").select("tier", F.col("ord").alias("u"), F.col("anchor").alias("v")).distinct(), "tier-edges")
    parts = entries.select("ord")
    roots = None
    for k in range(len(TIERS)):
        # A tier starts from the components of the tiers before it.
        own = edges.filter(F.col("tier") == k).select("u", "v")
        roots = connected_components(own if roots is None else own.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v"))))
        parts = parts.join(roots.select(F.col("node").alias("ord"), F.col("root").alias(f"c{k}")), "ord", "left").withColumn(f"c{k}", F.coalesce(f"c{k}", "ord"))
    parts = stage(parts, "tier-parts")
    last = f"c{len(TIERS) - 1}"
    whole = parts.groupBy(last).agg(F.count(F.lit(1)).alias("n"), *[(F.min(f"c{k}") == F.max(f"c{k}")).alias(f"one{k}") for k in range(len(TIERS))])
    tier = F.when(F.col("n") > 1, F.coalesce(*[F.when(F.col(f"one{k}"), F.lit(t)) for k, t in enumerate(TIERS)]))
    return parts.join(whole.withColumn("match_tier", tier).select(last, "match_tier"), last).select("ord", F.col(last).alias("cluster_id"), "match_tier")


def members(entries: DataFrame, clusters: DataFrame, ascii_only: bool = False) -> DataFrame:
    """One representative per cluster and label: the longest identifier, the first of equals."""
    joined = entries.join(clusters, "ord")
    pick = F.max_by(F.struct("ord", "identifier"), F.struct(F.length("identifier"), -F.col("ord"))).alias("r")
    return joined.groupBy("cluster_id", "label").agg(pick, F.count(F.lit(1)).alias("entries"), F.first("match_tier").alias("match_tier")).select(
        "cluster_id", "label", "entries", "match_tier", F.col("r.ord").alias("ord"), F.col("r.identifier").alias("identifier"), canonical_name(F.col("r.identifier"), ascii_only).alias("canonical")
    )


def cluster_table(members_: DataFrame) -> DataFrame:
    """Clusters with membership, size, tier and sort name; order by size descending, then name, membership and id."""
    return members_.groupBy("cluster_id").agg(
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("membership"), F.count(F.lit(1)).alias("size"),
        F.first("match_tier").alias("match_tier"), F.min(F.coalesce("canonical", F.lit(""))).alias("name"),
    )


def label_counts(entries: DataFrame, members_: DataFrame) -> DataFrame:
    """Per label: entries, clusters it is in, and clusters that only it is in."""
    size = members_.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    own = members_.join(size, "cluster_id").groupBy("label").agg(F.count(F.lit(1)).alias("deduped"), F.count_if(F.col("size") == 1).alias("only"))
    return entries.groupBy("label").agg(F.count(F.lit(1)).alias("raw")).join(own, "label", "left").na.fill(0, ["deduped", "only"])


def pairwise_metrics(members_: DataFrame, baseline: str) -> DataFrame:
    """Every other label against ``baseline``: common, each side's own, recall and precision (NULL on empty sides)."""
    base = members_.filter(F.col("label") == baseline).select("cluster_id", F.lit(True).alias("in_base"))
    total = F.broadcast(base.agg(F.count(F.lit(1)).alias("n_base")))
    others = members_.filter(F.col("label") != baseline).join(base, "cluster_id", "left")
    counts = others.groupBy("label").agg(F.count_if(F.col("in_base")).alias("common"), F.count_if(F.col("in_base").isNull()).alias("other_only"))
    out = counts.crossJoin(total)
    return out.select(
        "label", "common", (F.col("n_base") - F.col("common")).alias("baseline_only"), "other_only",
        F.try_divide(F.col("common").cast("double"), F.col("n_base").cast("double")).alias("recall"),
        F.try_divide(F.col("common").cast("double"), (F.col("common") + F.col("other_only")).cast("double")).alias("precision"),
    )


def upset(clusters: DataFrame) -> DataFrame:
    """Intersection sizes: how many clusters have each exact membership."""
    return clusters.groupBy("membership").agg(F.count(F.lit(1)).alias("n"))


def only_entries(members_: DataFrame) -> DataFrame:
    """Representatives of the clusters that one label alone is in."""
    alone = members_.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select("cluster_id")
    return members_.join(alone, "cluster_id", "left_semi")


def matched_pairs(members_: DataFrame, first: str, second: str) -> DataFrame:
    """Full outer view of two labels over clusters: both, or one side alone."""
    side = lambda label, name: members_.filter(F.col("label") == label).select("cluster_id", F.col("identifier").alias(name))
    kind = F.when(F.col("a").isNull(), "second_only").when(F.col("b").isNull(), "first_only").otherwise("both")
    return side(first, "a").join(side(second, "b"), "cluster_id", "full_outer").withColumn("kind", kind)


def cluster_grid(members_: DataFrame, labels: list[str], min_labels: int = 1) -> DataFrame:
    """One row per cluster of ``min_labels`` labels or more: membership, size, one column per label with its identifier (empty where it has none), and the sort name."""
    wide = members_.groupBy("cluster_id").pivot("label", labels).agg(F.first("identifier"))
    table = cluster_table(members_).filter(F.col("size") >= min_labels).withColumn("membership", F.replace("membership", F.lit(","), F.lit(", ")))
    return table.join(wide, "cluster_id").na.fill("", labels).select("cluster_id", "membership", "size", *[F.col(f"`{x}`") for x in labels], "name")


def by_consensus(table: DataFrame) -> DataFrame:
    """Clusters by size, largest first, then by their first canonical name; the id settles what is left."""
    return table.orderBy(F.desc("size"), "name", "cluster_id")


def with_members(members_: DataFrame, required: list[str]) -> DataFrame:
    """Clusters whose labels are exactly the required ones."""
    held = members_.groupBy("cluster_id").agg(F.array_sort(F.collect_set("label")).alias("labels"))
    return held.filter(F.col("labels") == F.array_sort(F.array_distinct(F.array(*map(F.lit, required))))).select("cluster_id")


def containing(members_: DataFrame, label: str) -> DataFrame:
    """Clusters that a label is in."""
    return members_.filter(F.col("label") == label).select("cluster_id").distinct()


def identifier_types(entries: DataFrame) -> DataFrame:
    """Per label how many entries each type of identifier has; a missing type is a type."""
    return entries.groupBy("label", "identifier_type").agg(F.count(F.lit(1)).alias("n"))
