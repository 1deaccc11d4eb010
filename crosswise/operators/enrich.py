"""Enrichment: names to structures, and texts to vectors, each distinct value once.

Resolvers, canonicalisers and embedders are injected. Distinct values are taken first, computed in
Arrow batches and joined back; a resolver's lookup table, negative results too, is itself a DataFrame
that later runs can start from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosswise.functions.text import blank_to_null, looks_like_markush
from crosswise.session import ship, stage

#: Roles that count in a record's compound set, and roles that never do.
SET_ROLES = ("product", "reactant", "reagent", "catalyst", "ligand", "base", "acid", "oxidant", "reductant")
EXCLUDED_ROLES = ("solvent", "drying_agent", "additive", "by_product", "other")

Embed = Callable[[list[str]], list[list[float]]]


def role_counts(role: Column, is_product: Column) -> Column:
    """Whether a compound of this role belongs to the set; without a known role, a product does."""
    r = F.lower(blank_to_null(role))
    return F.when(r.isin(*EXCLUDED_ROLES), False).when(r.isin(*SET_ROLES), True).otherwise(F.coalesce(is_product, F.lit(False)))


def plain_canonical(smiles: str | None) -> str | None:
    """Stands in for a chemistry library's canonical form: the stripped text. It is not chemically faithful."""
    return (smiles or "").strip() or None


def hashed_embedding(texts: list[str], dim: int = 64) -> list[list[float]]:
    """Unit vectors of hashed character trigrams: a deterministic stand-in for a neural embedder."""
    out = []
    for t in texts:
        v = np.zeros(dim)
        t = f"  {t.lower()} "
        for k in range(len(t) - 2):
            h = int.from_bytes(hashlib.blake2b(t[k : k + 3].encode(), digest_size=8).digest(), "little")
            v[h % dim] += 1.0 if h >> 32 & 1 else -1.0
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def embedded(df: DataFrame, text: str, out: str, embed: Embed = hashed_embedding) -> DataFrame:
    """``df`` with ``out``: the vector of each non-blank text; each distinct text is embedded once."""

    @F.pandas_udf("array<double>")
    def vectors(x: pd.Series) -> pd.Series:
        return pd.Series(embed(x.tolist()))

    ship(df.sparkSession)
    distinct = df.filter(blank_to_null(F.col(text)).isNotNull()).select(F.col(text).alias("__t")).distinct()
    return df.join(distinct.withColumn(out, vectors("__t")), F.col(text) == F.col("__t"), "left").drop("__t")


def fill_vectors(df: DataFrame, vector: str, text: str, embed: Embed = hashed_embedding) -> DataFrame:
    """Existing vectors stay; missing ones come from the text."""
    made = embedded(df, text, "__v", embed)
    return made.withColumn(vector, F.coalesce(vector, "__v")).drop("__v")


def procedure_text(summary: Column, text: Column) -> Column:
    return F.coalesce(blank_to_null(summary), blank_to_null(text))


def reaction_text(reactants: Column, product: Column) -> Column:
    """r1.r2>>p, or NULL without a product or reactants."""
    have = F.filter(reactants, lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.when((F.size(have) > 0) & blank_to_null(product).isNotNull(), F.concat(F.array_join(have, "."), F.lit(">>"), blank_to_null(product)))


def lookup(names: DataFrame, resolve: Callable[[str], str | None] | None, canonical: Callable[[str | None], str | None] = plain_canonical, known: DataFrame | None = None) -> DataFrame:
    """(name, structure) for distinct ``names(name)``; generic names and failures get NULL; ``known`` rows are not asked again."""

    @F.pandas_udf("string")
    def ask(x: pd.Series) -> pd.Series:
        def one(name):
            try:
                return canonical(resolve(name))
            except Exception:  # noqa: BLE001  a resolver may fail in any way; that is a negative result
                return None

        return x.map(one)

    ship(names.sparkSession)
    new = names.select(blank_to_null(F.col("name")).alias("name")).filter("name is not null").distinct()
    if known is not None:
        new = new.join(known.select("name"), "name", "left_anti")
    generic = looks_like_markush(F.col("name"))
    found = new.withColumn("structure", F.when(~generic, ask("name")) if resolve else F.lit(None).cast("string"))
    return found if known is None else known.select("name", "structure").unionByName(found)


def candidates(records: DataFrame, *more: Column, outer: bool = False) -> DataFrame:
    """(doc_id, ord, rank, structure, name, is_product) of a record's product, reactants and counting compounds, and ``more``.

    ``records`` has ``compounds array<struct<smiles, name, role, is_product>>``. With ``outer``, a record without any has a row of NULLs.
    """
    pair = lambda s, n, p: F.struct(s.alias("structure"), n.alias("name"), p.alias("is_product"))
    no = F.lit(False)
    tops = F.array(pair(F.col("product_smiles"), F.col("product_name"), F.lit(True)))
    reactants = F.transform(F.arrays_zip("reactant_smiles", "reactant_names"), lambda x: pair(x["reactant_smiles"], x["reactant_names"], no))
    more_pairs = F.transform(
        F.filter(F.coalesce("compounds", F.expr("cast(array() as array<struct<smiles:string,name:string,role:string,is_product:boolean>>)")), lambda c: role_counts(c["role"], c["is_product"])),
        lambda c: pair(c["smiles"], c["name"], F.coalesce(c["is_product"], no)),
    )
    each = (F.posexplode_outer if outer else F.posexplode)(F.concat(tops, reactants, more_pairs)).alias("rank", "c")
    out = records.select("doc_id", "ord", *more, each)
    return out.select("doc_id", "ord", *out.columns[2:-2], "rank", "c.structure", "c.name", "c.is_product")


def structures(pairs: DataFrame, resolve: Callable[[str], str | None] | None, canonical: Callable[[str | None], str | None] = plain_canonical, known: DataFrame | None = None) -> DataFrame:
    """(structure, name, s) for distinct ``pairs(structure, name)``: the canonical structure, else its name's; pairs without either are left out. Each distinct structure and name is asked for once."""
    canon = F.pandas_udf(lambda x: x.map(canonical), "string")
    ship(pairs.sparkSession)
    forms = pairs.select(F.col("structure").alias("form")).distinct().withColumn("own", canon("form"))
    own = stage(pairs.join(forms, F.col("structure").eqNullSafe(F.col("form"))).drop("form"), "structures-own")
    asked = lookup(own.filter("own is null").select("name"), resolve, canonical, known).select(F.col("name").alias("key"), F.col("structure").alias("resolved"))
    found = own.withColumn("key", F.when(F.col("own").isNull(), blank_to_null(F.col("name")))).join(asked, "key", "left")
    return found.select("structure", "name", F.coalesce("own", F.when(~looks_like_markush(F.col("key")), F.col("resolved"))).alias("s")).filter("s is not null")


def with_structures(records: DataFrame, resolve: Callable[[str], str | None] | None = None, canonical: Callable[[str | None], str | None] = plain_canonical, known: DataFrame | None = None, keep: Iterable[str] | None = None) -> DataFrame:
    """``records`` with product_smiles from the ladder (its own, its name's, a product compound's) and the set compound_smiles.

    Distinct pairs of structure and name are settled first, in a table that is as large as they are many; the records are then
    grouped by (doc_id, ord) once, with the other columns (``keep`` names those that are wanted), and are not joined again.
    """
    columns = [c for c in records.columns if c not in ("doc_id", "ord", "compound_smiles") and (keep is None or c in ("product_smiles", *keep))]
    settled = stage(structures(stage(candidates(records).select("structure", "name").distinct(), "structure-pairs"), resolve, canonical, known), "structures")
    settled = settled.select(F.col("structure").alias("structure_"), F.col("name").alias("name_"), "s")
    each = candidates(records, F.struct(*columns).alias("record"), outer=True)
    each = each.join(settled, F.col("structure").eqNullSafe(F.col("structure_")) & F.col("name").eqNullSafe(F.col("name_")), "left")
    s, first = F.when(F.col("rank").isNotNull(), F.col("s")), F.coalesce("rank", F.lit(0)) == 0
    product = F.min_by(s, F.when(F.col("is_product") & s.isNotNull(), F.col("rank")))
    sets = each.groupBy("doc_id", "ord").agg(F.collect_list(F.when(first, F.col("record"))).alias("rs"), F.collect_set(s).alias("set"), product.alias("product"))
    keyed = F.col("doc_id").isNotNull() & F.col("ord").isNotNull()
    sets = sets.select("doc_id", "ord", F.explode("rs").alias("r"), F.when(keyed & (F.size("set") > 0), F.array_sort("set")).alias("compound_smiles"), F.when(keyed, F.col("product")).alias("product"))
    value = lambda c: F.coalesce("product", F.col("r")[c]) if c == "product_smiles" else F.col("r")[c]
    return sets.select("doc_id", "ord", *[value(c).alias(c) for c in columns], "compound_smiles")


def coverage(records: DataFrame) -> DataFrame:
    """Per label the share of records with a non-empty compound set."""
    return records.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.size("compound_smiles"), F.lit(0)) > 0).alias("filled"))
