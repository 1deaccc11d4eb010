"""String functions over columns, with the Unicode behaviour that matching relies on.

Java's ``\\s`` and ``trim`` are ASCII-only, so white space always goes through ``(?U)``. NFKC and
full case folding have no native form: ASCII rows stay native and only others pass an Arrow UDF.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ASCII = r"^\p{ASCII}*$"


@F.pandas_udf(StringType())
def _nfkc(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(StringType())
def _casefold(x: pd.Series) -> pd.Series:
    return x.map(lambda v: None if v is None else v.casefold())


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    """Stripped text; NULL where nothing is left."""
    return F.nullif(strip(x), F.lit(""))


def casefold(x: Column, ascii_only: bool = False) -> Column:
    """Full case folding; ``ascii_only`` promises ASCII input and keeps the plan free of Python."""
    return F.lower(x) if ascii_only else F.when(x.rlike(ASCII), F.lower(x)).otherwise(_casefold(x))


def canonical_name(x: Column, ascii_only: bool = False) -> Column:
    """Compatibility form, single spaces, lower case, no spaces around hyphens, no trailing punctuation; NULL if empty."""
    x = x if ascii_only else F.when(x.rlike(ASCII), x).otherwise(_nfkc(x))
    x = F.lower(strip(F.regexp_replace(x, r"(?U)\s+", " ")))
    x = F.regexp_replace(x, r"(?U)\s*-\s*", "-")
    return F.nullif(F.regexp_replace(x, r"[.,;]+$", ""), F.lit(""))


def step_label(x: Column, ascii_only: bool = False) -> Column:
    """Folded label with underscores and white space as single spaces; NULL if empty."""
    return F.nullif(strip(F.regexp_replace(casefold(F.replace(x, F.lit("_"), F.lit(" ")), ascii_only), r"(?U)\s+", " ")), F.lit(""))


def diagnostic_label(section: Column, step: Column) -> Column:
    """Section and step as one lower-case key; NULL if both are missing or the key is empty."""
    s, t = (F.lower(strip(F.coalesce(x, F.lit("")))) for x in (section, step))
    return F.nullif(F.concat(s, F.when(t == "", "").otherwise(F.concat(F.lit(" | "), t))), F.lit(""))


def strip_atom_maps(x: Column) -> Column:
    return F.regexp_replace(x, r":\d+\]", "]")


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / longer length, in code points; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(F.lit(1.0) - F.levenshtein(a, b) / longer)


def class_words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(x), "[^a-z0-9]", " "), r"\s+"), lambda w: w != ""))


def classes_match(a: Column, b: Column) -> Column:
    """Whether the words of one class name are all among the other's; false if either has none."""
    return words_match(class_words(a), class_words(b))


def words_match(x: Column, y: Column) -> Column:
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return both & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


#: Patterns of names that stand for generic structures.
BARE_CLASS = r"^(hal|halogen|alkyl|aryl|heteroaryl|alkoxy|r\d*|x|y|z)$"
FORMULA = r"\b(?:compound\s+of\s+)?formula\s*\(?\s*[ivx\d]+\s*\)?"
SHORT_GROUP = r"^[rxyzm]+[-]?(?:oh|or|om|h|x)?$"
GENERIC_STARTS = ("r-", "r1", "r2", "r3")
GENERIC_WORDS = ("alkoxy", "aryl group", "alkyl group", "r group", "protecting group")


def looks_like_markush(name: Column) -> Column:
    """Whether a name stands for a generic structure; blank names do."""
    n = F.lower(strip(F.coalesce(name, F.lit(""))))
    found = (n == "") | n.rlike(BARE_CLASS) | n.rlike(FORMULA) | ((F.length(n) <= 5) & n.rlike(SHORT_GROUP))
    for x in GENERIC_STARTS:
        found = found | n.startswith(x)
    for x in GENERIC_WORDS:
        found = found | n.contains(x)
    return found


def colour_index(value: Column, palette: int = 8) -> Column:
    """A stable palette index from the whole md5 of the folded value; NULL for blank values and for none, which are gray."""
    v = blank_to_null(value)
    digits = F.md5(casefold(v, True))
    # The digest modulo the palette, four hex digits at a time.
    index = F.lit(0).cast("long")
    for k in range(8):
        index = (index * 65536 + F.conv(F.substring(digits, 4 * k + 1, 4), 16, 10).cast("long")) % palette
    return F.when(v.isNotNull() & (v != "(none)"), index)


def rate_text(x: Column) -> Column:
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.format_string("%.1f%%", F.bround(x * 100, 1)))  # ties to even
