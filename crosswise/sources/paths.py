"""The layout of stored artifacts: identifiers, buckets and paths, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespace of DNS names for version-5 identifiers, bucket count, the baseline pipeline.
DNS_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"
BUCKETS = 128
BASELINE_PIPELINE = "section-wise-v1"


def uuid5(name: Column) -> Column:
    """The version-5 identifier of a name in the DNS namespace."""
    s = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(s, a, n)
    variant = F.substring(F.lit("89ab"), F.conv(part(17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


_MASK = 0xFFFFFFFF


def _bound(x: Column, f) -> Column:
    """``f(x)`` with x evaluated once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def _times(x: Column, c: int) -> Column:
    """Product modulo 2^32 of a 32-bit number held in a long, in halves so that no long overflows."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c), (F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF))
    return (low + F.shiftleft(high, 16)).bitwiseAND(F.lit(_MASK))


def _turned(x: Column, by: int) -> Column:
    return F.shiftleft(x, by).bitwiseOR(F.shiftright(x, 32 - by)).bitwiseAND(F.lit(_MASK))


def _little_endian(digits: Column) -> Column:
    """Eight hex digits as the number whose lowest byte comes first."""
    return F.conv(F.concat(*[F.substring(digits, k, 2) for k in (7, 5, 3, 1)]), 16, 10).cast("long")


def murmur3(name: Column) -> Column:
    """MurmurHash3 x86 32-bit of a text's UTF-8 bytes with seed 0, as an unsigned number (Spark's own hash has another seed and tail rule)."""
    scrambled = lambda k: _bound(_bound(_times(k, 0xCC9E2D51), lambda x: _turned(x, 15)), lambda x: _times(x, 0x1B873593))
    body, n = F.encode(name, "UTF-8"), F.octet_length(name).cast("long")
    digits, whole = F.hex(body), F.floor(n / 4).cast("int")
    starts = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    blocks = F.transform(starts, lambda i: _little_endian(F.substring(digits, i * 8 + 1, F.lit(8))))
    mixed = F.aggregate(blocks, F.lit(0).cast("long"), lambda h, k: (_bound(h.bitwiseXOR(scrambled(k)), lambda x: _turned(x, 13)) * 5 + F.lit(0xE6546B64)).bitwiseAND(F.lit(_MASK)))
    tail = _bound(_little_endian(F.rpad(F.substring(digits, whole * 8 + 1, F.lit(6)), 8, "0")), lambda x: x)
    out = mixed.bitwiseXOR(scrambled(tail)).bitwiseXOR(n)
    out = _bound(out, lambda h: _times(h.bitwiseXOR(F.shiftright(h, 16)), 0x85EBCA6B))
    out = _bound(out, lambda h: _times(h.bitwiseXOR(F.shiftright(h, 13)), 0xC2B2AE35))
    return _bound(out, lambda h: h.bitwiseXOR(F.shiftright(h, 16)))


def hash_bucket(name: Column) -> Column:
    """The bucket of a name; the hash's sign does not matter, as buckets divide 2^32."""
    return F.pmod(murmur3(name), F.lit(BUCKETS)).cast("int")


def country_code(name: Column) -> Column:
    letters = F.upper(F.substring(F.regexp_replace(name, r"[^\p{L}]", ""), 1, 2))
    return F.when(F.length(letters) == 2, letters).otherwise("XX")


def base_path(name: Column, bucket: Column | None = None) -> Column:
    return F.concat_ws("/", F.lit("literature/patents"), country_code(name), (hash_bucket(name) if bucket is None else bucket).cast("string"), uuid5(name))


def resolved_base(names: DataFrame, files: DataFrame) -> DataFrame:
    """``names(name)`` with base and moved: the computed base path where ``files(path)`` has anything under it, else the lowest other bucket that has, else the computed one.

    All buckets are looked at in one join on (country, identifier), which the bucket does not change.
    """
    named = names.withColumns({"country": country_code(F.trim("name")), "id": uuid5(F.trim("name")), "computed": hash_bucket(F.trim("name"))})
    part = lambda k: F.regexp_extract("path", r"^literature/patents/([^/]+)/(\d{1,3})/([^/]+)", k)
    there = files.select(part(1).alias("country"), part(2).try_cast("int").alias("bucket"), F.substring(part(3), 1, 36).alias("id"))
    there = there.filter((F.col("bucket") >= 0) & (F.col("bucket") < BUCKETS)).distinct()
    best = F.min(F.struct((F.col("bucket") != F.col("computed")).alias("moved"), "bucket"))
    found = named.join(there, ["country", "id"], "left").groupBy("name", "country", "id", "computed").agg(best.alias("b"))
    bucket = F.coalesce("b.bucket", "computed").cast("string")
    moved = F.coalesce(F.when(F.col("b.bucket").isNotNull(), F.col("b.moved")), F.lit(False))
    return found.select("name", F.concat_ws("/", F.lit("literature/patents"), "country", bucket, "id").alias("base"), moved.alias("moved"), F.col("b.bucket").isNotNull().alias("found"))


def artifact_path(base: Column, pipeline: Column, kind: str) -> Column:
    """Where a run's artifact lies; compounds and reactions of the baseline pipeline stand at the root."""
    run = F.concat(base, F.lit("/extraction/"), pipeline, F.lit("/"))
    if kind == "prepass":
        return F.concat(run, F.lit("pre-pass-"))
    if kind == "r1":
        return F.concat(run, F.lit("reaction-pass-1-consolidated.json"))
    if kind in ("compounds", "reactions"):
        return F.concat(F.when(pipeline == BASELINE_PIPELINE, F.concat(base, F.lit("/"))).otherwise(run), F.lit(f"{kind}.json"))
    raise ValueError(f"unknown artifact kind {kind!r}")


def markdown_paths(base: Column) -> list[Column]:
    """The preferred place of a document's markdown, then the legacy one."""
    return [F.concat(base, F.lit("/enriched/en/markdown.md")), F.concat(base, F.lit("/en/markdown.md"))]


def latest_by_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """The lexicographically last path that starts with ``prefix``."""
    return files.filter(F.col("path").startswith(prefix)).agg(F.max("path").alias("path")).filter("path is not null")


def fetch_preferred(names: DataFrame, files: DataFrame) -> DataFrame:
    """``names(key, base)`` with the first of the markdown paths that ``files(path, content)`` has: path, content, found and error."""
    places = F.array(*[F.struct(F.lit(k).alias("rank"), p.alias("path")) for k, p in enumerate(markdown_paths(F.col("base")))])
    asked = names.select("key", "base", F.explode(places).alias("p")).select("key", "base", "p.rank", "p.path")
    got = asked.join(files.select("path", "content"), "path").groupBy("key").agg(F.min_by(F.struct("path", "content"), "rank").alias("m"))
    out = names.join(got, "key", "left").select("key", "base", "m.path", "m.content", F.col("m").isNotNull().alias("found"))
    return out.withColumn("error", F.when(~F.col("found"), F.concat(F.lit("no markdown under "), "base")))


def fetch_artifacts(runs: DataFrame, files: DataFrame, kinds: tuple[str, ...] = ("prepass", "r1", "compounds", "reactions")) -> DataFrame:
    """``runs(key, base, pipeline)`` -> one row per run and kind: path, content, found and error; of a pre-pass the last file by name."""
    wanted = F.array(*[F.struct(F.lit(k).alias("kind"), artifact_path(F.col("base"), F.col("pipeline"), k).alias("path")) for k in kinds])
    asked = runs.select("key", F.explode(wanted).alias("w")).select("key", "w.kind", F.col("w.path").alias("wanted"))
    stem = F.when(F.regexp_like("path", F.lit("/pre-pass-[^/]*$")), F.regexp_replace("path", "/pre-pass-[^/]*$", "/pre-pass-")).otherwise(F.col("path"))
    latest = files.select(stem.alias("wanted"), "path", "content").groupBy("wanted").agg(F.max("path").alias("path"), F.max_by("content", "path").alias("content"))
    out = asked.join(latest, "wanted", "left").withColumn("found", F.col("path").isNotNull())
    return out.withColumn("error", F.when(~F.col("found"), F.concat(F.lit("not found: "), "wanted"))).drop("wanted")


def fetch(expected: DataFrame, files: DataFrame) -> DataFrame:
    """``expected(key, path)`` with found, content and an error text for what is missing (``files(path, content)``)."""
    out = expected.join(files.select("path", "content"), "path", "left")
    return out.withColumn("found", F.col("content").isNotNull()).withColumn("error", F.when(F.col("content").isNull(), F.concat(F.lit("not found: "), "path")))


def signatures(files: DataFrame, config: str = "") -> DataFrame:
    """Per document a key for what was computed from it: the SHA-256 of its files' names and digests and of the settings.

    ``files(doc_id, name, content)``: the inputs of one comparison; a null name or content counts as empty.
    """
    digest = F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256)
    file = F.struct(F.coalesce("name", F.lit("")).alias("name"), digest.alias("digest"))  # by name first: one name may begin with another
    held = files.select("doc_id", file.alias("file")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list("file")).alias("found"))
    held = held.withColumn("lines", F.transform("found", lambda f: F.concat(f["name"], F.lit("="), f["digest"])))
    return held.select("doc_id", "files", F.sha2(F.concat_ws("\n", "lines", F.lit(config)), 256).alias("signature"))
