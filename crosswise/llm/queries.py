"""The subpackage's queries for the driver: thin views of its operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswise.llm.bloomlm import bloom_scores
from crosswise.llm.chunks import repeats
from crosswise.llm.fixity import HEAD, audit, files_for, lay_out, warc_record
from crosswise.llm.fuzzy import near_duplicates
from crosswise.llm.interleave import interleave
from crosswise.llm.multiset import as_text, fingerprints
from crosswise.llm.packing import pack_documents
from crosswise.llm.planes import token_planes
from crosswise.llm.suffixes import contamination
from crosswise.llm.toxicity import score, train
from crosswise.session import stage


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit the pages' archive against a replica with known damage: ids 13 mod 97 have another first byte, ids 17 mod 389 are lost."""
    record = warc_record(F.col("url"), F.col("html"))
    damaged = F.when(F.col("page_id") % 97 == 13, F.concat(F.lit("X"), F.substring(record, F.lit(2), F.length(record)))).otherwise(record)
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("length"), F.sha2(damaged, 256).alias("other")
    )
    pages = stage(pages, "pages")  # both replicas are laid out from their own records, apart from each other
    files = files_for(pages)
    archive = lay_out(pages.select("page_id", "digest", "length"), files)
    kept = pages.filter(F.coalesce(F.col("page_id") % 389 != 17, F.lit(True)))
    replica = lay_out(kept.select("page_id", F.col("other").alias("digest"), "length"), files)
    return audit(archive, replica)


OP1_SQL = f"""
WITH r AS (
  SELECT page_id, '{HEAD}' || coalesce(url, '') || E'\\r\\nContent-Length: ' || strlen(coalesce(html, ''))
         || E'\\r\\n\\r\\n' || coalesce(html, '') || E'\\r\\n\\r\\n' AS body FROM pages),
l AS (
  SELECT page_id, sha256(body) AS digest, strlen(body) AS length,
         sha256(CASE WHEN page_id % 97 = 13 THEN 'X' || substr(body, 2) ELSE body END) AS other, count(*) AS copies
  FROM r GROUP BY ALL),
p AS (
  SELECT *, ('0x' || substr(sha256(coalesce(page_id::VARCHAR, digest)), 1, 8))::BIGINT % greatest(1, (SELECT (count(*) + 8191) // 8192 FROM r)) AS file FROM l),
o AS (
  SELECT *, coalesce(sum(length * copies) OVER (PARTITION BY file ORDER BY page_id NULLS FIRST, digest
                                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset",
         row_number() OVER (PARTITION BY page_id ORDER BY digest) AS nth, row_number() OVER (PARTITION BY page_id ORDER BY other) AS mth
  FROM p WHERE true)
SELECT o.page_id, file, "offset", length, copies,
       CASE WHEN o.page_id % 389 = 17 THEN 'missing' ELSE 'corrupt' END AS status, digest AS expected,
       CASE WHEN o.page_id % 389 = 17 THEN NULL ELSE x.other END AS found
FROM o JOIN (SELECT page_id, mth, other FROM o) x ON o.page_id = x.page_id AND o.nth = x.mth
WHERE o.page_id % 389 = 17 OR o.page_id % 97 = 13
""".replace("'" + HEAD + "'", "E'" + HEAD.replace("\r\n", "\\r\\n") + "'")


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_planes(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_best_fit_decreasing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("h")


def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_scores(table(spark, sf_dir, "documents"))


def op6_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("lanes")).alias("fingerprint"),
        as_text(F.col("edited_lanes")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op8_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = interleave(table(spark, sf_dir, "documents"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


QUERIES = {f.__name__: f for f in (op1_merkle_audit, op2_bit_planes, op3_suffix_arrays, op4_gear_chunks, op5_bloom_lm, op6_multiset_hash, op7_best_fit_decreasing, op8_subword_toxicity, op9_golay_simhash, op10_interleave)}
SQL: dict[str, str] = {"op1_merkle_audit": OP1_SQL}
