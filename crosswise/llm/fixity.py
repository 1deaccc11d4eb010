"""Merkle fixity audit of WARC records (operator 1).

Every record is hashed; records are laid out in archive files of bounded size, each record in the file that its id
says, so that replicas laid out apart, or read from their own WARC files, compare; each
file is cut into ranges of ``range_bytes`` by offset, a range hashes its records in offset order, and
``fanout`` neighbouring nodes hash into their parent up to one root over all files.
Replicas are compared at the root, and only children of nodes that differ are looked at,
down to the ranges and at last to the records in them. There records are matched by id and
digest, not by offset: a record that is lost moves those behind it in its file, whose ranges are looked at, but they are no findings.

Each level is a grouped aggregate of bounded groups (a range's records, a node's
children), so no group grows with the corpus. Records alike in id and content are one leaf that counts its copies.
Only digests, lengths and offsets are shuffled, never pages.

Defined results: null urls and pages are empty; null page_ids come first in a file and are spread over files by digest; a record that
only the first replica has is ``missing``, one that only the second has ``extra``; a missing and an extra one of the same id, in the
order of their digests, are one ``corrupt`` record; where copies are lost, ``copies`` says how many; very long pages are
records like others, longer than a range if need be; equal replicas and empty tables give
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosswise.session import stage

HEAD = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "


def warc_record(url: Column, body: Column) -> Column:
    """The text of a WARC response record."""
    body = F.coalesce(body, F.lit(""))
    return F.concat(F.lit(HEAD), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def lay_out(records: DataFrame, files: int) -> DataFrame:
    """``records(page_id, digest, length, ...)`` -> one row per distinct record with file, offset and copies.

    ``length`` is that of one copy; copies follow each other. Further columns are grouping columns too.
    """
    leaves = records.groupBy(*records.columns).agg(F.count(F.lit(1)).alias("copies"))
    named = F.sha2(F.coalesce(F.col("page_id").cast("string"), F.col("digest")), 256)
    placed = leaves.withColumn("file", F.pmod(F.conv(F.substring(named, 1, 8), 16, 10).cast("long"), F.lit(files)))
    before = Window.partitionBy("file").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("long"))


def files_for(records: DataFrame, records_a_file: int = 8192) -> int:
    """The number of files that replicas of these records share."""
    return max(1, -(-records.count() // records_a_file))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(uri, file, offset, length, digest) of every record of the WARC files at ``path``, plain or gzipped record by record.

    ``offset`` and ``length`` are those of the record as it is stored; ``digest`` is the SHA-256 of its content, headers included.
    Spark reads the files, a task one at a time. A file that ends within a record gives that record as far as it goes.
    """

    def records(body: bytes) -> Iterator[tuple[int, int, bytes]]:
        at = 0
        while at < len(body):
            if body[at : at + 2] == b"\x1f\x8b":
                member = zlib.decompressobj(31)
                content = member.decompress(body[at:])
                size = len(body) - at - len(member.unused_data)
            else:
                head = body.find(b"\r\n\r\n", at)
                told = re.search(rb"(?im)^content-length:\s*(\d+)", body[at:head]) if head >= 0 else None
                size = head + 4 - at + int(told[1]) + 4 if told else len(body) - at
                content = body[at : at + size]
            yield at, size, content
            at += size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, body in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for at, size, content in records(body):
                    uri = re.search(rb"(?im)^warc-target-uri:[ \t]*([^\r\n]*)", content[: content.find(b"\r\n\r\n") + 2])
                    rows.append((uri[1].decode(errors="replace") if uri else None, file, at, min(size, len(body) - at), hashlib.sha256(content).hexdigest()))
                yield pa.record_batch([pa.array(list(x), t) for x, t in zip(list(zip(*rows)) or [[]] * 5, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()])], names=["uri", "file", "offset", "length", "digest"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "uri string, file string, offset long, length long, digest string")


class MerkleTree:
    """Trees of several replicas, level by level: ``levels[0]`` has the ranges, the last one the root.

    ``records(replica, file, offset, length, copies, digest)``; nodes have (replica, node, hash).
    """

    def __init__(self, records: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16):
        self.fanout, self.range_bytes = fanout, range_bytes
        most = records.agg(F.max("offset").alias("o"), F.max("file").alias("f")).first()
        self.ranges_a_file = 1
        while self.ranges_a_file * range_bytes <= (most.o or 0):
            self.ranges_a_file *= fanout
        leaf = F.struct("offset", "length", "copies", "digest")
        parts = F.array_join(F.transform(F.array_sort(F.collect_list(leaf)), lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["copies"].cast("string"), x["digest"])), "\n")
        level = records.groupBy("replica", self.node_of().alias("node")).agg(F.sha2(parts, 256).alias("hash"))
        self.levels = [stage(level, "merkle")]
        size = ((most.f or 0) + 1) * self.ranges_a_file
        while size > 1:
            size = -(-size // fanout)
            child = F.struct("node", "hash")
            parts = F.array_join(F.transform(F.array_sort(F.collect_list(child)), lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "\n")
            level = self.levels[-1].groupBy("replica", self.parent().alias("node")).agg(F.sha2(parts, 256).alias("hash"))
            self.levels.append(stage(level, "merkle"))

    def node_of(self) -> Column:
        return F.col("file") * self.ranges_a_file + F.floor(F.col("offset") / self.range_bytes)

    def parent(self) -> Column:
        return F.floor(F.col("node") / self.fanout)

    def differing(self, level: DataFrame) -> DataFrame:
        """Nodes of a level whose hashes differ between replicas 0 and 1, or that one of them lacks."""
        sides = [F.max(F.when(F.col("replica") == r, F.col("hash"))).alias(f"h{r}") for r in (0, 1)]
        return level.groupBy("node").agg(*sides).filter(~F.col("h0").eqNullSafe(F.col("h1"))).select("node")

    def bad_ranges(self) -> DataFrame:
        """Descend from the root into nodes that differ."""
        bad = self.differing(self.levels[-1])
        for level in reversed(self.levels[:-1]):
            above = bad.select(F.col("node").alias("above"))
            bad = stage(self.differing(level.join(above, self.parent() == F.col("above"), "left_semi")), "merkle-bad")
        return bad


def audit(first: DataFrame, second: DataFrame, range_bytes: int = 1 << 16, fanout: int = 16) -> DataFrame:
    """Records in which two replicas differ, each of ``(page_id, file, offset, length, copies, digest)``; files are numbered alike, offsets are each one's own.

    page_id, status, copies, expected and found digests, and file, offset and length where the first replica has the record, else the second.
    """
    names = ["page_id", "file", "offset", "length", "copies", "digest"]
    both = first.select(F.lit(0).alias("replica"), *names).unionByName(second.select(F.lit(1).alias("replica"), *names))
    both = stage(both, "replicas")
    tree = MerkleTree(both, range_bytes, fanout)
    near = both.join(tree.bad_ranges().withColumnRenamed("node", "bad"), tree.node_of() == F.col("bad"), "left_semi")
    # What one side has more copies of than the other, matched by order within an id.
    copies = [F.coalesce(F.sum(F.when(F.col("replica") == r, F.col("copies"))), F.lit(0)) for r in (0, 1)]
    place = F.min(F.struct("replica", "offset", "length"))
    leaves = near.groupBy("page_id", "file", "digest").agg((copies[0] - copies[1]).alias("more"), place.alias("place")).filter("more <> 0")
    nth = F.row_number().over(Window.partitionBy("page_id", "file", F.col("more") > 0).orderBy("digest"))
    leaves = leaves.withColumn("nth", nth)
    side = lambda keep, value: F.max(F.when(keep, value))
    lost, got = F.col("more") > 0, F.col("more") < 0
    pairs = leaves.groupBy("page_id", "file", "nth").agg(
        side(lost, F.col("digest")).alias("expected"), side(got, F.col("digest")).alias("found"),
        F.coalesce(side(lost, F.col("more")), side(got, -F.col("more"))).alias("copies"),
        F.coalesce(side(lost, F.col("place")), side(got, F.col("place"))).alias("place"),
    )
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("corrupt")
    return pairs.select("page_id", "file", "place.offset", "place.length", "copies", status.alias("status"), "expected", "found")
