"""Token ids in files of compressed bit planes (operator 2).

A shard file holds a run of documents in ascending doc_id order. Its ids are
cut into blocks of a fixed size; each block is transposed into planes (one for
each bit, or each byte, of an id) and every plane is compressed with zstandard.
A chunk index at the end says where each block's planes lie, so a reader can
fetch any block alone.

Layout, little-endian: 8 bytes magic; the planes; then the index, a zstandard
frame of int64: [version, plane bits, id bits, block size, ids, documents,
blocks], doc_ids, whether each doc_id is present, ids of each document, and
for each block its offset and its planes' sizes; at last the index's offset and length (16 bytes).

Documents are dealt to shards by ranges of (doc_id, text hash), so a doc_id
that many rows share is split too. A shard is named only in the manifest row
that the successful attempt of its task returns: what failed attempts leave is
never read. The manifest (one row per shard) is all that reaches the driver.

Defined results: a null text is an empty one and has the end id alone; null
doc_ids come first; equal doc_ids are ordered by text hash and text; repeated rows are
kept; a very long text spans blocks and is read back whole; an empty table gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosswise.llm.arrays import pieces_of, slices_of, texts_of
from crosswise.llm.tokens import encoder
from crosswise.session import scratch, ship, shuffle_partitions

MAGIC = b"XWPLANE1"


def to_planes(ids: np.ndarray, id_bits: int, plane_bits: int) -> list[bytes]:
    """Transpose ids into planes; plane k has bit (or byte) k of every id, the highest first."""
    wide = ids.astype(f">u{id_bits // 8}").view(np.uint8).reshape(len(ids), id_bits // 8)
    if plane_bits == 8:
        return [np.ascontiguousarray(wide[:, k]).tobytes() for k in range(id_bits // 8)]
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(np.unpackbits(wide, axis=1).T), axis=1)]


def from_planes(planes: list[bytes], n: int, id_bits: int, plane_bits: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if plane_bits == 1:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1).T
    return np.ascontiguousarray(rows.T).view(f">u{id_bits // 8}").reshape(-1).astype(np.uint32)


class ShardWriter:
    def __init__(self, out, id_bits: int, plane_bits: int, block: int, level: int):
        import zstandard

        self.out, self.id_bits, self.plane_bits, self.block = out, id_bits, plane_bits, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.wait, self.held, self.at, self.n = [], 0, len(MAGIC), 0
        self.names, self.present, self.lengths, self.index = [], [], [], []
        out.write(MAGIC)

    def add(self, names: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.names.append(names.fill_null(0).to_numpy(zero_copy_only=False))
        self.present.append(names.is_valid().to_numpy(zero_copy_only=False))
        self.lengths.append(lengths)
        self.wait.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.wait)
            whole = len(ids) // self.block * self.block
            for i in range(0, whole, self.block):
                self._flush(ids[i : i + self.block])
            self.wait, self.held = [ids[whole:]], len(ids) - whole

    def _flush(self, ids: np.ndarray) -> None:
        pressed = [self.press.compress(p) for p in to_planes(ids, self.id_bits, self.plane_bits)]
        self.index += [self.at, *map(len, pressed)]
        for p in pressed:
            self.out.write(p)
            self.at += len(p)
        self.n += len(ids)

    def close(self) -> tuple[int, int]:
        if self.held:
            self._flush(np.concatenate(self.wait))
        blocks = len(self.index) // (1 + self.id_bits // self.plane_bits)
        cat = lambda x: np.concatenate(x).astype("<i8") if x else np.zeros(0, "<i8")
        names = cat(self.names)
        head = np.array([1, self.plane_bits, self.id_bits, self.block, self.n, len(names), blocks], "<i8")
        index = self.press.compress(b"".join(x.tobytes() for x in (head, names, cat(self.present), cat(self.lengths), np.array(self.index, "<i8"))))
        self.out.write(index + struct.pack("<qq", self.at, len(index)))
        return len(names), self.n


class ShardReader:
    """Reads the index of a shard; blocks are fetched one at a time."""

    def __init__(self, file):
        import zstandard

        self.file, self.open = file, zstandard.ZstdDecompressor()
        file.seek(file.size() - 16)
        at, size = struct.unpack("<qq", file.read(16))
        file.seek(at)
        index = np.frombuffer(self.open.decompress(file.read(size)), "<i8")
        _, self.plane_bits, self.id_bits, self.block, self.n, docs, blocks = index[:7].tolist()
        self.names, self.present, self.lengths = (index[7 + k * docs : 7 + (k + 1) * docs] for k in range(3))
        self.chunks = index[7 + 3 * docs :].reshape(blocks, -1)

    def read_block(self, k: int) -> np.ndarray:
        at, *sizes = self.chunks[k].tolist()
        self.file.seek(at)
        body = self.file.read(sum(sizes))
        ends = np.cumsum(sizes).tolist()
        planes = [self.open.decompress(body[e - s : e]) for s, e in zip(sizes, ends)]
        return from_planes(planes, min(self.block, self.n - k * self.block), self.id_bits, self.plane_bits)

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, its start in the shard, ids of some whole documents), in order."""
        held, begin, done = 0, 0, 0
        ends = np.cumsum(self.lengths)
        wait = []  # blocks of a document that has not ended yet
        for k in range(len(self.chunks)):
            wait.append(self.read_block(k))
            held += len(wait[-1])
            upto = int(np.searchsorted(ends, begin + held, side="right"))
            if upto > done:
                left, size = np.concatenate(wait), int(ends[upto - 1]) - begin
                yield done, begin, left[:size]
                wait, held, begin, done = [left[size:]], held - size, begin + size, upto


def _open(uri: str, mode: str):
    """Open a file of the shared store, whatever the store is (local, HDFS, object store)."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return store.open_input_file(path)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(path)


def write_shards(docs: DataFrame, vocabulary: str, folder: str, end_id: int = 1, plane_bits: int = 8, id_bits: int = 16, block: int = 65536, level: int = 3, shard_ids: int = 1 << 26) -> list[tuple[str, int, int]]:
    """Encode ``docs`` into shard files under ``folder``; the manifest, in doc_id order: (uri, documents, ids).

    ``id_bits`` is 16 or 32 and must hold every id; an id that does not fit is an error. A task begins
    another file after ``shard_ids`` ids, so a file and its index stay bounded however much a task gets.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        code, part, out, writer, uri, done = encoder(vocabulary), TaskContext.get().partitionId(), None, None, None, []

        def close() -> None:
            n, ids = writer.close()
            out.close()
            done.append((part, len(done), uri, n, ids))

        for batch in batches:
            for piece in pieces_of(batch, most=4 << 20):
                flat, count = code.encode(texts_of(piece), end_id)
                if int(flat.max()) >> id_bits:
                    raise ValueError(f"an id needs more than {id_bits} bits")
                if writer is None:
                    uri = f"{folder}/shard-{part:06d}-{len(done):06d}-{uuid.uuid4().hex[:8]}.planes"
                    out = _open(uri, "w")
                    writer = ShardWriter(out, id_bits, plane_bits, block, level)
                writer.add(piece.column("doc_id").cast(pa.int64()), flat, count)
                if writer.n >= shard_ids:
                    close()
                    writer = None
        if writer is not None:
            close()
        yield pa.record_batch([pa.array(list(x), t) for x, t in zip(list(zip(*done)) or [[]] * 5, [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()])], names=["part", "nth", "uri", "n_docs", "n_ids"])

    spark = docs.sparkSession
    ship(spark)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows = dealt.select("doc_id", "text").mapInArrow(run, "part long, nth long, uri string, n_docs long, n_ids long").collect()
    return [(r.uri, r.n_docs, r.n_ids) for r in sorted(rows, key=lambda r: (r.part, r.nth))]


def read_shards(spark: SparkSession, manifest: list[tuple[str, int, int]]) -> DataFrame:
    """Documents of the shards: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian uint32)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not manifest:
        return spark.createDataFrame([], schema)
    bases = np.concatenate(([0], np.cumsum([m[2] for m in manifest])))[:-1].tolist()
    todo = [(m[0], base) for m, base in zip(manifest, bases)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                uri, base = todo[k]
                with _open(uri, "r") as file:
                    shard = ShardReader(file)
                    ends_of = np.cumsum(shard.lengths)
                    for first, begin, ids in shard.documents():
                        some = slice(first, int(np.searchsorted(ends_of, begin + len(ids), side="right")))
                        n = shard.lengths[some]
                        ends = np.cumsum(n)
                        yield pa.record_batch(
                            [
                                pa.array(shard.names[some], pa.int64(), mask=shard.present[some] == 0),
                                pa.array(base + begin + ends - n, pa.int64()),
                                pa.array(n, pa.int64()),
                                slices_of(ids, n),
                            ],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    ship(spark)
    return spark.range(0, len(todo), 1, len(todo)).mapInArrow(run, schema)


def token_planes(docs: DataFrame, vocabulary: str, **options) -> DataFrame:
    """Write shards into the session's shared folder and read the documents back from them."""
    spark = docs.sparkSession
    return read_shards(spark, write_shards(docs, vocabulary, scratch(spark, "planes"), **options))
