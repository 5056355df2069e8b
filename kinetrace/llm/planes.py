"""Token-id files with bit-plane shuffling.

A file holds the ids of whole documents as unsigned 32-bit integers, in blocks of BLOCK ids (the last one
shorter). Each block is transposed into bit or byte planes, and each plane that is not all zero is compressed
with zstandard. Layout, little-endian:

    b"BPS1" | planes of block 0 | planes of block 1 | ... | footer | footer length u64 | b"BPS1"
    footer (zstandard): u8 planes per block, u32 block size, u64 ids, u32 blocks,
                        per block: u64 offset, per plane u32 length (0: a plane of zeros)
                        u32 documents, per document: i64 doc_id, u8 null, u64 ids

The footer is the chunk index: `read_block` decodes one block without the others. A dataset is a Parquet
table of such files (shard, file_no, n_ids, first and last doc_id, content), written through Spark, so that
Spark's commit protocol covers lost executors and any store that Spark can write to holds it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetrace.llm.tokens import encoder
from kinetrace.session import cut, prepare, ranges

MAGIC = b"BPS1"
BLOCK = 65_536
FILE_IDS = 1 << 20
MOST_FILES = 1_000_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 32 bit planes or 4 byte planes of a block of ids, lowest first."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]


def from_planes(planes: list[bytes | None], n: int) -> np.ndarray:
    """The block of n ids; None is a plane of zeros."""
    if len(planes) == 32:
        bits = np.zeros((32, n), np.uint8)
        for k, p in enumerate(planes):
            if p:
                bits[k] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
        return np.packbits(bits.T, axis=1, bitorder="little").reshape(-1).view("<u4")
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if p:
            raw[:, k] = np.frombuffer(p, np.uint8)
    return raw.reshape(-1).view("<u4")


def write_file(docs: list[tuple[int | None, np.ndarray]], bits: bool = False, level: int = 3, block: int = BLOCK) -> bytes:
    """The bytes of a file with these documents' ids, in order."""
    ids = np.concatenate([x for _, x in docs]).astype("<u4") if docs else np.zeros(0, "<u4")
    squeeze = zstandard.ZstdCompressor(level=level)
    count = 32 if bits else 4
    out, at, index = [MAGIC], len(MAGIC), []
    for lo in range(0, len(ids), block):
        planes = [squeeze.compress(p) if any(p) else b"" for p in to_planes(ids[lo : lo + block], bits)]
        index.append(struct.pack(f"<Q{count}I", at, *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    footer = struct.pack("<BIQI", count, block, len(ids), len(index)) + b"".join(index) + struct.pack("<I", len(docs))
    footer += b"".join(struct.pack("<qBQ", d or 0, d is None, len(x)) for d, x in docs)
    footer = squeeze.compress(footer)
    return b"".join([*out, footer, struct.pack("<Q", len(footer)), MAGIC])


class PlaneFile:
    """Random access to a file's blocks and documents."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC or data[-4:] != MAGIC:
            raise ValueError("not a bit-plane file")
        (size,) = struct.unpack("<Q", data[-12:-4])
        foot = zstandard.ZstdDecompressor().decompress(data[-12 - size : -12])
        self.data = data
        self.count, self.block, self.n_ids, n_blocks = struct.unpack_from("<BIQI", foot)
        at, step = struct.calcsize("<BIQI"), struct.calcsize(f"<Q{self.count}I")
        self.index = [struct.unpack_from(f"<Q{self.count}I", foot, at + k * step) for k in range(n_blocks)]
        at += n_blocks * step
        (n_docs,) = struct.unpack_from("<I", foot, at)
        rows = [struct.unpack_from("<qBQ", foot, at + 4 + k * 17) for k in range(n_docs)]
        self.docs = [(None if null else d, n) for d, null, n in rows]

    def read_block(self, k: int) -> np.ndarray:
        at, *sizes = self.index[k]
        planes: list[bytes | None] = []
        expand = zstandard.ZstdDecompressor()
        for n in sizes:
            planes.append(expand.decompress(self.data[at : at + n]) if n else None)
            at += n
        return from_planes(planes, min(self.block, self.n_ids - k * self.block))

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids), decoding one block at a time."""
        held, k = np.zeros(0, "<u4"), 0
        for doc, n in self.docs:
            parts, size = [held], len(held)
            while size < n:
                parts.append(self.read_block(k))
                size += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc, held[:n]
            held = held[n:]


def _writer(path: str, kind: str, end_id: int, bits: bool, file_ids: int):
    names = ["shard", "file_no", "n_ids", "first_doc", "last_doc", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard = encoder(path, kind).encode, TaskContext.get().partitionId()
        docs, size, no = [], 0, 0

        def flush():
            row = [[shard], [no], [size], [docs[0][0]], [docs[-1][0]], [write_file(docs, bits)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                docs.append((doc.as_py(), np.append(encode(text.as_py()), np.uint32(end_id))))
                size += len(docs[-1][1])
                if size >= file_ids:
                    yield flush()
                    docs, size, no = [], 0, no + 1
        if docs:
            yield flush()

    return run


def write_dataset(docs: DataFrame, to: str, tokenizer: str, kind: str = "byte", end_id: int = 0, bits: bool = False, file_ids: int = FILE_IDS) -> None:
    """Encode all texts and write them as bit-plane files in ascending order of doc_id.

    Null texts count as empty (the end id alone); null doc_ids come first; rows with one doc_id follow the
    order of a hash of their texts, then of the texts. Shards are ranges of doc_id and that hash, about 32 MB of input
    each, so that a doc_id with many rows is no one task; a document is never cut between files, however long. An empty
    table gives a dataset without files; further columns are ignored, whatever their names.
    """
    prepare(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = texts.repartitionByRange(ranges(texts), *order).sortWithinPartitions(*order, "text")
    schema = "shard int, file_no int, n_ids long, first_doc long, last_doc long, content binary"
    ranged.mapInArrow(_writer(tokenizer, kind, end_id, bits, file_ids), schema).write.parquet(to, compression="none")


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "shard", "file_no"]
    for batch in batches:
        for shard, no, base, content in zip(*(batch.column(c).to_pylist() for c in ("shard", "file_no", "base", "content")), strict=True):
            rows, at = [], base
            for doc, ids in PlaneFile(content).documents():
                rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), shard, no))
                at += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """The files of a dataset with `base`, the number of ids in all files before each.

    Only the index columns are summed for that: per shard first, so that one row a shard is ordered.
    """
    files = spark.read.parquet(path)
    before = "coalesce(sum(n) over (order by shard rows between unbounded preceding and 1 preceding), 0)"
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.expr(before).alias("shard_base"))
    inner = "coalesce(sum(n_ids) over (partition by shard order by file_no rows between unbounded preceding and 1 preceding), 0)"
    bases = files.select("shard", "file_no", F.expr(inner).alias("file_base")).join(shards, "shard")
    bases = cut(bases.select("shard", "file_no", (F.col("shard_base") + F.col("file_base")).alias("base")))
    # One row of 16 bytes a file goes to all workers, so that the contents stay where they are; beyond MOST_FILES they are dealt.
    return files.join(F.broadcast(bases) if bases.count() <= MOST_FILES else bases, ["shard", "file_no"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and shard, file_no) of every document, decoded from the files."""
    rows = read_dataset(spark, path).select("shard", "file_no", "base", "content")
    return rows.mapInArrow(_summaries, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long, file_no long")
