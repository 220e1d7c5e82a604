"""Token-id output in patched frame-of-reference blocks.

A *segment* is one self-contained byte string:

    magic ``PFRB`` | u16 version | u16 block size | u32 documents | u64 ids | u32 blocks
    doc_id   i64 * documents
    is_null  u8  * documents         (1 where doc_id is null)
    n_ids    u32 * documents
    start    u64 * (blocks + 1)      (byte offset of each block in the payload)
    payload

A block holds ``block size`` ids (the last one fewer): its minimum is
subtracted, the differences are packed at the bit width of a percentile of
them, and the differences that do not fit are exceptions:

    u32 minimum | u8 width | u8 0 | u16 exceptions | packed bits |
    u16 position * exceptions | u32 difference * exceptions

Segments are rows of a Parquet table written by Spark, so that the commit
protocol covers lost executors and any store that Spark can write will do.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import full_text, materialize
from .tokens import default_path, encoder

HEAD = struct.Struct("<4sHHIQI")
BLOCK_HEAD = struct.Struct("<IBBH")
BLOCK = 256
PERCENTILE = 0.98
SEGMENT_IDS = 1 << 19
SEGMENT_SCHEMA = "shard int, segment int, shard_start long, n_docs long, n_ids long, data binary"
DOC_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of unsigned values; exact, as doubles hold 32 bits."""
    return np.frexp(values.astype(np.float64))[1].astype(np.int64)


def _pack(rows: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) differences -> (m, BLOCK * width / 8) bytes."""
    m, size = rows.shape
    words = np.zeros((size * width // 64, m), np.uint64)
    columns = np.ascontiguousarray(rows.T).astype(np.uint64)
    for j in range(size):
        q, r = divmod(j * width, 64)
        words[q] |= columns[j] << np.uint64(r)
        if r + width > 64:
            words[q + 1] |= columns[j] >> np.uint64(64 - r)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(m, -1)


def _unpack(packed: np.ndarray, width: int, size: int) -> np.ndarray:
    """The reverse of ``_pack``."""
    m = len(packed)
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view(np.uint64).T)
    out = np.empty((size, m), np.uint32)
    mask = np.uint64((1 << width) - 1)
    for j in range(size):
        q, r = divmod(j * width, 64)
        v = words[q] >> np.uint64(r)
        if r + width > 64:
            v = v | (words[q + 1] << np.uint64(64 - r))
        out[j] = (v & mask).astype(np.uint32)
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray, block: int = BLOCK, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(block starts, payload) of an array of unsigned 32-bit ids."""
    if not len(ids):
        return np.zeros(1, np.uint64), b""
    n = -(-len(ids) // block)
    padded = np.full(n * block, ids[-1], np.uint32)
    padded[: len(ids)] = ids
    rows = padded.reshape(n, block)
    least = rows.min(axis=1)
    rows = rows - least[:, None]
    k = min(block - 1, int(np.ceil(percentile * block)) - 1)
    width = _bits(np.partition(rows, k, axis=1)[:, k])
    outlier = rows >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    at_row, at = np.nonzero(outlier)
    over = rows[at_row, at].astype("<u4")
    count = np.bincount(at_row, minlength=n)
    rows[at_row, at] = 0
    sizes = BLOCK_HEAD.size + width * (block // 8) + count * 6
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    out = np.zeros(int(starts[-1]), np.uint8)
    heads = np.zeros(n, [("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")])
    heads["least"], heads["width"], heads["count"] = least, width, count
    begin = starts[:-1].astype(np.int64)
    out[begin[:, None] + np.arange(BLOCK_HEAD.size)] = heads.view(np.uint8).reshape(n, -1)
    for w in np.unique(width):
        if w:
            those = np.flatnonzero(width == w)
            out[(begin[those] + BLOCK_HEAD.size)[:, None] + np.arange(w * (block // 8))] = _pack(rows[those], int(w))
    first = begin + BLOCK_HEAD.size + width * (block // 8)
    rank = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    out[(first[at_row] + 2 * rank)[:, None] + np.arange(2)] = at.astype("<u2").view(np.uint8).reshape(-1, 2)
    out[(first[at_row] + 2 * count[at_row] + 4 * rank)[:, None] + np.arange(4)] = over.view(np.uint8).reshape(-1, 4)
    return starts, out.tobytes()


def decode_blocks(starts: np.ndarray, payload: bytes, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, found by their indexed starts."""
    if not n_ids:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(payload, np.uint8)
    begin = starts[:-1].astype(np.int64)
    n = len(begin)
    heads = raw[begin[:, None] + np.arange(BLOCK_HEAD.size)].copy().view([("least", "<u4"), ("width", "u1"), ("zero", "u1"), ("count", "<u2")]).reshape(n)
    width, count = heads["width"].astype(np.int64), heads["count"].astype(np.int64)
    rows = np.zeros((n, block), np.uint32)
    for w in np.unique(width):
        if w:
            those = np.flatnonzero(width == w)
            rows[those] = _unpack(raw[(begin[those] + BLOCK_HEAD.size)[:, None] + np.arange(w * (block // 8))], int(w), block)
    first = begin + BLOCK_HEAD.size + width * (block // 8)
    at_row = np.repeat(np.arange(n), count)
    rank = np.arange(len(at_row)) - np.repeat(np.cumsum(count) - count, count)
    at = raw[(first[at_row] + 2 * rank)[:, None] + np.arange(2)].copy().view("<u2").reshape(-1)
    over = raw[(first[at_row] + 2 * count[at_row] + 4 * rank)[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    rows[at_row, at] = over
    return (rows + heads["least"][:, None]).reshape(-1)[:n_ids]


def write_segment(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    """One segment of documents; ``texts_ids`` holds the id bytes of each."""
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    starts, payload = encode_blocks(ids)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    table = np.array([0 if d is None else d for d in doc_ids], "<i8")
    lengths = np.array([len(b) // 4 for b in texts_ids], "<u4")
    head = HEAD.pack(b"PFRB", 1, BLOCK, len(doc_ids), len(ids), len(starts) - 1)
    return b"".join([head, table.tobytes(), nulls.tobytes(), lengths.tobytes(), starts.astype("<u8").tobytes(), payload])


def read_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids of each, all ids in order) of a segment."""
    magic, version, block, n_docs, n_ids, n_blocks = HEAD.unpack_from(data)
    if magic != b"PFRB" or version != 1:
        raise ValueError("not a patched frame-of-reference segment")
    at = HEAD.size
    table = np.frombuffer(data, "<i8", n_docs, at)
    nulls = np.frombuffer(data, np.uint8, n_docs, at + 8 * n_docs)
    lengths = np.frombuffer(data, "<u4", n_docs, at + 9 * n_docs)
    at += 13 * n_docs
    starts = np.frombuffer(data, "<u8", n_blocks + 1, at)
    ids = decode_blocks(starts, data[at + 8 * (n_blocks + 1) :], n_ids, block)
    return [None if z else int(d) for d, z in zip(table, nulls, strict=True)], lengths, ids


def encode_documents(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Segments of the token ids of ``docs`` in ascending doc_id order.

    Columns read: doc_id, text; others are ignored.  A null text is empty and
    holds the end id alone; a null doc_id sorts first and stays null; rows
    with one doc_id are ordered by a hash of their text, equal rows are all
    kept.  An empty table gives no segments.  A text of any length is one
    document of one segment, whose bytes must stay under Arrow's 2 GB: about
    500 million ids.  Shard numbers ascend with
    doc_id, segment numbers with the order within a shard.
    """
    path = tokenizer_path or default_path()
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), full_text().alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        coder, end = encoder(path), int(end_id).to_bytes(4, "little")
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        segment, start, size = 0, 0, 0

        def flush() -> pa.RecordBatch:
            row = [shard, segment, start, len(doc_ids), size, write_segment(doc_ids, held)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["shard", "segment", "shard_start", "n_docs", "n_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode_many(text.as_py() for text in batch.column(1)), strict=True):
                ids += end
                doc_ids.append(doc_id)
                held.append(ids)
                size += len(ids) // 4
                if size >= segment_ids:
                    yield flush()
                    segment, start, size, doc_ids, held = segment + 1, start + size, 0, [], []
        if doc_ids:
            yield flush()
        coder.rest()

    return ordered.mapInArrow(run, SEGMENT_SCHEMA)


def decode_documents(segments: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids before it), n_tokens, ids_crc32.

    Starts need the ids of all lower shards: one sum per shard, as many rows
    as the writer had partitions, so the offsets are joined as a broadcast.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                shard, before, data = (batch.column(c)[i].as_py() for c in ("shard", "shard_start", "data"))
                doc_ids, lengths, ids = read_segment(data)
                ends = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * (e - int(n)) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(doc_ids), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"],
                )

    from pyspark.sql import Window

    sums = segments.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = sums.select("shard", (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before"))
    rows = segments.select("shard", "shard_start", "data").mapInArrow(run, DOC_SCHEMA)
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def store_documents(docs: DataFrame, **options) -> DataFrame:
    """``encode_documents`` written to the shared folder and read back."""
    return materialize(encode_documents(docs, **options), "token-segments", "uncompressed")
