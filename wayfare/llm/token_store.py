"""Token ids as compact files: frequency-ranked ids in byte-aligned variable-length code with separate control bytes.

A store is a folder of Parquet files whose rows are blocks; Spark writes and commits them like any table, so lost executors
and remote stores need no care of ours. Blocks of a shard follow each other in ascending doc_id order, shards likewise. The
payload of a block, all numbers little-endian:

    magic "WFT1"; uint32 documents, uint32 tokens, uint32 distinct ids
    distinct ids by falling frequency (ties: by id), uint32 each; an id's rank is its place here
    tokens of each document, uint32 each
    control bytes, four tokens each: two bits for a token (the lowest bits first) are the bytes of its rank, less one
    the bytes of the ranks

Decoding looks each control byte up in a table of lengths, sums these to offsets and gathers whole arrays.

Defined cases: a null text is an empty one and stores its end id only; null doc_ids come first; rows of one doc_id are ordered
by text; an empty table gives an empty store. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settings, shared_dir, sliced, text_of, wide_partitions
from .tokens import default_vocabulary, encoder

MAGIC = b"WFT1"
BLOCK_TOKENS = 1 << 20
BLOCK = "shard int, block int, first_token long, n_documents int, n_tokens long, doc_ids array<long>, payload binary"
#: Lengths of the four tokens of each control byte.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


def pack_block(ids: np.ndarray, counts: np.ndarray) -> bytes:
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(seen)
    table = used[np.lexsort((used, -seen[used]))]
    rank_of = np.zeros(len(seen), np.uint32)
    rank_of[table] = np.arange(len(table))
    rank = rank_of[ids]
    size = 1 + (rank >= 1 << 8).astype(np.uint8) + (rank >= 1 << 16) + (rank >= 1 << 24)
    code = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    code[: len(ids)] = size - 1
    quad = code.reshape(-1, 4)
    control = quad[:, 0] | quad[:, 1] << 2 | quad[:, 2] << 4 | quad[:, 3] << 6
    raw = rank.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    head = MAGIC + struct.pack("<III", len(counts), len(ids), len(table))
    return head + table.astype("<u4").tobytes() + counts.astype("<u4").tobytes() + control.tobytes() + data.tobytes()


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids, and how many each document has."""
    if payload[:4] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n, distinct = struct.unpack_from("<III", payload, 4)
    table = np.frombuffer(payload, "<u4", distinct, 16)
    counts = np.frombuffer(payload, "<u4", n_docs, 16 + 4 * distinct)
    at = 16 + 4 * (distinct + n_docs)
    control = np.frombuffer(payload, np.uint8, -(-n // 4), at)
    data = np.frombuffer(payload, np.uint8, -1, at + len(control))
    size = LENGTHS[control].reshape(-1)[:n]
    begin = np.cumsum(size, dtype=np.int64) - size
    rank = data[begin].astype(np.uint32) if n else np.zeros(0, np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        rank[longer] |= data[begin[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return table[rank], counts


def write_store(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, block_tokens: int = BLOCK_TOKENS) -> None:
    vocabulary = vocabulary or default_vocabulary()

    def run(batches):
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        rows = 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_token", pa.int64()), ("n_documents", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("payload", pa.binary())])

        def flush():
            ids, counts = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            doc_ids = [d for h in held for d in h[2]]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, block, first, len(doc_ids), len(ids), doc_ids, pack_block(ids, counts)), schema.types, strict=True)], schema=schema)

        for batch in sliced(batches, 1000, 4):
            ids, counts = encoder(vocabulary).encode(batch.column("text").to_pylist())
            ends = np.cumsum(counts)
            held.append((np.insert(ids, ends, end_id), counts + 1, batch.column("doc_id").to_pylist()))
            rows += len(held[-1][0])
            if rows >= block_tokens:
                yield flush()
                first, block, held, rows = first + rows, block + 1, [], 0
        if held:
            yield flush()

    spark = docs.sparkSession
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange(wide_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20), "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    with settings(spark, bounds):
        ordered.mapInArrow(run, BLOCK).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids before it in the store), n_tokens, ids (binary, uint32 little-endian)."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    # one row for each shard, that is for each partition that was written
    before = shards.select(F.col("shard").alias("of"), (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))

    def run(batches):
        for batch in sliced(batches, 16, 8):
            for start, first, doc_ids, payload in zip(*(batch.column(c).to_pylist() for c in ("shard_start", "first_token", "doc_ids", "payload")), strict=True):
                ids, counts = unpack_block(payload)
                ends = np.cumsum(counts, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                data = [raw[4 * (e - c) : 4 * e] for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + first + ends - counts), pa.array(counts.astype(np.int64)), pa.array(data, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )
                for k in range(0, whole.num_rows, 512):
                    yield whole.slice(k, 512)

    placed = blocks.join(F.broadcast(before), blocks["shard"] == before["of"])
    return placed.select("shard_start", "first_token", "doc_ids", "payload").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
