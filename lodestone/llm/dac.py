"""Token files of directly addressable codes.

An id is split into chunks of 8 bits. Level 0 holds the lowest chunk of every id; a level's continuation bitmap says which
ids go on, and the next level holds their next chunk, densely. A rank directory counts the bits before every 64-bit word,
so the place in the next level is one lookup and one bit count: any token is read by itself, no block is decoded.

``write(df)`` orders documents by doc_id (equal ids by a hash of the text; those without an id come last), encodes whole texts, appends the end id and writes shards as
rows of a Parquet table: the documents' ids and lengths beside the code bytes. Null and empty texts hold the end id alone.
``read(...)`` gives every document's place and checksum from the files. Repeated rows are written each. Extra columns of
df are not stored, so their names cannot clash. An empty table gives no shards and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import shared_dir
from lodestone.llm.units import library_ids

END = 0
#: Tokens after which a shard is closed.
SHARD_TOKENS = 1 << 20
SHARD_SCHEMA = "part int, seq int, start long, n_tokens long, doc_ids binary, no_id int, lengths binary, code binary"


def encode(ids: np.ndarray) -> bytes:
    """uint32 ids to code: the number of levels, then per level its size, chunks, bitmap words and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        n = len(rest)
        bits = np.zeros(-(-n // 64) * 64, bool)
        bits[:n] = more
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(words).astype(np.uint32)
        levels.append(struct.pack("<Q", n) + (rest & 0xFF).astype(np.uint8).tobytes() + words.tobytes() + (np.cumsum(ones, dtype=np.uint32) - ones).tobytes())
        if not more.any():
            return struct.pack("<Q", len(levels)) + b"".join(levels)
        rest = rest[more] >> 8


class Code:
    """Random access to coded ids: code[i], or take() for many places."""

    def __init__(self, data: bytes):
        self.levels, at = [], 8
        for _ in range(struct.unpack_from("<Q", data)[0]):
            n = struct.unpack_from("<Q", data, at)[0]
            w = -(-n // 64)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            words = np.frombuffer(data, np.uint64, w, at + 8 + n)
            self.levels.append((chunks, words, np.frombuffer(data, np.uint32, w, at + 8 + n + 8 * w)))
            at += 8 + n + 12 * w

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        return int(self.take(np.array([i]))[0])

    def take(self, places: np.ndarray) -> np.ndarray:
        out, at, who = np.zeros(len(places), np.uint32), places, None
        for level, (chunks, words, before) in enumerate(self.levels):
            got = chunks[at].astype(np.uint32) << np.uint32(8 * level)
            if who is None:
                out = got
            else:
                out[who] |= got
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            on = (word >> bit) & np.uint64(1) != 0
            if not on.any():
                break
            rank = before[at[on] >> 6] + np.bitwise_count(word[on] & ((np.uint64(1) << bit[on]) - np.uint64(1)))
            at, who = rank.astype(np.int64), np.flatnonzero(on) if who is None else who[on]
        return out


def write(df: DataFrame, path: str, pattern: str, out: str | None = None, shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode doc_id, text with a tokenizers file and write shards in ascending doc_id order; returns the folder.

    The one shuffle deals documents out by ranges of doc_id, so a hot source or long texts do not meet in one task.
    """
    out = out or f"{shared_dir(df.sparkSession)}/lodestone/tokens-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = library_ids(path, pattern), struct.pack("<I", END)
        part, seq, start, docs, held, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def shard() -> pa.RecordBatch:
            lengths = np.array([len(x) // 4 for x in held], np.uint32)
            code = encode(np.frombuffer(b"".join(held), np.uint32))
            row = [[part], [seq], [start], [int(lengths.sum())], [np.array([x or 0 for x in docs], np.int64).tobytes()], [docs.count(None)], [lengths.tobytes()], [code]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=[x.split()[0] for x in SHARD_SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append(doc)
                held.append(b"".join(pieces(text)) + end if text else end)
                size += len(held[-1]) // 4
                if size >= shard_tokens:
                    yield shard()
                    seq, start, docs, held, size = seq + 1, start + size, [], [], 0
        if docs:
            yield shard()

    ordered = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # A hash stands for the text in the ranges' bounds, so that no texts go to the driver.
    digest = F.xxhash64("text")
    by_id = F.col("doc_id").asc_nulls_last()
    ordered = ordered.repartitionByRange(by_id, digest).sortWithinPartitions(by_id, digest, "text").select("doc_id", "text")
    ordered.mapInArrow(run, SHARD_SCHEMA).write.option("compression", "none").parquet(out)
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files alone."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    # One row per writing task, so the running total over parts is small whatever the tables' size.
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, docs, no_id, lengths, code in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                code, docs, lengths = Code(code), np.frombuffer(docs, np.int64), np.frombuffer(lengths, np.uint32).astype(np.int64)
                starts = np.cumsum(lengths) - lengths
                ids = memoryview(code.take(np.arange(len(code))).astype("<u4").tobytes())
                sums = [zlib.crc32(ids[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, mask=np.arange(len(docs)) >= len(docs) - no_id), pa.array(starts + first), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # parts has a dozen bytes for each writing task, so it is small beside any one shard; the shards stay where they are.
    placed = shards.join(F.broadcast(parts), "part").select((F.col("start") + F.col("before")).alias("first"), "doc_ids", "no_id", "lengths", "code")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
