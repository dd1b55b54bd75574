"""Token sequences in training order, as binary shards.

Texts become ids of one byte each: their UTF-8 bytes, then END; neither END nor PAD occurs in UTF-8. The ids of a text are cut into
sequences of `length`, the last one padded. Sequences are numbered 0 .. n - 1 in the order of the stored table: a first
pass counts those of each partition, a second one numbers them from there, so the texts are not shuffled for it. A keyed
Feistel permutation of the least even number of bits that holds n, walked along its cycle until the value is below n,
gives every sequence its slot in the training order. Nothing is sorted but each shard: a sequence finds its slot by itself.
What a task has for a shard travels in compressed pieces to the partition of that shard's number, without a sampling of ranges.

The input has to be a stored table, whose partitions are the same whenever they are read, also after an executor is lost. A
task whose partition has another number of sequences than it was counted with fails rather than reuse slots.

Shard s holds the slots s * `per_shard` and on, in order, in a folder shard=s with one file. A record is the `length` ids and a line
feed, so slot t lies at byte (t % per_shard) * (length + 1) of its shard whatever the ids are: a reader continues at any
slot with one seek. Files come from Spark's own writer, so a lost executor's shard is written again and half a file is never seen.

Cases. Null and empty texts: one sequence, END alone. Rows with a null id: like the others. Repeated rows: each its own
sequences. Very long texts: all their sequences. Empty tables: no shard, empty result.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloom.llm import blocks as B
from scoreloom.llm.shared import fresh

PAD, END = 0xFE, 0xFF
#: Bytes of text cut at once.
BLOCK = 8 << 20
ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permute(numbers: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot of each number below n; a bijection of 0 .. n - 1 for every key."""
    half = B.U(_half_bits(n))
    mask = (B.U(1) << half) - B.U(1)
    keys = B.mix(np.arange(1, ROUNDS + 1, dtype=B.U) * B._BASE + B.U(key % (1 << 64)))
    out = numbers.astype(B.U)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> half, out[walking] & mask
        for k in keys:
            left, right = right, left ^ (B.mix(right + k) & mask)
        out[walking] = left << half | right
        walking = walking[out[walking] >= n]
    return out.astype(np.int64)


def _many(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """Sequences of each text."""
    size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    return -(-size // length)


def starts(rows: DataFrame, length: int) -> tuple[dict[int, tuple[int, int]], int]:
    """For each partition of the rows with sequences the number of the first and of the one after the last; their sum."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(int(_many(batch, length).sum()) for batch in batches)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total], pa.int64())], ["partition", "many"])

    found, first = {}, 0
    for row in sorted(rows.mapInArrow(count, "partition int, many long").collect()):  # a row for each partition
        found[row["partition"]] = first, first + row["many"]
        first += row["many"]
    return found, first


def materialise(docs: DataFrame, path: str, length: int, per_shard: int, key: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards below `path`; returns (id, part, slot, shard, offset, ids, digest) for every sequence.

    `part` counts the sequences of a text, `ids` those before the padding; `digest` is the crc32 of the record.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    places, n = starts(rows, length)
    kind = docs.schema[id].dataType.simpleString()

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By blocks of texts: the block, and of every sequence its text, part, slot, ids before the padding, and record."""
        number, after = places.get(TaskContext.get().partitionId(), (0, 0))
        for batch in B.blocks(batches, "text", BLOCK):
            data, offsets = B.strings(batch.column("text"))
            many = _many(batch, length)
            size = np.diff(offsets) + 1
            record = np.full((int(many.sum()), length), PAD, np.uint8)
            begin = (np.cumsum(many) - many) * length
            flat = record.ravel()
            flat[np.repeat(begin - offsets[:-1], size - 1) + np.arange(len(data))] = data
            flat[begin + size - 1] = END
            part = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
            slot = permute(number + np.arange(len(record)), n, key)
            number += len(record)
            yield batch, np.repeat(np.arange(batch.num_rows), many), part, slot, np.minimum(np.repeat(size, many) - part * length, length), record
        if number != after:
            raise ValueError("the partitions of the input changed between two reads; store the table first")

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, at, part, slot, used, record in sequences(batches):
            digest = np.fromiter((crc32(r) for r in record), np.int64, len(record))
            columns = [batch.column("id").take(pa.array(at)), *map(pa.array, (part, slot, used, digest))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "part", "slot", "ids", "digest"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a block has for a shard, in one piece: the slots' places in the shard, then the records."""
        compress = zstandard.ZstdCompressor(level=3).compress
        for _, _, _, slot, _, record in sequences(batches):
            order = np.argsort(slot, kind="stable")
            shard, inside = slot[order] // per_shard, (slot[order] % per_shard).astype("<i4")
            cuts = np.append(np.flatnonzero(np.diff(shard, prepend=-1)), len(shard))
            pieces = [compress(inside[a:b].tobytes() + record[order[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = [pa.array(shard[cuts[:-1]].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "many", "piece"])

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for shard, many, piece in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                raw = decompress(piece)
                slot = shard * per_shard + np.frombuffer(raw, "<i4", many).astype(np.int64)
                ends = 4 * many + np.arange(many + 1, dtype=np.int32) * length
                records = pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(ends), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(many, shard, np.int64)), pa.array(slot), records], ["shard", "slot", "record"])

    shards = max(1, -(-n // per_shard))
    if n:
        # a shard is a partition, in order, and so one file
        pieces = rows.mapInArrow(packed, "shard int, many int, piece binary").repartitionById(shards, "shard")
        ordered = pieces.mapInArrow(unpacked, "shard long, slot long, record binary").sortWithinPartitions("shard", "slot")
        ordered.select("shard", F.col("record").cast("string").alias("value")).write.partitionBy("shard").option("lineSep", "\n").text(path)
    index = rows.mapInArrow(listed, f"id {kind}, part long, slot long, ids long, digest long")
    index = index.withColumn("shard", F.floor(F.col("slot") / per_shard).cast("long"))
    return index.select("id", "part", "slot", "shard", "ids", "digest", (F.col("slot") % per_shard * (length + 1)).alias("offset"))


def read(spark: SparkSession, path: str, length: int, per_shard: int, start: int = 0, end: int | None = None) -> DataFrame:
    """(slot, record) for the slots from `start` to `end`, from the shards that hold them."""
    files = spark.read.format("binaryFile").load(path).select("content", F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"))
    files = files.where(F.col("shard") >= start // per_shard)
    if end is not None:
        files = files.where(F.col("shard") <= (end - 1) // per_shard)
    stride = length + 1
    slots = files.select("shard", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.length("content") / stride).cast("long") - 1)).alias("at"))
    slots = slots.select((F.col("shard") * per_shard + F.col("at")).alias("slot"), F.expr(f"substring(content, cast(at * {stride} + 1 as int), {length})").alias("record"))
    return slots.where(F.col("slot") >= start) if end is None else slots.where((F.col("slot") >= start) & (F.col("slot") < end))


def in_order(docs: DataFrame, length: int, per_shard: int, key: int) -> DataFrame:
    """The index of shards written to a fresh folder that all executors share."""
    return materialise(docs, fresh(docs.sparkSession, "shards"), length, per_shard, key)
