"""Target-distribution importance resampling by hashed n-grams, counted over whole batches at once.

The texts of a batch are joined with a separator byte that stands in no text; one regular expression pass finds all words; the
words' documents come from a binary search of their positions in the documents' offsets, which masks runs of words across
two documents before they are counted. A run's bucket is the CRC-32 of its words joined by one space, modulo the number
of buckets. Checksums of runs are put together from those of their words by carry-less shifts, so no run is spelled out.

The texts are read twice: once for the counts, one array of buckets for each task, once for the weights. Between the two, only
the buckets' gains meet on the driver and go to the tasks; their number is the caller's.

Weight: the sum of gains over a document's runs. Score: weight and a Gumbel variate of the document's id, in thousandths; the
highest scores are a sample without replacement in which a document's chance grows with exp(weight / 1000).

Cases. Null and empty texts: no words. Very long texts: whole, in portions of words. Null id: drawn like the empty one, after
all ids of the same score. Ties: smaller id first. Repeated rows: each on its own, with successive ranks. Empty documents:
empty result; empty target: the gains of no target words. Columns besides those given back are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom.llm import blocks as B
from scoreloom.llm.shared import written
from scoreloom.operators.scan import numbered

#: A byte that UTF-8 never holds.
SEPARATOR = b"\xff"
_WORD = re.compile(rb"[0-9a-z\x80-\xfe]+")
#: Bytes of text joined at once; words taken from the pass at once.
BLOCK, PORTION = 4 << 20, 1 << 18
#: Words in a run at most.
WIDTH = 3
#: Longer words are spelled out.
SHORT = 64


def _shift_tables() -> np.ndarray:
    """tables[n, j, v]: what n further bytes make of the checksum with v as its byte j, and nothing else."""
    tables = np.empty((SHORT + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for n in range(1, SHORT + 1):
        tables[n] = _LOW[tables[n - 1] & 255] ^ (tables[n - 1] >> 8)
    return tables


def _low_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_LOW = _low_table()
_SHIFT = _shift_tables()


def shifted(sums: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Checksums moved by as many bytes: crc(a + b) is shifted(crc(a), len(b)) ^ crc(b)."""
    return _SHIFT[by, 0, sums & 255] ^ _SHIFT[by, 1, (sums >> 8) & 255] ^ _SHIFT[by, 2, (sums >> 16) & 255] ^ _SHIFT[by, 3, sums >> 24]


def _joined(before: np.ndarray, sums: np.ndarray, lengths: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Checksums of `before`, a space, and the word."""
    by = np.minimum(lengths + 1, SHORT)
    out = shifted(before, by) ^ shifted(np.full(len(sums), crc32(b" "), np.uint32), by - 1) ^ sums
    for k in np.flatnonzero(lengths >= SHORT).tolist():
        out[k] = crc32(b" " + words[k], int(before[k]))
    return out


def runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By portions of a batch: documents and checksums of all runs of 1 to WIDTH words, and the documents of the words."""
    joined = SEPARATOR.join(texts).lower()  # of bytes: A-Z only
    offsets = np.append(0, np.cumsum([len(t) + 1 for t in texts])[:-1])
    held: list[bytes] = []
    held_at = np.zeros(0, np.int64)
    found = _WORD.finditer(joined)
    while matches := list(islice(found, PORTION)):
        kept = len(held)
        words = held + list(map(re.Match.group, matches))
        at = np.concatenate([held_at, np.fromiter(map(re.Match.start, matches), np.int64, len(matches))])
        sums = np.fromiter(map(crc32, words), np.uint32, len(words))
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        doc = np.searchsorted(offsets, at, "right") - 1
        docs, made, run = [doc[kept:]], [sums[kept:]], sums
        for width in range(2, WIDTH + 1):
            run = _joined(run[:-1], sums[width - 1 :], lengths[width - 1 :], words[width - 1 :])
            new = np.arange(len(run)) + width - 1 >= kept
            inside = new & (doc[width - 1 :] == doc[: len(run)])
            docs.append(doc[width - 1 :][inside])
            made.append(run[inside])
        yield np.concatenate(docs), np.concatenate(made), doc[kept:]
        held, held_at = words[-(WIDTH - 1) :], at[-(WIDTH - 1) :]


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def counts(df: DataFrame, buckets: int, text: str = "text") -> DataFrame:
    """`bucket` and `runs`, how many runs of all texts fall in it; buckets without any are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for block in B.blocks(batches, "__text", BLOCK):
            for _, made, _ in runs(_texts(block, "__text")):
                held += np.bincount(made % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], ["bucket", "runs"])

    by_task = df.select(df[text].alias("__text")).mapInArrow(run, "bucket long, runs long")
    return by_task.groupBy("bucket").agg(F.sum("runs").alias("runs"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Of each bucket: thousandths of the log ratio of its smoothed shares in the target and in the raw texts."""
    of_raw, of_target = ({r["bucket"]: r["runs"] for r in df.collect()} for df in (raw, target))
    all_raw, all_target = sum(of_raw.values()), sum(of_target.values())
    return [
        math.floor(1000 * math.log((of_target.get(b, 0) + 1) * (all_raw + buckets) / ((of_raw.get(b, 0) + 1) * (all_target + buckets)))) for b in range(buckets)
    ]


def weights(df: DataFrame, gain: list[int], id: str = "doc_id", text: str = "text") -> DataFrame:
    """`id`, `words`, `n_features` and `weight` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))
    names = [id, "words", "n_features", "weight"]
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for block in B.blocks(batches, "__text", BLOCK):
            words, features, total = (np.zeros(block.num_rows, np.int64) for _ in range(3))
            for docs, made, of_word in runs(_texts(block, "__text")):
                words += np.bincount(of_word, minlength=len(words))
                features += np.bincount(docs, minlength=len(words))
                # sums of whole numbers, exact in doubles
                total += np.bincount(docs, gain[made % np.uint32(len(gain))], len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([block.column(id), *map(pa.array, (words, features, total))], names)

    return df.select(df[id], df[text].alias("__text")).mapInArrow(run, f"`{id}` {kind}, words long, n_features long, weight long")


def gumbel(id: str, seed: int) -> Column:
    """Thousandths of a Gumbel variate, rounded down, that depends on the id and the seed alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, buckets: int, percent: int, least_words: int, seed: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's `id`, `n_features`, `weight`, `score` and `rank`: of the rows with enough words, `percent` in a hundred have one."""
    gain = gains(counts(df, buckets, text), counts(target, buckets, text), buckets)
    weighed = weights(df, gain, id, text).withColumn("score", F.col("weight") + gumbel(id, seed))
    weighed = written(weighed.withColumn("__enough", F.col("words") >= least_words), "weights")
    drawn = weighed.where("__enough").count() * percent // 100
    ranked = numbered(weighed, [F.col("__enough").desc(), F.col("score").desc(), F.col(id).asc_nulls_last()], "__place")
    rank = F.when(F.col("__enough") & (F.col("__place") <= drawn), F.col("__place"))
    return ranked.select(id, "n_features", "weight", "score", rank.alias("rank"))
