"""Quality classifier by compression.

One zstandard dictionary is built from texts labelled good, one from texts labelled bad. A text is cut into chunks of
CHUNK bytes, each compressed with either dictionary and without, so that a long text cannot serve as its own dictionary.
The difference of the summed sizes over the size without dictionary, the compression ratio and the length go through
a logistic calibration.

The fit takes a bounded sample: for each label SAMPLE different texts, lowest hash of id and text first, and SAMPLE_BYTES bytes.
Where these texts hold more, the longest give only some of their chunks, evenly spread; none is left out. Half of the texts build the dictionaries, the other half the calibration, weighted to the labels' shares among all labelled rows.
Everything else covers all rows.

Cases. Null and empty texts: the share of good labels, 0.5 without labels. Without two texts of both labels every score
is that share. Null labels and null ids teach nothing; repeated label rows and repeated rows of one id and text count once; a text with both labels counts for
both. Very long texts: all chunks. Repeated rows and ties: equal texts have equal scores. Empty tables: empty result.
The result's columns replace input columns of the same name.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.llm import blocks as B

CHUNK = 4096
SAMPLE, SAMPLE_BYTES = 2000, 8 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


@dataclass
class Model:
    """What a fit gives; small enough to send along with each task."""

    good: bytes
    bad: bytes
    trained: tuple[bool, bool]  # whether the dictionaries have trained tables or are plain content
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    share: float


def _dictionary(chunks: list[bytes]) -> tuple[bytes, bool]:
    """A trained dictionary, or plain content where the trainer finds too little."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes(), True
    except zstandard.ZstdError:
        return b"".join(chunks)[-DICTIONARY_BYTES:], False


class _Sizes:
    """Compressed sizes of a text with the good, the bad and no dictionary."""

    def __init__(self, good: bytes, bad: bytes, trained: tuple[bool, bool]):
        make = functools.partial(zstandard.ZstdCompressor, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.compress = []
        for content, full in zip((good, bad), trained, strict=True):
            kind = zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT
            dictionary = zstandard.ZstdCompressionDict(content, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            self.compress.append(make(dict_data=dictionary).compress)
        self.compress.append(make().compress)

    def of(self, text: bytes) -> list[int]:
        return self.of_chunks([text[k : k + CHUNK] for k in range(0, len(text), CHUNK)])

    def of_chunks(self, chunks: list[bytes]) -> list[int]:
        return [sum([len(compress(c)) for c in chunks]) for compress in self.compress]


def _features(sizes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    good, bad, plain = sizes.reshape(-1, 3).T.astype(float)
    difference = (good - bad) / np.maximum(plain, 1)
    ratio = plain / np.maximum(lengths, 1)
    length = np.log1p(lengths)
    return np.stack([difference, ratio, length, difference**2, ratio**2, length**2, difference * ratio, difference * length, ratio * length], 1)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic regression, the intercept first, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], 1)
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def chunks_each(sizes: list[int]) -> int:
    """The most chunks of a text with which texts of these sizes stay within SAMPLE_BYTES, at least one."""
    chunks = np.sort(-(-np.array(sizes, np.int64) // CHUNK))
    left, budget = len(chunks), SAMPLE_BYTES // CHUNK
    for n in chunks.tolist():
        if n * left > budget:
            return max(1, budget // left)
        budget -= n
        left -= 1
    return int(chunks[-1]) if len(chunks) else 1


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from the labelled texts; pass only the rows that may be learned from."""
    marked = labels.select(F.col(id).alias("__id"), F.col(label).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)").distinct()
    counts = {r["__label"]: r["count"] for r in marked.groupBy("__label").count().collect()}  # two rows
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    sign = F.xxhash64(F.col(id), F.col(text)).alias("__sign")
    sizes = docs.select(F.col(id).alias("__id"), sign, F.octet_length(text).alias("__bytes")).where("__bytes > 0").dropDuplicates(["__id", "__sign"])
    picked = []
    for value in (0, 1):
        found = sizes.join(marked.where(F.col("__label") == value), "__id").orderBy("__sign", "__id").limit(SAMPLE).collect()  # SAMPLE rows
        most = chunks_each([r["__bytes"] for r in found])
        picked += [(r["__id"], r["__sign"], value, most) for r in found]
    kind = docs.schema[id].dataType.simpleString()
    sample = docs.sparkSession.createDataFrame(picked, f"__id {kind}, __sign long, __label int, __most long")
    texts = docs.select(F.col(id).alias("__id"), sign, F.col(text).cast("binary").alias("__text")).join(F.broadcast(sample), ["__id", "__sign"])
    texts = texts.withColumn("__bytes", F.octet_length("__text").cast("long")).withColumn("__all", F.expr(f"(__bytes + {CHUNK - 1}) div {CHUNK}"))
    taken = f"transform(sequence(0L, least(__all, __most) - 1), k -> substring(__text, cast((k * __all) div least(__all, __most) * {CHUNK} + 1 as int), {CHUNK}))"
    texts = texts.select("__id", "__sign", "__label", "__bytes", F.expr(taken).alias("__chunks"))
    texts = texts.groupBy("__id", "__sign", "__label").agg(F.first("__bytes").alias("__bytes"), F.first("__chunks").alias("__chunks"))
    rows = sorted((r["__label"], str(r["__id"]), r["__sign"], r["__bytes"], [bytes(c) for c in r["__chunks"]]) for r in texts.collect())
    by = {value: [(n, chunks) for label, _, _, n, chunks in rows if label == value] for value in (0, 1)}
    none = Model(b"", b"", (False, False), np.zeros(9), np.ones(9), None, share)
    if min(len(by[0]), len(by[1])) < 2:
        return none
    made = [_dictionary([c for _, chunks in by[v][::2] for c in chunks]) for v in (1, 0)]
    measure = _Sizes(made[0][0], made[1][0], (made[0][1], made[1][1]))
    rest = [(v, n, chunks) for v in (0, 1) for n, chunks in by[v][1::2]]
    y = np.array([v for v, _, _ in rest], float)
    lengths = np.array([n for _, n, _ in rest])
    part = lengths / np.array([sum(map(len, chunks)) for _, _, chunks in rest])  # sizes of some chunks stand for the whole text
    x = _features(np.array([measure.of_chunks(chunks) for _, _, chunks in rest]) * part[:, None], lengths)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
    return Model(made[0][0], made[1][0], (made[0][1], made[1][1]), centre, scale, _logistic((x - centre) / scale, y, weight), share)


def score(docs: DataFrame, model: Model, text: str = "text", into: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all) and the score of the whole text. Only the text goes to the workers, and only the score comes back."""
    keep = [c for c in (keep if keep is not None else docs.columns) if c.lower() != into.lower()]
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf(T.DoubleType())
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(**shared.value)
        measure = _Sizes(m.good, m.bad, m.trained) if m.weights is not None else None
        for column in columns:
            scores = np.full(len(column), m.share)
            done = 0
            for block in B.blocks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text"):
                data, offsets = B.strings(block.column("text"))
                lengths = np.diff(offsets)
                some = np.flatnonzero(lengths > 0)
                if measure and len(some):
                    sizes = np.array([measure.of(data[offsets[k] : offsets[k + 1]].tobytes()) for k in some])
                    x = (_features(sizes, lengths[some]) - m.centre) / m.scale
                    scores[done + some] = 1 / (1 + np.exp(-np.clip(m.weights[0] + x @ m.weights[1:], -30, 30)))
                done += block.num_rows
            yield pa.array(scores)

    return docs.select(*[docs[c] for c in keep], scored(docs[text]).alias(into))
