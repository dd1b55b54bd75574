"""Cross-tokenizer alignment by the byte ranges of tokens.

Each text is encoded by two tokenizers: A, a byte-level BPE, and B, a piece model that puts a space before the text. Both give the
same bytes, so each token has a byte range. An as-of merge per batch, keyed by document, finds for the start of each token the
token of the other side that covers it; the union of both directions is the set of overlaps, since the later start of
two overlapping tokens lies inside the other one. Where tokens of both sides end at the same byte, a group ends.

How often an id pair is linked in all texts is counted in Spark. Texts are gathered in blocks of bounded bytes; a block lists its
distinct pairs once, only these lists are exchanged, and the counts come back to the block, never a row for each link.

Cases. Null and empty texts, and texts whose bytes one side does not give back (such as those with characters that the piece model
replaces): no tokens, no groups, no links, empty rendering. Strings of special tokens in a text: plain text. Very long texts:
whole; they are encoded in parts cut where no token can cross. Repeated rows: each on its own, each counts. Null
ids: kept. Empty table: empty result. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from scoreloom.llm import blocks as B
from scoreloom.llm.shared import written

#: Bytes of text that one merge works on, and that share a list of pairs.
BATCH, BLOCK = 1 << 20, 8 << 20
#: Characters of a text that are encoded at once, about.
PART = 1 << 18
#: A place no token of either side crosses: before a space between two letters or digits.
_CUT = re.compile(r"(?<=[0-9A-Za-z])(?= [0-9A-Za-z])")
#: Texts of characters below this code point, without long runs, have the same ids in both libraries that read A.
_PLAIN_BELOW, _LONG = 0x370, 512
_BEYOND = re.compile(f"[^\\x00-{chr(_PLAIN_BELOW - 1)}]")
_LONG_SPACE = re.compile(rf"\s{{{_LONG}}}")
#: The pieces into which byte-level BPE files of this kind split a text first (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

MEASURES = ("n_a", "n_b", "n_groups", "n_links")
COUNTED = ("n_best", "count_sum")


@dataclass(frozen=True)
class Files:
    """Content of the tokenizer file of A and of the model file of B."""

    a: str
    b: bytes


class Side:
    """Bytes of all tokens of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return B.ragged(self.data, self.starts[ids], self.lengths[ids])


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def _plain(text: str) -> bool:
    """Whether the quick library may read a text: no character beyond the agreed ones, no long run."""
    if not text.isascii() and _BEYOND.search(text):
        return False
    words = list(map(len, text.split()))
    return max(words, default=0) < _LONG and (len(text) - sum(words) < len(words) + _LONG - 2 or not _LONG_SPACE.search(text))


class Coder:
    """Both tokenizers, made once for a worker."""

    def __init__(self, files: Files):
        file = json.loads(files.a)
        self.whole = Tokenizer.from_str(files.a)
        self.whole.encode_special_tokens = True
        letters = _letters()
        special = {t["id"]: t["content"] for t in file["added_tokens"]}
        tokens = {i: bytes(letters[c] for c in t) for t, i in file["model"]["vocab"].items() if i not in special}
        # the quick library merges by token id, so it serves only files whose ids follow the order of merges
        merges = [m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"]]
        ranked = all(file["model"]["vocab"][a + b] == 256 + k for k, (a, b) in enumerate(merges))
        self.quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={t: i for i, t in tokens.items()}, special_tokens={}) if ranked else None
        self.a = Side([tokens.get(i) or special.get(i, "").encode() for i in range(max([*tokens, *special]) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.b)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        # ids 3 to 258 or so are single bytes, written <0xHH>
        self.b = Side([bytes([int(n[3:5], 16)]) if self.pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.numbers = Side([str(i).encode() + end for i in range(max(len(self.a.lengths), len(self.b.lengths))) for end in (b",", b"|", b";")])

    def parts(self, whole: str) -> Iterator[str]:
        """The text in order, in parts that begin with a space."""
        start = 0
        while self.cuts and len(whole) - start > PART and (cut := _CUT.search(whole, start + PART)):
            yield whole[start : cut.start()]
            start = cut.start()
        yield whole[start:]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B for a text, which gets a space in front."""
        a, b = [], []
        for part in self.parts(" " + text):
            plain = self.quick and _plain(part)
            a.append(np.array(self.quick.encode_ordinary(part) if plain else self.whole.encode(part, add_special_tokens=False).ids, np.int32))
            b.append(np.array(self.pieces.encode(part[1:]), np.int32))
        return np.concatenate(a), np.concatenate(b)


@functools.lru_cache(1)
def _coder(files: Files) -> Coder:
    return Coder(files)


@dataclass
class Aligned:
    """One batch: figures and renderings by text, and the pair and text of every link."""

    measures: dict[str, np.ndarray]
    rendered: pa.Array
    pairs: np.ndarray
    text: np.ndarray


def _spread(values: np.ndarray, which: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    out[which] = values
    return out


def align(coder: Coder, texts: list[str]) -> Aligned:
    """Groups and links of the texts' tokens."""
    n = len(texts)
    coded = [(k, " " + t, *coder.encode(t)) for k, t in enumerate(texts) if t]
    sized = [(k, w.encode(), a, b) for k, w, a, b in coded]
    sized = [c for c in sized if coder.a.lengths[c[2]].sum() == len(c[1]) == coder.b.lengths[c[3]].sum()]
    same = [c for c in sized if coder.a.joined(c[2]).tobytes() == c[1] == coder.b.joined(c[3]).tobytes()]
    empty = pa.array([""] * n)
    if not same:
        return Aligned({m: np.zeros(n, np.int64) for m in MEASURES}, empty, np.zeros(0, np.int64), np.zeros(0, np.int64))
    which = np.array([c[0] for c in same])
    count = [np.array([len(c[side]) for c in same]) for side in (2, 3)]
    ids = [np.concatenate([c[side] for c in same]) for side in (2, 3)]
    doc = [np.repeat(np.arange(len(same)), c) for c in count]
    end = [np.cumsum(s.lengths[i]) for s, i in zip((coder.a, coder.b), ids, strict=True)]
    start = [e - s.lengths[i] for e, s, i in zip(end, (coder.a, coder.b), ids, strict=True)]

    sides = [pd.DataFrame({"at": start[s], "doc": doc[s], name: np.arange(len(ids[s]))}) for s, name in enumerate("ab")]
    over_a = pd.merge_asof(sides[0], sides[1], on="at", by="doc")
    over_b = pd.merge_asof(sides[1], sides[0], on="at", by="doc")
    over_b = over_b[start[0][over_b["a"].to_numpy()] < start[1]]  # equal starts are in the other direction already
    at = [np.concatenate([over_a[x].to_numpy(), over_b[x].to_numpy()]) for x in "ab"]
    pairs = ids[0][at[0]].astype(np.int64) * len(coder.b.lengths) + ids[1][at[1]]
    of_link = doc[0][at[0]]

    closes = np.intersect1d(end[0], end[1], assume_unique=True)
    group = [np.searchsorted(closes, e) for e in end]
    size = [np.bincount(g, minlength=len(closes)) for g in group]
    first = np.cumsum(size[0] + size[1]) - size[0] - size[1]
    items = np.empty(len(ids[0]) + len(ids[1]), np.int64)
    for s in (0, 1):
        inner = np.arange(len(ids[s])) - (np.cumsum(size[s]) - size[s])[group[s]]
        last = inner == size[s][group[s]] - 1
        place = first[group[s]] + inner + (size[0][group[s]] if s else 0)
        items[place] = ids[s].astype(np.int64) * 3 + np.where(last, 1 + s, 0)
    rendered = coder.numbers.joined(items)
    item_ends = np.cumsum(coder.numbers.lengths[items])[np.cumsum(count[0] + count[1]) - 1]
    kept = np.ones(len(rendered), bool)
    kept[item_ends - 1] = False  # no semicolon after the last group
    lengths = _spread(np.diff(item_ends, prepend=0) - 1, which, n)
    buffers = [pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(rendered[kept].tobytes())]
    groups = np.diff(np.searchsorted(closes, end[0][np.cumsum(count[0]) - 1], "right"), prepend=0)
    links = np.bincount(of_link, minlength=len(same))
    measures = dict(zip(MEASURES, (_spread(v, which, n) for v in (*count, groups, links)), strict=True))
    return Aligned(measures, pa.LargeStringArray.from_buffers(n, *buffers).cast(pa.string()), pairs, which[of_link])


@dataclass
class _Block:
    """Aligned batches that share one list of pairs."""

    batches: list[pa.RecordBatch] = field(default_factory=list)
    made: list[Aligned] = field(default_factory=list)

    def rows(self, number: int, names: list[str]) -> Iterator[pa.RecordBatch]:
        pairs, at, total = np.unique(np.concatenate([m.pairs for m in self.made]), return_inverse=True, return_counts=True)
        first = np.cumsum([0, *(b.num_rows for b in self.batches)])
        text = np.concatenate([m.text + f for m, f in zip(self.made, first, strict=False)])
        key, times = np.unique(text * max(len(pairs), 1) + at, return_counts=True)
        offsets = np.searchsorted(key, np.arange(first[-1] + 1) * max(len(pairs), 1)) if len(key) else np.zeros(first[-1] + 1, np.int64)
        at = (key % max(len(pairs), 1)).astype(np.int32)
        for k, (batch, made) in enumerate(zip(self.batches, self.made, strict=True)):
            n, (low, high) = batch.num_rows, offsets[[first[k], first[k + 1]]]
            cut = pa.array((offsets[first[k] : first[k + 1] + 1] - low).astype(np.int32))
            own = [None] * (n - 1)  # the first row of a block has the block's list
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    *(pa.array(made.measures[m]) for m in MEASURES),
                    made.rendered,
                    pa.array(np.full(n, number)),
                    pa.ListArray.from_arrays(cut, pa.array(at[low:high])),
                    pa.ListArray.from_arrays(cut, pa.array(times[low:high].astype(np.int32))),
                    pa.array([pairs if k == 0 else None, *own], pa.list_(pa.int64())),
                    pa.array([total if k == 0 else None, *own], pa.list_(pa.int64())),
                ],
                names,
            )


def aligned(df: DataFrame, files: Files, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` (default: all but the text) with n_a, n_b, n_groups, n_links and `groups`: the ids of both sides by group, as
    `a1,a2|b1;a3|b2,b3`. The columns that follow are for `with_counts`; write the result before, as it is read more than once."""
    added = {*MEASURES, "groups", "block", "pair_at", "pair_times", "block_pairs", "block_totals", *COUNTED}
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c.lower() not in added]
    long = T.LongType()
    kinds = {**dict.fromkeys(MEASURES, long), "groups": T.StringType(), "block": long, "pair_at": T.ArrayType(T.IntegerType()), "pair_times": T.ArrayType(T.IntegerType())}
    kinds |= {"block_pairs": T.ArrayType(long), "block_totals": T.ArrayType(long)}
    schema = T.StructType([*[df.schema[c] for c in keep], *[T.StructField(c, k) for c, k in kinds.items()]])
    shared = df.sparkSession.sparkContext.broadcast(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number, held, size = _coder(shared.value), TaskContext.get().partitionId() << 32, _Block(), 0
        for batch in B.blocks(batches, "__text", BATCH):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            held.batches.append(batch.drop_columns(["__text"]))
            held.made.append(align(coder, texts))
            size += sum(map(len, texts))
            if size >= BLOCK:
                yield from held.rows(number, schema.names)
                number, held, size = number + 1, _Block(), 0
        if held.batches:
            yield from held.rows(number, schema.names)

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)


def b_ids(files: Files) -> int:
    return sentencepiece.SentencePieceProcessor(model_proto=files.b).get_piece_size()


def pair_counts(stored: DataFrame, b_ids: int) -> DataFrame:
    """Of each linked id pair: `pair` (id of A times `b_ids`, and id of B), `count`, and whether no other A is linked more with that B."""
    listed = stored.where("block_pairs is not null").select(F.inline(F.arrays_zip("block_pairs", "block_totals")))
    counts = listed.groupBy(F.col("block_pairs").alias("pair")).agg(F.sum("block_totals").alias("count"))
    counts = written(counts, "pair-counts")
    most = counts.groupBy((F.col("pair") % b_ids).alias("__b")).agg(F.max("count").alias("__most"))  # a row an id of B, no more than `b_ids`
    joined = counts.withColumn("__b", F.col("pair") % b_ids).join(F.broadcast(most), "__b")
    return joined.select("pair", "count", (F.col("count") == F.col("__most")).alias("best"))


def with_counts(stored: DataFrame, b_ids: int, keep: list[str]) -> DataFrame:
    """Adds to columns `keep` of a written result of `aligned`: n_best and count_sum over each text's links."""
    lists = stored.where("block_pairs is not null").select(F.col("block").alias("of_block"), F.posexplode("block_pairs").alias("at", "pair"))
    found = lists.join(pair_counts(stored, b_ids), "pair").select("of_block", "at", "count", "best")
    rows = stored.select(*keep, "block", "pair_at", "pair_times")
    schema = T.StructType([*[stored.schema[c] for c in keep], *[T.StructField(c, T.LongType()) for c in COUNTED]])

    def summed(rows: pa.Table, counts: pa.Table) -> pa.Table:
        size = counts.num_rows
        count, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
        at = counts.column("at").to_numpy()
        count[at], best[at] = counts.column("count").to_numpy(), counts.column("best").to_numpy()
        lists, times = rows.column("pair_at").combine_chunks(), rows.column("pair_times").combine_chunks()
        at, times = lists.flatten().to_numpy(), times.flatten().to_numpy()
        ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        sums = [np.diff(np.append(0, np.cumsum(v[at] * times))[ends]) for v in (best, count)]
        return pa.Table.from_arrays([*(rows.column(c) for c in keep), *map(pa.array, sums)], names=schema.names)

    return rows.groupBy("block").cogroup(found.groupBy("of_block")).applyInArrow(summed, schema)
