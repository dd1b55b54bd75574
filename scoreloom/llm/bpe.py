"""BPE encoding and decoding with a pair occurrence index.

Each task numbers the distinct runs without white space of a block of texts and encodes all that are new to it at once: an index
maps the rank of every pair to all its positions in the block. Ranks are applied in ascending order; each application
merges a whole position list and moves the neighbours it touches to the lists of their new pairs. Texts are then
assembled from the runs without a loop over tokens.

Cases. Null and empty texts: no ids. Strings of special tokens in a text give their ids. Very long texts form a block of
their own. Repeated rows: each row on its own. Empty tables: empty result. Characters outside the vocabulary cannot
occur, since it holds every byte. Result columns replace input columns of the same name.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from scoreloom.llm import blocks as B

#: Bytes of text whose runs are encoded together.
BLOCK = 2 << 20
#: Runs that a task remembers; it starts anew beyond.
REMEMBERED = 200_000


@functools.cache
def _recent() -> re.Pattern:
    """Characters younger than Unicode 3.2. Tables of different age, Python's and the library's among them, disagree about their
    kind, lower case and place beside other marks."""
    points = [c for c in range(0x110000) if unicodedata.ucd_3_2_0.category(chr(c)) == "Cn"]
    starts = [c for k, c in enumerate(points) if k == 0 or points[k - 1] != c - 1]
    ends = [c for k, c in enumerate(points) if k + 1 == len(points) or points[k + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


class Vocabulary:
    """A tokenizer file of kind BPE with word ends, as arrays."""

    def __init__(self, content: str):
        file = json.loads(content)
        self.content = content
        model = file["model"]
        ids = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *self.special.items()]}
        self.suffix = model["end_of_word_suffix"]
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.piece = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        space = regex.compile(file["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        self.spaces = [c for c in map(chr, range(0x3100)) if c != " " and space.fullmatch(c)]
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([ids[letter[b]] for b in range(256)], np.int32)
        self.final = np.array([ids[letter[b] + self.suffix] for b in range(256)], np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.int64)
        right = np.array([ids[b] for _, b in merges], np.int64)
        self.base = len(self.tokens) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in merges], np.int32)
        self.doubled = left == right
        # ranks whose merge can bring up a pair of a lower rank: applied to one place of a piece at a time
        least = np.full(self.base, len(merges), np.int64)
        np.minimum.at(least, left, np.arange(len(merges)))
        np.minimum.at(least, right, np.arange(len(merges)))
        self.careful = least[self.made] < np.arange(len(merges))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 without one."""
        key = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def chunks(self, text: str) -> Iterator[list[str | int]]:
        """Runs without white space, which no piece crosses, and ids of special tokens, in order."""
        end = 0
        for found in self.split.finditer(text) if self.split else ():
            yield self._normal(text[end : found.start()])
            yield [self.special[found[0]]]
            end = found.end()
        yield self._normal(text[end:] if end else text)

    def _normal(self, text: str) -> list[str]:
        plain = text.isascii()
        if not plain and _recent().search(text):
            return self.library.normalizer.normalize_str(text).split(" ")
        if not plain:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma: one lower form wherever it stands
        for space in self.spaces[:5] if plain else self.spaces:
            text = text.replace(space, " ")
        return text.lower().split(" ")

    @functools.cached_property
    def library(self) -> Tokenizer:
        """Its own tables decide on recent characters."""
        return Tokenizer.from_str(self.content)

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii() or not _recent().search(chunk):
            return self.piece.findall(chunk)
        return [chunk[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(chunk)]

    def encode_chunks(self, chunks: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks, one after another, and how many each has."""
        pieces, numbers = _Numbers(), []
        of_chunk = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            found = [chunk] if isinstance(chunk, int) else self._pieces(chunk)
            of_chunk[k] = len(found)
            numbers.extend(map(pieces.__getitem__, found))
        if not numbers:
            return np.zeros(0, np.int32), of_chunk
        special = np.array([isinstance(p, int) for p in pieces])
        made, size = self.encode([p for p in pieces if isinstance(p, str)]) if not special.all() else (np.zeros(0, np.int32), [])
        counts = np.ones(len(pieces), np.int64)
        counts[~special] = size
        in_special = np.repeat(special, counts)
        ids = np.empty(len(in_special), np.int32)
        ids[~in_special] = made
        ids[in_special] = [p for p in pieces if isinstance(p, int)]
        numbers = np.array(numbers)
        ends = np.append(0, np.cumsum(counts[numbers]))[np.append(0, np.cumsum(of_chunk))]
        return B.ragged(ids, np.cumsum(counts)[numbers] - counts[numbers], counts[numbers]), np.diff(ends)

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after another, and how many each has."""
        data = np.frombuffer("".join(pieces).encode(), np.uint8)
        lengths = np.array([len(p.encode()) for p in pieces], np.int64)
        ends = np.cumsum(lengths)
        symbols = self.inner[data]
        symbols[ends - 1] = self.final[data[ends - 1]]
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        merge_all(self, symbols, piece)
        alive = symbols >= 0
        return symbols[alive], np.bincount(piece[alive], minlength=len(pieces))


def merge_all(v: Vocabulary, symbols: np.ndarray, piece: np.ndarray) -> None:
    """Apply all merges in place; a symbol that went into its left neighbour becomes -1."""
    n = len(symbols)
    following = np.arange(1, n + 1, dtype=np.int32)
    following[np.append(piece[1:] != piece[:-1], True)] = n
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[np.append(True, piece[1:] != piece[:-1])] = -1
    pair = np.full(n + 1, -1, np.int32)  # rank of the pair that begins here; one place more for "no symbol"
    has = np.flatnonzero(following < n)
    pair[has] = v.rank(symbols[has], symbols[has + 1])
    index: dict[int, list[np.ndarray]] = {}
    waiting: list[int] = []

    def enter(at: np.ndarray) -> None:
        """Add positions to the lists of their ranks."""
        rank = pair[at]
        at, rank = at[rank >= 0], rank[rank >= 0]
        if not len(at):
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for r, positions in zip(rank[np.append(0, cuts)].tolist(), np.split(at, cuts) if len(cuts) else [at], strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(waiting, r)
            index[r].append(positions)

    enter(has)
    while waiting:
        r = heapq.heappop(waiting)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[pair[at] == r]
        if not len(at):
            continue
        if v.careful[r]:
            first = np.append(True, piece[at[1:]] != piece[at[:-1]])
            index[r] = [at]
            heapq.heappush(waiting, r)
            at = at[first]
        elif v.doubled[r]:  # of places that overlap, every other one from the left
            chained = np.append(False, following[at[:-1]] == at[1:])
            run = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
        gone = following[at]
        after = following[gone]
        symbols[at] = v.made[r]
        symbols[gone] = -1
        pair[gone] = -1
        following[at] = after
        inside = after < n
        before[after[inside]] = at[inside]
        pair[at] = -1
        pair[at[inside]] = v.rank(symbols[at[inside]], symbols[after[inside]])
        left = before[at]
        has_left = left >= 0
        left, right = left[has_left], at[has_left]
        pair[left] = v.rank(symbols[left], symbols[right])
        enter(np.concatenate([at[inside], left]) if not v.doubled[r] else np.unique(np.concatenate([at[inside], left])))


class _Numbers(dict):
    """Numbers keys as they come."""

    def __missing__(self, key):
        self[key] = len(self)
        return self[key]


def _replaced(df: DataFrame, *names: str) -> list[str]:
    return [c for c in df.columns if c.lower() not in {n.lower() for n in names}]


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, v: Vocabulary, keep: list[str]) -> Batches:
    """Columns `keep` and the ids of column `__text`."""
    numbers, flat, lengths = _Numbers(), np.zeros(0, np.int32), np.zeros(0, np.int64)
    for table in B.gathered(batches, "__text", BLOCK):
        if len(numbers) > REMEMBERED:
            numbers, flat, lengths = _Numbers(), flat[:0], lengths[:0]
        texts, known = [], len(numbers)
        for value in table.column("__text"):
            found = [np.fromiter(map(numbers.__getitem__, part), np.int32, len(part)) for part in v.chunks(value.as_py() or "")]
            texts.append(found[0] if len(found) == 1 else np.concatenate(found))
        made, counts = v.encode_chunks(list(numbers)[known:])
        flat, lengths = np.concatenate([flat, made]), np.concatenate([lengths, counts])
        starts = np.cumsum(lengths) - lengths
        done = 0
        for batch in table.drop_columns(["__text"]).to_batches(max_chunksize=1024):
            mine = texts[done : done + batch.num_rows]
            done += batch.num_rows
            every = np.concatenate(mine)
            ids = B.ragged(flat, starts[every], lengths[every])
            size = [int(lengths[m].sum()) for m in mine]
            column = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*keep, "ids"])


def _decoded(batches: Batches, v: Vocabulary, keep: list[str], ids: str, into: str) -> Batches:
    """Columns `keep` and the text of the ids."""
    most = max(v.tokens) + 1
    text = [(" " + v.tokens[i]).encode() if i in v.tokens else b"" for i in range(most)]
    length = np.array([len(t) for t in text], np.int64)
    data, starts = np.frombuffer(b"".join(text), np.uint8), np.cumsum(length) - length
    for whole in batches:
        for begin in range(0, whole.num_rows, 512):
            batch = whole.slice(begin, 512)
            column = batch.column(ids)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            count = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()], np.int64)
            valid = (flat >= 0) & (flat < most)
            size = length[np.where(valid, flat, 0)] * valid
            made = B.ragged(data, starts[np.where(valid, flat, 0)], size)
            ends = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(count))]
            keep_byte = np.ones(len(made), bool)
            keep_byte[ends[:-1][np.diff(ends) > 0]] = False  # the space before the first token
            some = np.diff(ends) > 0
            offsets = np.append(0, np.cumsum(np.diff(ends) - some)).astype(np.int64)
            decoded = pa.LargeStringArray.from_buffers(len(count), pa.py_buffer(offsets), pa.py_buffer(made[keep_byte].tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], decoded], [*keep, into])


def encode(
    df: DataFrame, vocabulary: str, text: str = "text", keep: list[str] | None = None, decoded: str | None = None
) -> DataFrame:
    """Columns `keep` (default: all but the text) and `ids`, an array of token ids. `vocabulary`: content of the tokenizer file.

    `decoded`: adds a column of this name with the text of the ids, made by the same worker.
    """
    added = ["ids", *([decoded] if decoded else [])]
    keep = _replaced(df.select(*(keep if keep is not None else [c for c in df.columns if c != text])), *added)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])
    if decoded:
        schema = schema.add(decoded, T.StringType(), False)
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        v = Vocabulary(shared.value)
        made = _encoded(batches, v, keep)
        return _decoded(made, v, [*keep, "ids"], "ids", decoded) if decoded else made

    return df.select(*[df[c] for c in keep], df[text].alias("__text")).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Adds the text of the ids as the tokenizer file's decoder gives it: tokens with one space between; unknown ids are left out."""
    keep = _replaced(df, into)
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(into, T.StringType(), False)])
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Batches) -> Batches:
        return _decoded(batches, Vocabulary(shared.value), keep, ids, into)

    return df.select(*keep).mapInArrow(run, schema)
