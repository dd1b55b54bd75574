"""Arrow batches in blocks of bounded bytes, words and their 64-bit hashes without a loop over words.

A word is a longest run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Hashes are polynomials modulo 2^64
over a random value for each byte, mixed afterwards. Equal words have equal hashes; different words collide with
probability about 2^-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose bits all depend on all bits."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column in order, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]], offsets - offsets[0]) if len(column) else (data[:0], np.zeros(1, np.int64))


def blocks(batches: Iterator[pa.RecordBatch], text: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most `most` bytes of text each, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.append(0, np.cumsum(lengths.astype(np.int64)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, end - start)
            start = end


def gathered(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """The same rows in tables of about `most` bytes of text."""
    held, size = [], 0
    for batch in blocks(batches, text, most):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(text))).as_py() or 0
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))[_LOWER]
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            values = np.full(n + (1 << 16), base, U)
            values[0] = 1
            _powers[name] = np.multiply.accumulate(values)
    return _powers["up"][:n], _powers["down"][:n]


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and len + 1 offsets into them by text."""
    word = _IS_WORD[data]
    first = np.zeros(len(data) + 1, bool)  # a text begins here
    first[offsets] = True
    edge = np.ones(len(data) + 1, bool)  # no word goes on from the byte before
    edge[1:-1] = ~word[:-1] | first[1:-1]
    starts = np.flatnonzero(word & edge[:-1])
    stop = np.ones(len(data), bool)
    stop[:-1] = ~word[1:] | first[1:-1]
    ends = np.flatnonzero(word & stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, U)
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_VALUE[data] * up, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def shingle_hashes(words: np.ndarray, of_text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `width` words by text, not yet distinct, and len + 1 offsets; a shorter text gives one run of all."""
    counts = np.diff(of_text)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(offsets[-1], U)
    at = np.repeat(of_text[:-1] - offsets[:-1], made) + np.arange(len(out))
    last = np.repeat(of_text[1:], made) - 1
    out[:] = U(width)
    with np.errstate(over="ignore"):
        for k in range(width):
            inside = at + k <= last
            step = mix(out * _BASE + words[np.minimum(at + k, last)])
            out = np.where(inside, step, out)
    return out, offsets


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[s : s + n] for every s, n, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return values[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]
