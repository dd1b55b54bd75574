"""Helpers for vector columns: valid rows, blocks as matrices, exact scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(vector: str) -> Column:
    """Neither null nor holding null or non-finite components."""
    col = F.col(vector)
    return col.isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, kind=np.float64) -> np.ndarray:
    """Rows of lists as a matrix; shorter ones are padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), kind)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max())
    if (lengths == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width), kind)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    pad = lambda m: np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m
    return pad(a), pad(b)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed component by component, so that equal rows have equal products wherever they stand."""
    total = np.zeros(len(a), a.dtype)
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def best(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, exact=products) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, score) of each query's k best rows other than its own id, ties to smaller ids.

    A matrix product finds what can be among them, up to its rounding; those are scored exactly.
    """
    if not len(data) or not len(queries):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, data.dtype)
    queries, data = same_width(queries, data)
    rough = queries.astype(np.float64) @ data.T.astype(np.float64)
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    own = min(k, rough.shape[1])
    least = np.partition(rough, rough.shape[1] - own, axis=1)[:, rough.shape[1] - own]
    size = np.abs(queries).astype(np.float64) @ np.abs(data).max(0).astype(np.float64)
    with np.errstate(invalid="ignore"):
        at, row = np.nonzero((rough >= (least - 1e-12 * size)[:, None]) & (rough > -np.inf))
    score = exact(queries[at], data[row])
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    rank = np.arange(len(at)) - np.searchsorted(at, at, "left")
    keep = rank < k
    return at[keep], ids[row[keep]], score[keep]
