"""Approximate nearest neighbours with learned partitions.

Fit, on a bounded sample (the SAMPLE vectors with the lowest hash of the id): the neighbour graph of the sample is cut into
balanced partitions, which start from halving along main directions and are refined by moving vectors towards the partition of most
of their neighbours within a limit on size; a softmax classifier learns in which partitions a vector's neighbours lie.
Index: every vector of the table goes to its most probable partition. Search: a query goes to its most probable
partitions, where it is scored exactly against all vectors; the best over these partitions are its result.

How many partitions a query visits is set by measurement: the queries with the lowest hash of the id, CALIBRATE of them, are searched
exhaustively, and as many partitions are visited as hold RECALL of their true neighbours. Partitions are dealt into parts of about
ROWS vectors, so a partition that holds a large share of the table is no single task. Of equal vectors only the k + 1
smallest ids can be in a result; the others are left out beforehand.

Cases. Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take no part. Shorter
vectors count as padded with zeros. Ties: smaller id. Fewer than k candidates: all. Repeated ids: each row counts, none against its own
id. Empty tables: empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.llm import vectors as V
from scoreloom.llm.exact_top import few_copies, solve
from scoreloom.llm.shared import written

SAMPLE, CALIBRATE, RECALL = 4096, 128, 0.95
#: Vectors of a partition on average, and the least and greatest number of partitions; vectors of a part.
SHARE, LEAST, MOST, ROWS = 2048, 8, 64, 1 << 13
NEIGHBOURS, SLACK = 10, 1.05


def _graph(x: np.ndarray) -> np.ndarray:
    """Numbers of the nearest vectors of each, by inner product."""
    k = min(NEIGHBOURS, len(x) - 1)
    found = np.zeros((len(x), k), np.int64)
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ x.T
        near[np.arange(len(near)), np.arange(start, start + len(near))] = -np.inf
        found[start : start + 512] = np.argpartition(-near, k - 1, axis=1)[:, :k] if k else found[start : start + 512]
    return found


def _halved(x: np.ndarray, rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Rows in `parts` groups of equal size, split along the direction of largest spread."""
    if parts == 1:
        return [rows]
    centred = x[rows] - x[rows].mean(0)
    _, axes = np.linalg.eigh(centred.T @ centred)
    order = rows[np.argsort(centred @ axes[:, -1], kind="stable")]
    cut = len(rows) * (parts // 2) // parts
    return _halved(x, order[:cut], parts // 2) + _halved(x, order[cut:], parts - parts // 2)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """The partition of each vector; none holds more than SLACK times its even share."""
    label = np.zeros(len(x), np.int64)
    for k, rows in enumerate(_halved(x, np.arange(len(x)), parts)):
        label[rows] = k
    most = int(np.ceil(SLACK * len(x) / parts))
    a = np.repeat(np.arange(len(x)), graph.shape[1])
    b = graph.ravel()
    for _ in range(rounds):
        near = np.zeros((len(x), parts))
        np.add.at(near, (a, label[b]), 1)
        np.add.at(near, (b, label[a]), 1)
        gain = near - near[np.arange(len(x)), label][:, None]
        wanted = gain.argmax(1)
        size = np.bincount(label, minlength=parts)
        moved = 0
        for v in np.argsort(-gain.max(1), kind="stable"):
            if gain[v, wanted[v]] <= 0:
                break
            if size[wanted[v]] < most:
                size[wanted[v]] += 1
                size[label[v]] -= 1
                label[v] = wanted[v]
                moved += 1
        if not moved:
            break
    return label


def classifier(x: np.ndarray, goal: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last row is the intercept) of a softmax regression on the shares `goal`, by Adam with a fixed start."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros((x.shape[1], goal.shape[1]))
    first, second = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        slope = x.T @ (_shares(x @ w) - goal) / len(x) + ridge * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope**2
        w -= 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def _shares(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _ranked(x: np.ndarray, w: np.ndarray, scale: float) -> np.ndarray:
    """Partitions of each vector, most probable first."""
    x = x[:, : len(w) - 1] if x.shape[1] >= len(w) else np.pad(x, ((0, 0), (0, len(w) - 1 - x.shape[1])))
    return np.argsort(-(x / scale @ w[:-1] + w[-1]), axis=1, kind="stable")


def fit(sample: np.ndarray, parts: int) -> tuple[np.ndarray, float]:
    """Classifier and scale."""
    scale = float(np.sqrt((sample**2).sum(1).mean())) or 1.0
    x = sample / scale
    graph = _graph(x)
    label = balanced_partition(x, graph, parts)
    goal = np.zeros((len(x), parts))
    goal[np.arange(len(x)), label] = 1
    for k in range(graph.shape[1]):
        goal[np.arange(len(x)), label[graph[:, k]]] += 1
    return classifier(x, goal / goal.sum(1, keepdims=True)), scale


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, score) for tables (id long, vector array<double>)."""
    usable = F.col("id").isNotNull() & V.valid("vector") & F.exists("vector", lambda x: x != 0)
    rows = written(few_copies(rows.where(usable).select("id", "vector"), k), "rows")
    queries = written(queries.where(usable).select("id", "vector").dropDuplicates(["id", "vector"]), "queries")
    spark = rows.sparkSession
    there = rows.count()
    if not there or not queries.limit(1).count():
        return spark.createDataFrame([], "query long, rank int, id long, score double")
    lowest = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    sample = V.matrix(lowest(rows, SAMPLE).column("vector"))
    parts = max(1, min(MOST, max(LEAST, there // SHARE), len(sample) // 2))
    weights, scale = fit(sample, parts)
    asked = lowest(queries, CALIBRATE)
    model = spark.sparkContext.broadcast((weights, scale, V.matrix(asked.column("vector")), asked.column("id").to_numpy()))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s, _, _ = model.value
        for batch in batches:
            if batch.num_rows:
                at = _ranked(V.matrix(batch.column("vector")), w, s)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], ["id", "vector", "partition"])

    rows = written(rows.mapInArrow(index, "id long, vector array<double>, partition int"), "index")

    def exhaustive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, x, names = model.value
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids, partition = batch.column("id").to_numpy(), batch.column("partition").to_numpy()
                at, row, score = V.best(x, names, V.matrix(batch.column("vector")), ids, k)
                order = np.argsort(ids, kind="stable")
                found = partition[order[np.searchsorted(ids[order], row)]]
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(row), pa.array(score), pa.array(found)], ["query", "id", "score", "partition"])

    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    true = rows.mapInArrow(exhaustive, "query int, id long, score double, partition int").withColumn("place", place)
    where = true.where(F.col("place") <= k).select("query", "partition").toPandas()  # at most k rows for each of CALIBRATE queries
    order = _ranked(V.matrix(asked.column("vector")), weights, scale)
    needed = np.argsort(order, axis=1)[where["query"].to_numpy(), where["partition"].to_numpy()] + 1
    visited = int(np.quantile(needed, RECALL, method="inverted_cdf")) if len(needed) else 1

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, s, _, _ = model.value
        for batch in batches:
            if batch.num_rows:
                at = _ranked(V.matrix(batch.column("vector")), w, s)[:, :visited].astype(np.int32)
                offsets = pa.array(np.arange(len(at) + 1, dtype=np.int32) * visited)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(at.ravel()))], ["id", "vector", "partitions"])

    sizes = {r["partition"]: r["count"] for r in rows.groupBy("partition").count().collect()}  # a row for each partition
    of_partition = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(p, 0) // ROWS))) for p in range(parts)]), F.col("partition") + 1)
    data = rows.withColumn("part", F.pmod(F.xxhash64("id"), of_partition).cast("int"))
    routed = queries.mapInArrow(route, "id long, vector array<double>, partitions array<int>")
    routed = routed.select("id", "vector", F.explode("partitions").alias("partition"))
    # queries of a part are dealt out too, so that none meets them all
    blocks = max(1, -(-queries.count() // 4096))
    routed = routed.select("*", F.explode(F.sequence(F.lit(0), of_partition - 1)).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return solve(data, routed, ["partition", "part", "block"], k, "double")
