"""Exact top-k search by inner product as a Voronoi join.

Pivots are the queries with the lowest hash of the id, one for each QUERIES queries. Every query goes to its nearest pivot p; a group's
radius U is the largest distance of its queries from p. For a row s and any query q of the group
    p.s - U |s|  <=  q.s  <=  p.s + U |s|.
The (k + 1)-th largest lower bound of different ids is a score that every query of the group reaches with k rows besides those of its
own id; each task gives its k + 1 largest per group, so the bounds come from summaries. A row is sent to a group only if its upper
bound reaches that score. Groups of more than QUERIES queries are split, rows are dealt into parts of about ROWS,
and every part is solved where it lies; the best k of a query's parts are its result.

Equal vectors tie, so of each only k rows of an id and 2 k rows with the smallest ids can matter; the rest of a group of copies is left out beforehand.
Where vectors are spread evenly in many dimensions the bounds exclude little, and every row meets every group.

Cases. Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take no part. Shorter vectors
count as padded with zeros. Repeated ids: each row counts, none against its own id. Ties: smaller id. Fewer than k
candidates: all. Empty tables: empty result. Scores are computed in the vectors' own type; longs are exact within 64 bits.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from scoreloom.llm import vectors as V
from scoreloom.llm.shared import written

#: Queries of a part and rows of a part; pivots at most.
QUERIES, ROWS, PIVOTS = 256, 1 << 14, 1024


def few_copies(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (id, vector) with equal vectors those that can be among the k smallest ids besides one id.

    Of each id k rows, of these the 2 k with the smallest ids: any one id has at most k of them. `part` shares out large groups of copies first.
    """
    spread = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)))
    for by, most in ((["vector", "part", "id"], k), (["vector", "part"], 2 * k), (["vector"], 2 * k)):
        place = F.row_number().over(W.partitionBy(*by).orderBy("id"))
        spread = spread.withColumn("place", place).where(F.col("place") <= most)
    return spread.select("id", "vector")


def largest(bounds: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In each column the `most` largest bounds of different ids, with the ids; -inf where there are fewer."""
    order = np.argsort(-bounds, 0, kind="stable")
    bounds, ids = np.take_along_axis(bounds, order, 0), np.take_along_axis(ids, order, 0)
    if any(len(np.unique(c)) < len(c) for c in ids.T):
        for c in range(bounds.shape[1]):
            first = np.sort(np.unique(ids[:, c], return_index=True)[1])[:most]
            bounds[: len(first), c], ids[: len(first), c] = bounds[first, c], ids[first, c]
            bounds[len(first) :, c] = -np.inf
    return bounds[:most], ids[:most]


def solve(rows: DataFrame, queries: DataFrame, keys: list[str], k: int, kind: str) -> DataFrame:
    """(query, rank, id, score): the k best over all parts, where rows and queries of a part share `keys`."""

    def part(left: pa.Table, right: pa.Table) -> pa.Table:
        numeric = np.int64 if kind == "long" else np.float64
        data, ids = V.matrix(left.column("vector"), numeric), left.column("id").to_numpy()
        asked, names = V.matrix(right.column("vector"), numeric), right.column("id").to_numpy()
        found = []
        for start in range(0, len(asked), QUERIES):
            at, row, score = V.best(asked[start : start + QUERIES], names[start : start + QUERIES], data, ids, k)
            found.append((names[start + at], row, score))
        columns = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"query": pa.array(columns[0], pa.int64()), "id": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2].astype(numeric))})

    best = rows.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(part, f"query long, id long, score {kind}")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "id", "score")


def _nearest(points: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points, pivots = V.same_width(points.astype(np.float64), pivots.astype(np.float64))
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * points @ pivots.T
    at = square.argmin(1)
    return at, np.sqrt(((points - pivots[at]) ** 2).sum(1))


def search(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, rank, id, score) for tables (id long, vector array<long>); a row never answers a query of its own id."""
    usable = F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull())
    rows = written(few_copies(rows.where(usable).select("id", "vector"), k), "rows")
    queries = written(queries.where(usable).select("id", "vector").dropDuplicates(["id", "vector"]), "queries")
    spark = rows.sparkSession
    asked, there = queries.count(), rows.count()
    if not asked or not there:
        return spark.createDataFrame([], "query long, rank int, id long, score long")
    chosen = queries.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, -(-asked // QUERIES))).select("vector").toArrow()
    pivots = V.matrix(chosen.column("vector"), np.float64)
    shared = spark.sparkContext.broadcast(pivots)

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = _nearest(V.matrix(batch.column("vector")), shared.value)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], ["id", "vector", "group", "far"])

    queries = written(queries.mapInArrow(group, "id long, vector array<long>, group int, far double"), "groups")
    summary = queries.groupBy("group").agg(F.max("far").alias("far"), F.count("*").alias("many")).collect()  # a row for each pivot
    radius, splits = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in summary:
        radius[r["group"]], splits[r["group"]] = r["far"] * (1 + 1e-9) + 1e-9, -(-r["many"] // QUERIES)

    def ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        data, centres = V.same_width(V.matrix(batch.column("vector")), shared.value)
        middle = data @ centres.T
        slack = np.sqrt((data**2).sum(1))[:, None] * radius + 1e-9 * (np.abs(data).max(1)[:, None] * np.abs(centres).sum(1) + 1)
        return middle - slack, middle + slack

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, of = np.full((0, len(pivots)), -np.inf), np.zeros((0, len(pivots)), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                ids = np.repeat(batch.column("id").to_numpy()[:, None], len(pivots), 1)
                most, of = largest(np.concatenate([most, ends(batch)[0]]), np.concatenate([of, ids]), k + 1)
        names = np.tile(np.arange(len(pivots), dtype=np.int32), len(most))
        there = np.isfinite(most.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(x[there]) for x in (names, of.ravel(), most.ravel())], ["group", "id", "bound"])

    place = F.row_number().over(W.partitionBy("group").orderBy(F.desc("bound")))
    reached = rows.mapInArrow(lower, "group int, id long, bound double").groupBy("group", "id").agg(F.max("bound").alias("bound"))
    reached = reached.withColumn("place", place).where(F.col("place") == k + 1)
    least = np.full(len(pivots), -np.inf)
    for r in reached.collect():  # a row for each pivot
        least[r["group"]] = r["bound"]

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                at, to = np.nonzero((ends(batch)[1] >= least) & (splits > 0))
                many = splits[to]
                at, to = np.repeat(at, many), np.repeat(to, many)
                split = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                columns = [batch.column(c).take(pa.array(at)) for c in ("id", "vector")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(to.astype(np.int32)), pa.array(split.astype(np.int32))], ["id", "vector", "group", "split"])

    parts = -(-there // ROWS)
    data = rows.mapInArrow(sent, "id long, vector array<long>, group int, split int").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    of_group = F.element_at(F.array(*[F.lit(int(max(1, s))) for s in splits]), F.col("group") + 1)
    queries = queries.select("id", "vector", "group", F.pmod(F.xxhash64("id"), of_group).cast("int").alias("split"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    return solve(data, queries, ["group", "split", "part"], k, "long")


def statement(k: int, every: int, scale: int) -> str:
    """The query over a table `embeddings` in SQL."""
    return f"""WITH v AS (SELECT vec_id, [floor({scale} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % {every} = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= {k}"""
