"""Numbers, running sums, neighbours and ranks along an order of any length, without one task that sees all of it.

Rows are dealt into range blocks, one for each shuffle partition, and written in order. What a block needs from the rows
before it is one number a block, summed up on the driver; what a frame needs across the edge of a block are copies of the few rows
beside it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.sources.scratch import written

_ROW_BITS = 33  # monotonically_increasing_id: the partition's number, then the row's in it
#: Rows of a chunk in which frames are computed.
CHUNK = 1 << 16
#: First digits of a digest by which rows are dealt; fewer rows than this are never too many for a task.
DIGITS, LEAST_HEAVY = 3, 1 << 10


def in_blocks(df: DataFrame, order: list[Column], split_ties: bool = False) -> DataFrame:
    """The rows with `_block` and `_row` (from 0), which together follow the order.

    Rows that the order does not tell apart stay in one block, unless `split_ties`: then they may stand in any sequence and
    blocks, and however many there are, no task gets more than its share. The table is read more than once: pass a stored one.
    """
    if split_ties:
        df = df.withColumn("_tie", F.monotonically_increasing_id())
        order = [*order, F.col("_tie")]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    stored = written(placed, "ordered")
    row = F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return stored.withColumns({"_block": F.shiftright("_id", _ROW_BITS), "_row": row}).drop("_id")


def _before(blocks: DataFrame, amounts: dict[str, Column]) -> DataFrame:
    """What all earlier blocks hold of each amount: a row a block, of which there are as many as shuffle partitions."""
    by_block = blocks.groupBy("_block").agg(*[a.alias(name) for name, a in amounts.items()])
    held = sorted(tuple(r) for r in by_block.collect())
    rows, so_far = [], [None] * len(amounts)
    for block, *sums in held:
        rows.append((block, *so_far))
        so_far = [b if a is None else a if b is None else a + b for a, b in zip(so_far, sums, strict=True)]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in by_block.schema.fields])
    return F.broadcast(blocks.sparkSession.createDataFrame(rows, schema))


def _placed(df: DataFrame, order: list[Column], name: str, sums: dict[str, str]) -> DataFrame:
    blocks = in_blocks(df, order, split_ties=True)
    amounts = {"_rows": F.count("*")} | {f"_sum_{new}": F.sum(col) for new, col in sums.items()}
    placed = blocks.join(_before(blocks, amounts), "_block")
    placed = placed.withColumn(name, F.coalesce("_rows", F.lit(0)) + F.col("_row") + 1)
    up_to = W.partitionBy("_block").orderBy("_row").rowsBetween(W.unboundedPreceding, 0)
    running = {new: F.coalesce(F.col(f"_sum_{new}"), F.lit(0)) + F.coalesce(F.sum(col).over(up_to), F.lit(0)) for new, col in sums.items()}
    return placed.withColumns(running).drop("_row", *amounts) if running else placed.drop("_row", *amounts)


def numbered(df: DataFrame, order: list[Column], name: str, sums: dict[str, str] | None = None) -> DataFrame:
    """Adds each row's number, 1 to n, and for each of `sums`, new name to column of whole numbers or decimals, the sum of all
    rows up to it. Rows that the order does not tell apart follow each other in any sequence."""
    return _placed(df, order, name, sums or {}).drop("_block")


def numbered_by_digest(df: DataFrame, digest: Column, name: str, packed: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Adds each row's number, 1 to n, in the order of `digest`, an evenly spread text of hexadecimal digits that is made of the row.

    One pass counts the rows by the digest's first digits; another deals them by these, and a row's number is its place among
    them after all earlier ones. Rows travel once, without the digest, and are not stored in between. Digits that hold more than a
    task's share, as equal rows do, go through range blocks. The table is read more than once: it must give the same rows each time.
    `packed`: for columns that travel in another form, how that is made and undone.
    """
    df, first = df.withColumn("_first", F.substring(digest, 1, DIGITS)), F.col("_first")
    counts = sorted(tuple(r) for r in df.groupBy("_first").count().collect())  # at most 16 ** DIGITS
    rows, tasks = sum(n for _, n in counts), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = [d for d, n in counts if n > LEAST_HEAVY and n * tasks > rows]
    starts, earlier, earlier_heavy = [], 0, 0
    for d, n in counts:
        starts.append((d, earlier - earlier_heavy if d in heavy else earlier))
        earlier, earlier_heavy = earlier + n, earlier_heavy + n * (d in heavy)
    before = F.broadcast(df.sparkSession.createDataFrame(starts, "_first string, _before long"))
    light = df.filter(~first.isin(heavy)) if heavy else df
    inside = F.row_number().over(W.partitionBy("_first").orderBy("_digest"))
    forms = packed or {}
    dealt = light.withColumns({c: there for c, (there, _) in forms.items()}).repartition("_first").withColumns({c: back for c, (_, back) in forms.items()})
    made = dealt.withColumn("_digest", digest).withColumn("_place", inside.cast("long"))
    if heavy:
        hot = written(df.filter(first.isin(heavy)).withColumn("_digest", digest), "hot-digests")
        made = made.unionByName(numbered(hot, [F.col("_digest")], "_place"))
    return made.join(before, "_first").withColumn(name, F.col("_before") + F.col("_place")).drop("_first", "_digest", "_place", "_before")


def with_neighbours(df: DataFrame, place: str, before: int, after: int, size: int = CHUNK) -> DataFrame:
    """Cuts numbered rows into chunks that also hold their neighbours; windows over W.partitionBy("_chunk").orderBy(place)
    with a frame of at most so many rows before and after are then right where `_own` holds. Keep only those afterwards."""
    if max(before, after) > size:
        raise ValueError("a frame must not be longer than a chunk")
    chunk, inside = F.floor((F.col(place) - 1) / size), (F.col(place) - 1) % size
    held = F.array(
        F.struct(chunk.alias("_chunk"), F.lit(True).alias("_own")),
        F.when(inside >= size - before, F.struct((chunk + 1).alias("_chunk"), F.lit(False).alias("_own"))),
        F.when((inside < after) & (chunk > 0), F.struct((chunk - 1).alias("_chunk"), F.lit(False).alias("_own"))),
    )
    return df.select("*", F.inline(F.array_compact(held)))


def ranked_values(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The distinct (keys, value) with their rows `n`, the rows of the group `group_rows` and the dense rank of the value in its group,
    the largest first and NULL before it.

    Equal values are counted before they are moved, and the distinct ones of a group are spread over blocks by value. What
    a block has to know of its groups is joined by group and block, so a large group is many keys.
    """
    distinct = written(df.groupBy(*keys, value).agg(F.count("*").alias("n")), "distinct")
    order = [*[F.col(k).asc_nulls_first() for k in keys], F.col(value).desc_nulls_first()]
    placed = written(_placed(distinct, order, "_place", {}), "ranked")
    pieces = placed.groupBy(*keys, "_block").agg(F.min("_place").alias("_first"), F.sum("n").alias("group_rows"))
    groups = pieces.groupBy(*keys).agg(F.min("_first").alias("_first"), F.sum("group_rows").alias("group_rows"))
    groups = groups.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first", "group_rows")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] or [F.lit(True)]
    pieces = pieces.select(*keys, "_block").join(groups, reduce(Column.__and__, same))
    pieces = pieces.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_piece"), "_first", "group_rows")
    joined = placed.join(pieces, reduce(Column.__and__, [*same, F.col("_block") == F.col("_piece")]))
    return joined.select(*keys, value, "n", "group_rows", (F.col("_place") - F.col("_first") + 1).alias(name))
