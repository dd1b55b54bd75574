"""A load that lets sound rows through, sets the others aside with every rule they break, and counts both as it writes.

Each table is read once for its rows: keys that repeat and references without a parent are found first, from counts by key, and
meet the rows again as marks. A row is then tagged with all rules it breaks, and one write splits accepted from
quarantined rows; the counts of rows and of violations are observed by that write, not by another pass. Parents are judged before
their children, so a reference to a quarantined parent is broken too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom import schemas
from scoreloom.functions.text import has_value, is_uuid, packed_id, try_parse_score, unpacked_id
from scoreloom.operators.skew import dealt
from scoreloom.sources.scratch import COMPRESSION, written

ORDER = ["staging", "subjects", "institutions", "participants", "exam_results"]
SCORE_FIELDS = [f"{s.prefix}_{part}" for s in schemas.SUBJECTS for part in ("ball100", "ball")]
BROKEN = "broken_rules"
#: Marks up to this number may be sent to all tasks, where their files are small as well; more are always joined by key.
FEW_MARKS = 1 << 19


class Rule(NamedTuple):
    name: str
    broken: Column


class Judged(NamedTuple):
    """One table after its load. `violations` has a count for each rule, `quarantined` counts rows."""

    accepted: DataFrame
    set_aside: DataFrame
    rows: int
    quarantined: int
    violations: dict[str, int]


def _marked(df: DataFrame, marks: DataFrame, column: str, mark: str) -> DataFrame:
    """The rows with a flag that says whether their value is among the marked ones; marks are few, values may be hot.

    Marks are stored first. Then they can be counted, and where they are few indeed the rows are neither dealt nor sorted to meet them.
    """
    marks = written(marks, "marks").select(F.col(column).alias(f"_{mark}_value"), F.lit(True).alias(mark))
    marks = dealt(marks) if marks.count() > FEW_MARKS else marks
    return df.join(marks, F.col(column) == F.col(f"_{mark}_value"), "left").drop(f"_{mark}_value")


def _forms(df: DataFrame, column: str) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """How the values of a key are made shorter to be dealt, and how that is undone."""
    as_it_is = lambda c: c
    return (packed_id, unpacked_id) if df.schema[column].dataType == T.StringType() else (as_it_is, as_it_is)


def repeated_keys(df: DataFrame, key: str) -> DataFrame:
    there, back = _forms(df, key)
    counts = df.filter(F.col(key).isNotNull()).groupBy(there(F.col(key)).alias("_key")).agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") > 1).select(back(F.col("_key")).alias(key))


def missing_parents(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct references that no parent row answers."""
    there, back = _forms(child, column)
    wanted = child.filter(F.col(column).isNotNull()).select(there(F.col(column)).alias("_wanted")).distinct()
    parents = parent.select(there(F.col(parent_column)).alias("_parent")).distinct()
    return wanted.join(dealt(parents), F.col("_wanted") == F.col("_parent"), "left_anti").select(back(F.col("_wanted")).alias(column))


def rules_of(table: str) -> list[Rule]:
    """All rules of a table, over its columns and the marks that `judge` adds."""
    if table == "staging":
        return [Rule(f"{c} score", has_value(c) & try_parse_score(F.col(c)).isNull()) for c in SCORE_FIELDS]
    rules = [Rule(f"{schemas.PRIMARY_KEYS[table]} unique", F.col("_repeated"))]
    rules += [Rule(f"{column} in {parent}", F.col(f"_orphan_{column}")) for child, column, parent, _ in schemas.FOREIGN_KEYS if child == table]
    rules += [Rule(f"{column} required", F.col(column).isNull()) for column in schemas.REQUIRED[table]]
    rules += [Rule(f"{column} width", F.length(column) > width) for column, width in schemas.TEXT_WIDTHS[table].items()]
    if table == "participants":
        rules.append(Rule("out_id form", ~is_uuid(F.col("out_id"))))
    return rules


def judge(df: DataFrame, table: str, accepted: dict[str, DataFrame], path: str) -> Judged:
    """Write one table below `path`, split by whether its rows break a rule; `accepted`: the parents judged before."""
    columns = df.columns
    if table in schemas.PRIMARY_KEYS:
        key = schemas.PRIMARY_KEYS[table]
        marked = _marked(df, repeated_keys(df, key), key, "_repeated")
        for child, column, parent, parent_column in schemas.FOREIGN_KEYS:
            if child == table:
                marked = _marked(marked, missing_parents(df, column, accepted[parent], parent_column), column, f"_orphan_{column}")
    else:
        marked = df
    rules = rules_of(table)
    broken = F.array_compact(F.array(*[F.when(rule.broken, F.lit(rule.name)) for rule in rules]))
    tagged = marked.select(*columns, broken.alias(BROKEN)).withColumn("accepted", F.size(BROKEN) == 0)
    seen = Observation(f"{table}-{uuid.uuid4().hex}")
    counts = [F.count_if(F.array_contains(BROKEN, rule.name)).alias(f"r{k}") for k, rule in enumerate(rules)]
    observed = tagged.observe(seen, F.count("*").alias("rows"), F.count_if(~F.col("accepted")).alias("quarantined"), *counts)
    observed.write.partitionBy("accepted").parquet(path, compression=COMPRESSION)
    got = seen.get
    stored = df.sparkSession.read.schema(tagged.schema).parquet(path)
    return Judged(
        stored.filter(F.col("accepted")).select(*columns),
        stored.filter(~F.col("accepted")).select(*columns, BROKEN),
        got["rows"],
        got["quarantined"],
        {rule.name: got[f"r{k}"] for k, rule in enumerate(rules)},
    )


def judge_all(tables: dict[str, DataFrame], folder: str) -> dict[str, Judged]:
    """All tables of a load, parents first."""
    judged: dict[str, Judged] = {}
    for name in ORDER:
        accepted = {known: j.accepted for known, j in judged.items()}
        judged[name] = judge(tables[name], name, accepted, f"{folder}/{name}-{uuid.uuid4().hex}")
    return judged


def report(spark: SparkSession, judged: dict[str, Judged]) -> DataFrame:
    """A row for each rule, and one for each table's quarantined rows."""
    rows = [(name, rule, j.rows, n) for name, j in judged.items() for rule, n in [*j.violations.items(), ("any rule", j.quarantined)]]
    return spark.createDataFrame(rows, "table_name string, rule string, rows_checked long, violations long")


def set_aside(judged: dict[str, Judged]) -> DataFrame:
    """How often each combination of rules was broken together, from the quarantined rows."""
    parts = [
        j.set_aside.groupBy(F.lit(name).alias("table_name"), F.array_join(F.array_sort(BROKEN), "; ").alias("rules")).agg(F.count("*").alias("row_count"))
        for name, j in judged.items()
    ]
    return reduce(DataFrame.unionByName, parts)
