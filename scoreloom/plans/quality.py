"""Integrity rules as jobs. Each check returns the rows that break its rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom import schemas
from scoreloom.functions.text import has_value, is_uuid, packed_id, try_parse_score
from scoreloom.operators.lookup import attach_lookup
from scoreloom.operators.skew import dealt
from scoreloom.plans.etl import REFERENCE, TIERS_BY_CODE, TIERS_BY_ID, resolve_institutions

RESOLVED_BY_ID = "id"
RESOLVED_BY_CODE = "code and name"
RESOLVED_BY_PLACE = "name and place"
UNRESOLVED = "unresolved"


def unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count("*").alias("occurrences")).filter(F.col("occurrences") > 1)


def foreign_key(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    keys = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent_key"), "left_anti")


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def too_long(df: DataFrame, column: str, width: int) -> DataFrame:
    return df.filter(F.length(column) > width)


def malformed_ids(df: DataFrame, column: str = "out_id") -> DataFrame:
    return df.filter(~is_uuid(F.col(column)))


def unreadable_scores(staging: DataFrame, column: str) -> DataFrame:
    """Staging rows whose score text is present but is not a score."""
    return staging.filter(has_value(column) & try_parse_score(F.col(column)).isNull())


def unresolved(staging: DataFrame, institutions: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """Staging rows that name an institution which no tier could find."""
    mapping = mapping or resolve_institutions(staging, institutions)
    named = staging.filter(has_value("eo_name"))
    return attach_lookup(named, mapping, REFERENCE, ["institution_id"]).filter(F.col("institution_id").isNull())


def resolution_summary(staging: DataFrame, institutions: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """How the named institutions were found: rows and distinct references per way."""
    named = staging.filter(has_value("eo_name")).groupBy(*REFERENCE).agg(F.count("*").alias("n"))
    mapping = mapping or resolve_institutions(staging, institutions)
    tier = F.col("tier")
    way = (
        F.when(tier < TIERS_BY_ID, RESOLVED_BY_ID)
        .when(tier < TIERS_BY_ID + TIERS_BY_CODE, RESOLVED_BY_CODE)
        .when(tier.isNotNull(), RESOLVED_BY_PLACE)
        .otherwise(UNRESOLVED)
    )
    return (
        attach_lookup(named, mapping, REFERENCE, ["tier"])
        .groupBy(way.alias("resolved_by"))
        .agg(F.sum("n").alias("participants"), F.count("*").alias("distinct_references"))
    )


def _tally(df: DataFrame, table: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows checked and violations per rule, for row-level rules of one table in one scan."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count_if(cond).alias(rule) for rule, cond in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations")) for rule in conditions])
    return counts.select(
        F.lit(table).alias("table_name"), F.col("_rows").alias("rows_checked"), F.explode(pairs).alias("r")
    ).select("table_name", "r.rule", "rows_checked", "r.violations")


def _stacked(reports: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def _short(df: DataFrame, key: str) -> Column:
    """A key in the form in which it is dealt: texts as packed identifiers, which are equal only for equal texts."""
    return packed_id(F.col(key)) if df.schema[key].dataType == T.StringType() else F.col(key)


def unique_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Per primary key: distinct keys and how many of them repeat."""
    return _stacked([
        tables[name]
        .groupBy(_short(tables[name], key).alias("_key"))
        .agg(F.count("*").alias("occurrences"))
        .agg(F.count("*").alias("keys_checked"), F.count_if(F.col("occurrences") > 1).alias("violations"))
        .select(F.lit(name).alias("table_name"), F.lit(key).alias("rule"), "keys_checked", "violations")
        for name, key in schemas.PRIMARY_KEYS.items()
    ])


def foreign_key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Child rows without a parent, per foreign key. Rows are counted per key before the join, and so lie by key when the parents come."""
    reports = []
    for child, column, parent, parent_column in schemas.FOREIGN_KEYS:
        per_key = tables[child].groupBy(_short(tables[child], column).alias("_key")).agg(F.count("*").alias("_rows"))
        parents = tables[parent].select(_short(tables[parent], parent_column).alias("_id"))
        orphans = foreign_key(per_key, "_key", dealt(parents), "_id")
        reports.append(
            orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("violations")).select(
                F.lit(child).alias("table_name"), F.lit(f"{column} in {parent}").alias("rule"), "violations"
            )
        )
    return _stacked(reports)


def not_null_report(tables: dict[str, DataFrame]) -> DataFrame:
    return _stacked([
        _tally(tables[name], name, {column: F.col(column).isNull() for column in columns})
        for name, columns in schemas.REQUIRED.items()
    ])


def domain_report(tables: dict[str, DataFrame], staging: DataFrame) -> DataFrame:
    """Text widths and identifier form of the star tables, and score texts of staging."""
    reports = []
    for name, widths in schemas.TEXT_WIDTHS.items():
        rules = {f"{column} width": F.length(column) > width for column, width in widths.items()}
        if name == "participants":
            rules["out_id form"] = ~is_uuid(F.col("out_id"))
        reports.append(_tally(tables[name], name, rules))
    scores = [f"{s.prefix}_{part}" for s in schemas.SUBJECTS for part in ("ball100", "ball")]
    reports.append(
        _tally(
            staging,
            "staging",
            {f"{column} score": has_value(column) & try_parse_score(F.col(column)).isNull() for column in scores},
        )
    )
    return _stacked(reports)
