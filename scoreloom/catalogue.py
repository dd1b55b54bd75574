"""Every registered query: name -> function of (spark, directory of the input tables)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloom.plans import (
    ambiguity,
    archetypes,
    electives,
    etl,
    marts,
    on_orders,
    publish,
    quality,
    quarantine,
    regions,
    resilience,
    second_order,
    sessions,
)
from scoreloom.plans.warehouse import Warehouse
from scoreloom.sources import adapter, deliveries, staging_csv
from scoreloom.sources.results import write_result
from scoreloom.sources.tables import load, version

Query = Callable[[SparkSession, str], DataFrame]

_warehouses: dict[tuple, Warehouse] = {}
_judgements: dict[str, dict[str, quarantine.Judged]] = {}


def warehouse(spark: SparkSession, directory: str) -> Warehouse:
    """The load of one input directory, shared by all queries of a session; other input files make another load."""
    key = (spark.sparkContext.applicationId, directory, *[version(spark, directory, name) for name in adapter.INPUTS])
    if key not in _warehouses:
        _warehouses[key] = publish.with_results(Warehouse(spark, lambda: adapter.staging(spark, directory)))
    return _warehouses[key]


def comparable(df: DataFrame) -> DataFrame:
    """Plain types for comparison across engines: decimals as double, integers as long, dates as text."""

    def plain(field: T.StructField):
        col = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            col = col.cast("double")
        elif isinstance(field.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            col = col.cast("long")
        elif isinstance(field.dataType, T.DateType):
            col = F.date_format(col, "yyyy-MM-dd")
        return col.alias(field.name)

    return df.select(*[plain(field) for field in df.schema.fields])


def _from_load(build: Callable[[Warehouse], DataFrame]) -> Query:
    return lambda spark, directory: comparable(build(warehouse(spark, directory)))


def _from_tables(build: Callable[..., DataFrame], *names: str) -> Query:
    return lambda spark, directory: comparable(build(*[load(spark, directory, n) for n in names]))


def _profiles(w: Warehouse) -> DataFrame:
    return w["student_academic_profiles"]


def _days(w: Warehouse) -> DataFrame:
    return sessions.calendar_of(w["person_days"])


def _raw_file(w: Warehouse) -> DataFrame:
    """Staging written in the raw file format and read back through the raw reader."""
    path = w.fresh_path("raw")
    staging_csv.write_staging(w["staging"], path)
    return staging_csv.read_staging(w.spark, path)


def _read_export(w: Warehouse, path: str, result: DataFrame) -> DataFrame:
    text = T.StructType([T.StructField(c, T.StringType()) for c in result.columns])
    return w.spark.read.schema(text).option("header", True).csv(path)


def _exported(w: Warehouse, result: DataFrame) -> DataFrame:
    """A finished result written for publication and read back as text."""
    path = w.fresh_path("export")
    write_result(result, path)
    return _read_export(w, path, result)


def _from_raw_file(w: Warehouse) -> DataFrame:
    """Staging as a raw file, loaded anew from it and checked, all results written; rows and empty fields of every file."""
    path = w.fresh_path("raw")
    staging_csv.write_staging(w["staging"], path)
    again = Warehouse(w.spark, lambda: staging_csv.read_staging(w.spark, path), w.path)
    parts = []
    for name, written in publish.write_results(again, w.fresh_path("results")).items():
        read = _read_export(w, written, w.spark.table(name))
        empty = sum((F.count_if(F.col(c).isNull()) for c in read.columns), F.lit(0))
        parts.append(read.agg(F.lit(name).alias("result"), F.count("*").alias("row_count"), empty.alias("empty_fields")))
    return reduce(DataFrame.unionByName, parts)


def _judged(w: Warehouse) -> dict[str, quarantine.Judged]:
    """A delivery with faults of every kind, loaded with a quarantine; once for a load."""
    if w.path not in _judgements:
        _judgements[w.path] = quarantine.judge_all(deliveries.spoiled({"staging": w["staging"], **w.star}), w.fresh_path("judged"))
    return _judgements[w.path]


QUERIES: dict[str, Query] = {
    # load
    "etl_staging": _from_load(lambda w: w["staging"]),
    "etl_subjects": _from_load(lambda w: etl.subject_usage(w["subjects"], w["exam_results"])),
    "etl_institutions": _from_load(lambda w: w["institutions"]),
    "etl_participants": _from_load(lambda w: w["participants"]),
    "etl_exam_results": _from_load(lambda w: w["exam_results"]),
    "csv_raw_file": _from_load(_raw_file),
    "csv_result_export": _from_load(lambda w: _exported(w, resilience.macro_locations(_profiles(w)))),
    "csv_regions_export": _from_load(lambda w: _exported(w, regions.regions(_profiles(w)))),
    "csv_raw_to_results": _from_load(_from_raw_file),
    # the views, through SQL
    "sql_region_subjects": _from_load(publish.region_subjects),
    "sql_result_sizes": _from_load(publish.result_sizes),
    # marts
    "mart_clean_exam_results": _from_load(lambda w: w.clean_exam_results()),
    "mart_student_profiles": _from_load(lambda w: _profiles(w).select(*marts.PROFILE_COLUMNS)),
    # modules
    "m1_daily_sessions": _from_load(_days),
    "m2_regions": _from_load(lambda w: regions.regions(_profiles(w))),
    "m3_macro": _from_load(lambda w: resilience.macro_locations(_profiles(w))),
    "m3_types": _from_load(lambda w: resilience.institution_types(_profiles(w))),
    "m3_schools": _from_load(lambda w: resilience.rural_schools(_profiles(w), w["institutions"])),
    "m3_clusters": _from_load(lambda w: resilience.school_clusters(_profiles(w))),
    "m4_electives": _from_load(lambda w: electives.elective_strategy(_profiles(w))),
    "m5_archetypes": _from_load(lambda w: archetypes.archetype_profiles(_profiles(w))),
    "m5_choices": _from_load(lambda w: archetypes.elective_choices(_profiles(w))),
    # statistics over the module results
    "s_day_volatility": _from_load(lambda w: second_order.day_volatility(w["daily_sessions"])),
    "s_weekly_fail": _from_load(lambda w: second_order.weekly_failures(w["daily_sessions"])),
    "s_day_clusters": _from_load(lambda w: second_order.day_clusters(w["daily_sessions"])),
    "s_region_summary": _from_load(lambda w: second_order.region_summary(w["regions"])),
    "s_ratios": _from_load(
        lambda w: second_order.headline_ratios(w["daily_sessions"], w["elective_strategy"], w["archetype_profiles"], w["elective_choices"])
    ),
    # quality
    "dq_unique": _from_load(lambda w: quality.unique_report(w.star)),
    "dq_foreign_key": _from_load(lambda w: quality.foreign_key_report(w.star)),
    "dq_not_null": _from_load(lambda w: quality.not_null_report(w.star)),
    "dq_domain": _from_load(lambda w: quality.domain_report(w.star, w["staging"])),
    "dq_unresolved": _from_load(lambda w: quality.resolution_summary(w["staging"], w["institutions"], w["institution_lookup"])),
    "dq_quarantine": _from_load(lambda w: quarantine.report(w.spark, _judged(w))),
    "dq_quarantined_rows": _from_load(lambda w: quarantine.set_aside(_judged(w))),
    "lookup_ambiguity": _from_tables(ambiguity.resolution_report, "orders", "customer"),
    "lookup_resolved": _from_tables(ambiguity.resolved, "orders", "customer"),
    # single operators on the order and event tables
    "first_per_key_latest_order": _from_tables(on_orders.latest_order_per_customer, "orders"),
    "percentile_by_group": _from_tables(on_orders.price_quartiles, "lineitem"),
    "percentile_filtered": _from_tables(on_orders.discounted_price_median, "lineitem"),
    "cv_iqr": _from_tables(on_orders.quantity_dispersion, "lineitem"),
    "share_of_total": _from_tables(on_orders.priority_shares, "orders"),
    "share_within_rank": _from_tables(on_orders.status_rank_within_priority, "orders"),
    "sequence_daily_events": _from_tables(on_orders.daily_events, "events"),
    "sequence_event_instants": _from_tables(on_orders.event_instants, "events"),
    "share_rank_prices": _from_tables(on_orders.price_rank_within_status, "orders"),
    "location_quotient": _from_tables(on_orders.large_order_quotient, "orders", "customer"),
    "quartile_cohorts": _from_tables(on_orders.price_cohorts, "orders"),
    "any_where_flags": _from_tables(on_orders.customer_flags, "orders"),
    "benchmark_compare": _from_tables(on_orders.customers_against_median, "orders"),
}
