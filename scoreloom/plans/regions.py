"""Module 2: regional centre against periphery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.functions import rules
from scoreloom.functions.conditional import count_where, sum_where
from scoreloom.functions.numeric import half_up, pct, percentile_cont, pg_round
from scoreloom.operators.value_counts import value_counts


def regions(profiles: DataFrame) -> DataFrame:
    """Per region: size, medians, high achievers and failures of centre and periphery."""
    counted = value_counts(
        profiles.filter(F.col("reg_name").isNotNull()),
        [rules.merged_region(F.col("reg_name")).alias("region"), "is_regional_center"],
        F.col("overall_mean"),
        {"n_failed": count_where(F.col("failed"))},
    )
    center = F.col("is_regional_center")
    value, n, n_failed = F.col("value"), F.col("n"), F.col("n_failed")
    is_high = rules.high(value)
    sums = counted.groupBy("region").agg(
        F.sum("n").alias("total"),
        sum_where(n, center).alias("center"),
        sum_where(n, ~center).alias("periphery"),
        pg_round(percentile_cont(value, 0.5, n, where=center), 2).alias("center_median"),
        pg_round(percentile_cont(value, 0.5, n, where=~center), 2).alias("periphery_median"),
        sum_where(n, is_high).alias("high"),
        sum_where(n, is_high & center).alias("center_high"),
        sum_where(n, is_high & ~center).alias("periphery_high"),
        sum_where(n_failed, center).alias("center_failed"),
        sum_where(n_failed, ~center).alias("periphery_failed"),
    )
    c = F.col
    fail_ratio = rules.ratio_of_shares(c("periphery_failed"), c("periphery"), c("center_failed"), c("center"))
    indicators = sums.select(
        c("region").alias("reg_name"),
        c("total").alias("total_participants"),
        c("center").alias("center_participants"),
        c("periphery").alias("periphery_participants"),
        pct(c("center"), c("total"), 1).alias("center_participants_percentage"),
        c("center_median").alias("median_center_score"),
        c("periphery_median").alias("median_periphery_score"),
        (c("center_median") - c("periphery_median")).alias("delta_median"),
        pct(c("center_high"), c("center"), 2).alias("center_high_achievers_percentage"),
        pct(c("periphery_high"), c("periphery"), 2).alias("periphery_high_achievers_percentage"),
        half_up(rules.location_quotient(c("center_high"), c("center"), c("high"), c("total")), 2).alias(
            "monopoly_lq_index"
        ),
        pct(c("center_failed"), c("center"), 2).alias("center_failed_percentage"),
        pct(c("periphery_failed"), c("periphery"), 2).alias("periphery_failed_percentage"),
        half_up(fail_ratio, 2).alias("fail_rate_ratio"),
    )
    return indicators.withColumn("region_classification", rules.region_class(c("monopoly_lq_index"))).orderBy(
        c("monopoly_lq_index").desc_nulls_last(), "reg_name"
    )
