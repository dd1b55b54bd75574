"""The operators applied directly to the order and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom.functions.conditional import any_where, count_where, sum_where
from scoreloom.functions.numeric import (
    cv,
    half_up,
    iqr,
    pct,
    percentile_cont,
    pg_round,
    score_mean,
    settled,
    weighted_mean,
)
from scoreloom.functions.rules import location_quotient
from scoreloom.operators import benchmarks, scan, sequence, share
from scoreloom.operators.dedup import first_per_key
from scoreloom.operators.quantiles import group_quantiles, large_quantiles
from scoreloom.operators.value_counts import value_counts
from scoreloom.sources.scratch import written

LARGE_ORDER = 400000
FOCUS_SEGMENT = "BUILDING"


def latest_order_per_customer(orders: DataFrame) -> DataFrame:
    latest = first_per_key(
        orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"),
        ["o_custkey"],
        [F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").asc()],
    )
    return latest.withColumn("o_orderdate", F.col("o_orderdate").cast("date"))


def price_quartiles(lineitem: DataFrame) -> DataFrame:
    quartiles = large_quantiles(lineitem, ["l_returnflag"], F.col("l_extendedprice"), [0.25, 0.5, 0.75])
    counts = lineitem.groupBy("l_returnflag").agg(F.count("*").alias("line_count"))
    same = counts["l_returnflag"].eqNullSafe(quartiles["l_returnflag"])
    return counts.join(quartiles, same, "left").select(
        counts["l_returnflag"],
        "line_count",
        *[pg_round(F.col("q")[i], 2).alias(name) for i, name in enumerate(("q1", "median", "q3"))],
    )


def discounted_price_median(lineitem: DataFrame) -> DataFrame:
    price, key = F.col("l_extendedprice"), ["l_linestatus"]
    medians = large_quantiles(lineitem, key, price, [0.5], where={"every": F.lit(True), "discounted": F.col("l_discount") >= 0.05})
    return medians.select(
        "l_linestatus",
        pg_round(F.col("every")[0], 2).alias("median_price"),
        pg_round(F.col("discounted")[0], 2).alias("median_discounted_price"),
    )


def quantity_dispersion(lineitem: DataFrame) -> DataFrame:
    counted = value_counts(lineitem, ["l_returnflag", "l_linestatus"], F.col("l_quantity").cast("decimal(5,2)"))
    value, n = F.col("value"), F.col("n")
    return (
        counted.groupBy("l_returnflag", "l_linestatus")
        .agg(
            half_up(weighted_mean(value, n), 2).alias("mean_quantity"),
            cv(value, n, 4).alias("coefficient_of_variation"),
            percentile_cont(value, [0.25, 0.75], n).alias("q"),
        )
        .select("l_returnflag", "l_linestatus", "mean_quantity", "coefficient_of_variation", iqr(F.col("q"), 2).alias("iqr"))
    )


def priority_shares(orders: DataFrame) -> DataFrame:
    counts = orders.groupBy("o_orderpriority").agg(
        F.count("*").alias("order_count"), count_where(F.col("o_orderstatus") == "F").alias("finished_count")
    )
    return counts.select(
        "o_orderpriority",
        "order_count",
        share.of_total(F.col("order_count"), 2).alias("order_share"),
        share.of_total(F.col("finished_count"), 2).alias("finished_share"),
    )


def status_rank_within_priority(orders: DataFrame) -> DataFrame:
    n = F.col("order_count")
    counts = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("order_count"))
    return counts.select(
        "o_orderpriority",
        "o_orderstatus",
        "order_count",
        share.within(n, ["o_orderpriority"], 2).alias("share_within"),
        share.rank_within(n, ["o_orderpriority"]).alias("rank_within"),
    )


def daily_events(events: DataFrame) -> DataFrame:
    calendar = W.orderBy("event_date")
    days = events.groupBy(F.col("ts").cast("date").alias("event_date")).agg(
        F.count("*").alias("event_count"), half_up(score_mean(F.col("value")), 2).alias("mean_value")
    )
    return days.select(
        "event_date",
        sequence.number(calendar).alias("day_number"),
        "event_count",
        "mean_value",
        sequence.delta("mean_value", calendar, 2).alias("delta_value"),
        sequence.smooth("mean_value", calendar, 2).alias("smoothed_value"),
        sequence.cumulative_share("event_count", calendar, 1).alias("cumulative_share"),
    )


def event_instants(events: DataFrame) -> DataFrame:
    """The measures of daily_events along every single instant: as many rows as there are, in range blocks."""
    instants = events.groupBy("ts").agg(F.count("*").alias("event_count"), half_up(score_mean(F.col("value")), 2).alias("mean_value"))
    placed = scan.numbered(written(instants, "instants"), [F.col("ts").asc_nulls_first()], "instant_number", {"_running": "event_count"})
    total = events.agg(F.count("*").alias("_total"))
    near = scan.with_neighbours(placed, "instant_number", before=1, after=1)
    order = W.partitionBy("_chunk").orderBy("instant_number")
    measured = near.withColumns({
        "delta_value": sequence.delta("mean_value", order, 2),
        "smoothed_value": sequence.smooth("mean_value", order, 2),
    }).filter("_own")
    return benchmarks.attach(measured, total).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("instant"),
        "instant_number",
        "event_count",
        "mean_value",
        "delta_value",
        "smoothed_value",
        pct(F.col("_running"), F.col("_total"), 4).alias("cumulative_share"),
    )


def price_rank_within_status(orders: DataFrame) -> DataFrame:
    """Every price of a status with its orders, its rank among the status's prices and its share of the status's orders."""
    ranked = scan.ranked_values(orders, ["o_orderstatus"], "o_totalprice", "rank_within")
    share_within = pct(F.col("n"), F.col("group_rows"), 4).alias("share_within")
    return ranked.select("o_orderstatus", "o_totalprice", F.col("n").alias("order_count"), "rank_within", share_within)


def large_order_quotient(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Concentration of large orders in one customer segment, per nation.

    Orders are counted per customer before the join.
    """
    per_customer = orders.groupBy("o_custkey").agg(
        F.count("*").alias("n"), count_where(F.col("o_totalprice") >= LARGE_ORDER).alias("large")
    )
    joined = per_customer.join(
        customer.select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")
    )
    focus = F.col("c_mktsegment") == FOCUS_SEGMENT
    sums = joined.groupBy("c_nationkey").agg(
        F.sum("n").alias("total_orders"),
        sum_where(F.col("n"), focus).alias("segment_orders"),
        F.sum("large").alias("total_large"),
        sum_where(F.col("large"), focus).alias("segment_large"),
    )
    quotient = location_quotient(
        F.col("segment_large"), F.col("segment_orders"), F.col("total_large"), F.col("total_orders")
    )
    return sums.withColumn("quotient", half_up(quotient, 4))


def price_cohorts(orders: DataFrame) -> DataFrame:
    """Orders per priority that fall below, inside and above the middle half of all prices."""
    bounds = large_quantiles(orders, [], F.col("o_totalprice"), [0.25, 0.75]).select(
        settled(F.col("q")[0]).alias("q1"), settled(F.col("q")[1]).alias("q3")
    )
    price = settled(F.col("o_totalprice"))
    return (
        benchmarks.attach(orders.select("o_orderpriority", "o_totalprice"), bounds)
        .groupBy("o_orderpriority")
        .agg(
            count_where(price < F.col("q1")).alias("below"),
            count_where(price.between(F.col("q1"), F.col("q3"))).alias("inside"),
            count_where(price > F.col("q3")).alias("above"),
        )
    )


def customer_flags(orders: DataFrame) -> DataFrame:
    return orders.groupBy("o_custkey").agg(
        any_where(F.col("o_orderstatus") == "P").alias("has_pending"),
        any_where(F.col("o_totalprice") >= LARGE_ORDER).alias("has_large"),
    )


def customers_against_median(orders: DataFrame) -> DataFrame:
    """Customers by whether their median order price lies above, at or below the overall median."""
    counted = value_counts(orders.filter(F.col("o_totalprice").isNotNull()), ["o_custkey"], F.col("o_totalprice"))
    medians = group_quantiles(counted, ["o_custkey"], [0.5]).select("o_custkey", F.col("q")[0].alias("own_median"))
    sizes = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"))
    same = sizes["o_custkey"].eqNullSafe(medians["o_custkey"])
    own = sizes.join(medians, same, "left").select(sizes["o_custkey"], "orders", "own_median")
    overall = large_quantiles(orders, [], F.col("o_totalprice"), [0.5]).select(F.col("q")[0].alias("overall_median"))
    compared = benchmarks.attach(own, overall)
    own_median, overall_median = settled(F.col("own_median")), settled(F.col("overall_median"))
    position = F.when(own_median > overall_median, "above").when(own_median < overall_median, "below").otherwise("at")
    groups = compared.groupBy(position.alias("position")).agg(
        F.count("*").alias("customers"), F.sum("orders").alias("order_count")
    )
    return groups.withColumn("customer_share", pct(F.col("customers"), F.sum("customers").over(W.partitionBy()), 2))
