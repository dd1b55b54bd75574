"""How sure a priority lookup is: the way each reference was found, how many rows it could have meant, and those it did not find.

Requests and branches are derived from orders and customers so that every way of finding an institution is used: four customers
share a code and a name, two of them a place as well, one has no place. What an order states about its customer's school
depends on its key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions.text import null_sentinel
from scoreloom.operators.lookup import candidates, tiered_lookup
from scoreloom.plans.etl import REFERENCE, REFERENCE_VALUES, resolution_tiers

SHARING = 4
#: Town and district that an order states, by its key modulo the number of them; SAME and OTHER as those of the first branch.
SAME, OTHER, UNKNOWN, THIRD = "A", "X", None, "B"
STATED = [(t, d) for t in (SAME, OTHER, UNKNOWN) for d in (SAME, OTHER, UNKNOWN)]
BY_ID, NO_SUCH_ID, FIRST_BY_CODE, THIRD_BY_CODE, NO_SUCH_CODE, FIRST_BY_PLACE = 0, 1, 2, 11, 12, 13
BY_PLACE = [(SAME, SAME), (SAME, UNKNOWN), (UNKNOWN, SAME), (UNKNOWN, UNKNOWN), (THIRD, THIRD), (OTHER, OTHER)]
ELSEWHERE = FIRST_BY_PLACE + len(BY_PLACE)
CASES = ELSEWHERE + 1
UNRESOLVED = -1


def branches(customer: DataFrame) -> DataFrame:
    """Institutions: groups of four with one code and name, two at the first place, one at another, one without a place."""
    c = F.col("c_custkey")
    group, which = F.floor(c / SHARING).cast("string"), c % SHARING
    place = F.when(which < 2, SAME).when(which == 2, THIRD)
    return customer.select(
        (c + 1).alias("institution_id"),
        F.concat(F.lit("E"), c.cast("string")).alias("edebo_id"),
        F.concat(F.lit("R"), group).alias("edrpou"),
        F.concat(F.lit("School "), group).alias("institution_name"),
        F.concat(F.lit("Region "), (F.floor(c / SHARING) % 5).cast("string")).alias("reg_name"),
        F.concat(F.lit("District "), place).alias("area_name"),
        F.concat(F.lit("Town "), place).alias("ter_name"),
    )


def requests(orders: DataFrame) -> DataFrame:
    """What each order states about an institution, in the raw form: text, or the text for a missing value."""
    case, group = F.col("o_orderkey") % CASES, F.floor(F.col("o_custkey") / SHARING)
    by_code = case.between(FIRST_BY_CODE, THIRD_BY_CODE)
    towns = [town for town, _ in [*STATED, (THIRD, THIRD), (SAME, SAME), *BY_PLACE, (SAME, SAME)]]
    districts = [district for _, district in [*STATED, (THIRD, THIRD), (SAME, SAME), *BY_PLACE, (SAME, SAME)]]

    def stated(values: list[str | None], label: str) -> Column:
        listed = F.array(*[F.lit(f"{label} {v}") if v else F.lit(fv.MISSING) for v in values])
        return F.when(case < FIRST_BY_CODE, f"{label} {SAME}").otherwise(F.element_at(listed, F.greatest(case - FIRST_BY_CODE, F.lit(0)).cast("int") + 1))

    return orders.select(
        F.when(case == BY_ID, F.concat(F.lit("E"), F.col("o_custkey").cast("string"))).when(case == NO_SUCH_ID, "E?").otherwise(fv.MISSING).alias("eo_edeboid"),
        F.when(by_code, F.concat(F.lit("R"), group.cast("string"))).when(case == NO_SUCH_CODE, "R?").otherwise(fv.MISSING).alias("eo_edrpou"),
        F.concat(F.lit("School "), group.cast("string")).alias("eo_name"),
        F.when(case == ELSEWHERE, "Region ?").otherwise(F.concat(F.lit("Region "), (group % 5).cast("string"))).alias("eo_reg_name"),
        stated(districts, "District").alias("eo_area_name"),
        stated(towns, "Town").alias("eo_ter_name"),
    )


def resolution_report(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """By tier, and for the unresolved: requests, different references, those with more than one candidate, all candidates, and the sum
    of the chosen ids. Candidates are counted by tier and key before references meet them, so no pairs are made."""
    asked = requests(orders).groupBy(*REFERENCE).agg(F.count("*").alias("requests"))
    valued = asked.select(*REFERENCE).withColumns({name: null_sentinel(raw) for name, raw in REFERENCE_VALUES.items()})
    dimension, tiers = branches(customer), resolution_tiers()
    found = candidates(valued, dimension, REFERENCE, tiers, "institution_id")
    renamed = found.select(*[F.col(c).alias(f"_{c}") for c in REFERENCE], "tier", "candidates", "institution_id")
    same = [F.col(c) == F.col(f"_{c}") for c in REFERENCE]
    joined = asked.join(renamed, same, "left")
    return joined.groupBy(F.coalesce("tier", F.lit(UNRESOLVED)).alias("tier")).agg(
        F.sum("requests").alias("requests"),
        F.count("*").alias("distinct_references"),
        F.count_if(F.col("candidates") > 1).alias("ambiguous_references"),
        F.coalesce(F.sum("candidates"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("institution_id"), F.lit(0)).alias("sum_of_ids"),
    )


def resolved(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """The lookup itself on the same requests: reference, institution and tier."""
    distinct = requests(orders).distinct().withColumns({name: null_sentinel(raw) for name, raw in REFERENCE_VALUES.items()})
    return tiered_lookup(distinct, branches(customer), REFERENCE, resolution_tiers(), "institution_id")
