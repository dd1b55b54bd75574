"""Domain rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions.numeric import exact_ratio, settled
from scoreloom.functions.text import strip_town_prefix


def _labelled(col: Column, labels: dict, default: str | None = None) -> Column:
    """Exact-match labelling of a column; the default also covers NULL."""
    result = F.lit(default) if default is not None else F.lit(None).cast("string")
    for value in reversed(list(labels)):
        result = F.when(col == value, labels[value]).otherwise(result)
    return result


def macro_location(territory: Column) -> Column:
    return _labelled(
        territory,
        {
            fv.TERRITORY_ABROAD: fv.LOCATION_ABROAD,
            fv.TERRITORY_CITY: fv.LOCATION_CITY,
            fv.TERRITORY_VILLAGE: fv.LOCATION_VILLAGE,
        },
        fv.UNDEFINED,
    )


def is_regional_center(institution_id: Column, region: Column, district: Column, town: Column) -> Column:
    """Whether an institution lies in its region's main city; never NULL."""
    capital = region.isin(*fv.CAPITAL_REGION_SPELLINGS)
    centre_district = strip_town_prefix(district).isin(*fv.CENTRE_DISTRICTS)
    town_name = strip_town_prefix(town)
    named_town = town_name.isin(*fv.CENTRE_TOWNS) | (
        (town_name == fv.AMBIGUOUS_TOWN) & (region == fv.AMBIGUOUS_TOWN_REGION)
    )
    centre_town = town.rlike(fv.TOWN_PREFIX_ANY_CASE) & named_town
    return institution_id.isNotNull() & F.coalesce(capital | centre_district | centre_town, F.lit(False))


def merged_region(region: Column) -> Column:
    """The capital counted with the region around it."""
    return F.when(region == fv.CAPITAL_AS_REGION, fv.CAPITAL_HOME_REGION).otherwise(region)


def full_location(*parts: Column) -> Column:
    return F.concat_ws(fv.LOCATION_SEPARATOR, *parts)


def session_phase(date: Column) -> Column:
    return _labelled(F.month(date), fv.SESSION_PHASES)


def weekday_label(date: Column) -> Column:
    return _labelled(F.weekday(date) + 1, fv.WEEKDAYS)


def failed(score: Column) -> Column:
    return score == F.lit(fv.FAILED_SCORE)


def high(score: Column) -> Column:
    return score >= F.lit(fv.HIGH_SCORE)


def ratio_of_shares(hits: Column, size: Column, base_hits: Column, base_size: Column) -> Column:
    """(hits / size) / (base_hits / base_size) as one fraction, to be rounded once, to as many as eight places.

    NULL where either size or the base hits are zero.
    """
    hits, size, base_hits, base_size = [c.cast("decimal(16,0)") for c in (hits, size, base_hits, base_size)]
    return exact_ratio(hits * base_size, base_hits * size)


def location_quotient(part_hits: Column, part_size: Column, all_hits: Column, all_size: Column) -> Column:
    """How over-represented the hits are in the part, against everyone."""
    return ratio_of_shares(part_hits, part_size, all_hits, all_size)


def region_class(quotient: Column) -> Column:
    label = F.when(quotient.isNotNull(), fv.REGION_BALANCED).otherwise(fv.UNDEFINED)
    for floor, name in reversed(fv.REGION_CLASSES):
        label = F.when(quotient >= F.lit(floor), name).otherwise(label)
    return label


def school_rank(has_high: Column, median: Column, rural_median: Column, urban_median: Column) -> Column:
    """Medians are compared unrounded, but free of binary noise."""
    own, rural, urban = settled(median), settled(rural_median), settled(urban_median)
    return (
        F.when(has_high & (own < rural), fv.SCHOOL_POLARISED)
        .when(own > urban, fv.SCHOOL_FLAGSHIP)
        .otherwise(fv.SCHOOL_TYPICAL)
    )


def humanities_score(language: Column, history: Column) -> Column:
    """Mean of the two humanities scores, exact to half a hundredth."""
    return ((language + history) / 2).cast("decimal(8,3)")


def archetype(math: Column, language: Column, history: Column) -> Column:
    humanities = humanities_score(language, history)
    lead = math - humanities
    any_fail = failed(math) | failed(language) | failed(history)
    both_low = (math < F.lit(fv.RISK_BELOW)) & (humanities < F.lit(fv.RISK_BELOW))
    both_high = (math >= F.lit(fv.UNIVERSAL_FROM)) & (humanities >= F.lit(fv.UNIVERSAL_FROM))
    technical = (lead >= F.lit(fv.ASYMMETRY)) & (math >= F.lit(fv.PROFILE_FROM))
    humanist = (lead <= F.lit(-fv.ASYMMETRY)) & (humanities >= F.lit(fv.PROFILE_FROM))
    return (
        F.when(any_fail | both_low, fv.ARCHETYPE_RISK)
        .when(both_high, fv.ARCHETYPE_UNIVERSAL)
        .when(technical, fv.ARCHETYPE_STEM)
        .when(humanist, fv.ARCHETYPE_HUMANITIES)
        .otherwise(fv.ARCHETYPE_BALANCED)
    )
