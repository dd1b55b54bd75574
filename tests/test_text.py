"""Cleaning, typing and domain rules."""

import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.functions import rules, text


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i")


def evaluated(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_sentinel_and_presence(spark):
    df = column(spark, ["a", "null", None, ""])
    assert evaluated(df, text.null_sentinel("x")) == ["a", None, None, ""]
    assert evaluated(df.filter(text.has_value("x")), F.col("x")) == ["a", ""]


def test_cascade_key_keeps_raw_parts(spark):
    rows = [("7", "R", "n", "a"), ("null", "R", "n", "a"), (None, None, "n", "null"), ("null", "null", "n", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string")
    assert evaluated(df, text.cascade_key(["a", "b"], ["c", "d"])) == ["7", "R", "n||null", "n"]


def test_absence_in_any_spelling(spark):
    df = column(spark, ["Не з'явився", "НЕ З’ЯВИВСЯ", "Отримав результат", None])
    assert evaluated(df, text.is_present(F.col("x"))) == [False, False, True, None]


def test_scores_with_decimal_comma(spark):
    df = column(spark, [" 123,5 ", "0,0", "null", None, "100"])
    assert evaluated(df, text.parse_score(F.col("x"))) == [Decimal("123.50"), Decimal("0.00"), None, None, Decimal("100.00")]


@pytest.mark.parametrize("bad", ["1234,5", "", "abc"])
def test_unreadable_scores_raise_or_are_found(spark, bad):
    df = column(spark, [bad])
    with pytest.raises(PySparkException):
        evaluated(df, text.parse_score(F.col("x")))
    assert evaluated(df, text.try_parse_score(F.col("x"))) == [None]


def test_dates(spark):
    day = datetime.date(2025, 6, 2)
    assert evaluated(column(spark, ["02.06.2025", "2.6.2025", "null", None]), text.parse_date("x")) == [day, day, None, None]


def test_identifiers(spark):
    df = column(spark, [" 00411460-F7C9-2D21-24A6-7EA0F4CB5F85 ", "null", "x"])
    ids = text.canonical_uuid("x")
    assert evaluated(df, ids) == ["00411460-f7c9-2d21-24a6-7ea0f4cb5f85", None, "x"]
    assert evaluated(df, text.is_uuid(ids)) == [True, None, False]


def test_macro_location(spark):
    df = column(spark, [fv.TERRITORY_ABROAD, fv.TERRITORY_CITY, fv.TERRITORY_VILLAGE, "other", None])
    expected = [fv.LOCATION_ABROAD, fv.LOCATION_CITY, fv.LOCATION_VILLAGE, fv.UNDEFINED, fv.UNDEFINED]
    assert evaluated(df, rules.macro_location(F.col("x"))) == expected


@pytest.mark.parametrize(
    ("institution", "region", "district", "town", "expected"),
    [
        (1, "м.Київ", None, None, True),
        (1, "м. Київ", None, None, True),
        (1, "Львівська область", "м. Львів", None, True),
        (1, None, "Львів", None, True),
        (1, None, None, "м. Луцьк", True),
        (1, None, None, "м. Луцьк", True),
        (1, None, None, "Луцьк", False),
        (1, None, None, "М.Вінниця", False),
        (1, "Миколаївська область", None, "м. Миколаїв", True),
        (1, "Львівська область", None, "м. Миколаїв", False),
        (1, None, None, None, False),
        (None, "м.Київ", "м. Львів", None, False),
    ],
)
def test_regional_center(spark, institution, region, district, town, expected):
    df = spark.createDataFrame([(institution, region, district, town)], "i long, r string, d string, t string")
    flag = rules.is_regional_center(F.col("i"), F.col("r"), F.col("d"), F.col("t"))
    assert evaluated(df, flag) == [expected]


def test_location_text_is_empty_without_parts(spark):
    df = spark.createDataFrame([("a", None, "c"), (None, None, None)], "r string, d string, t string")
    assert evaluated(df, rules.full_location(F.col("r"), F.col("d"), F.col("t"))) == ["a, c", ""]


def test_calendar_labels(spark):
    days = [datetime.date(2025, 5, 17), datetime.date(2025, 6, 2), datetime.date(2025, 6, 6), datetime.date(2025, 7, 20), datetime.date(2025, 8, 1), None]
    df = column(spark, days, "date")
    assert evaluated(df, rules.weekday_label(F.col("x"))) == ["Субота", "Понеділок", "П'ятниця", "Неділя", "П'ятниця", None]
    phases = evaluated(df, rules.session_phase(F.col("x")))
    assert phases == [fv.SESSION_PHASES[5], fv.SESSION_PHASES[6], fv.SESSION_PHASES[6], fv.SESSION_PHASES[7], None, None]


def test_region_classes(spark):
    values = [Decimal("1.80"), Decimal("1.40"), Decimal("1.00"), Decimal("0.99"), None]
    labels = [name for _, name in fv.REGION_CLASSES] + [fv.REGION_BALANCED, fv.UNDEFINED]
    assert evaluated(column(spark, values, "decimal(10,2)"), rules.region_class(F.col("x"))) == labels


@pytest.mark.parametrize(
    ("math", "language", "history", "expected"),
    [
        ("0", "170", "170", fv.ARCHETYPE_RISK),
        ("150", "0", "170", fv.ARCHETYPE_RISK),
        ("160", "160", "160", fv.ARCHETYPE_UNIVERSAL),
        ("155", "140", "140", fv.ARCHETYPE_STEM),
        ("125", "140", "140", fv.ARCHETYPE_HUMANITIES),
        ("159.99", "160", "160", fv.ARCHETYPE_BALANCED),
        ("129.99", "129.99", "129.99", fv.ARCHETYPE_RISK),
        ("130", "129.99", "129.99", fv.ARCHETYPE_BALANCED),
        ("154.99", "140", "139.99", fv.ARCHETYPE_BALANCED),
    ],
)
def test_archetypes(spark, math, language, history, expected):
    row = tuple(Decimal(v) for v in (math, language, history))
    df = spark.createDataFrame([row], "m decimal(5,2), l decimal(5,2), h decimal(5,2)")
    assert evaluated(df, rules.archetype(F.col("m"), F.col("l"), F.col("h"))) == [expected]


def test_school_rank_is_strict(spark):
    rows = [(True, 120.0), (True, 130.0), (False, 120.0), (True, 140.0), (False, 140.1)]
    df = spark.createDataFrame([(h, m, 130.0, 140.0) for h, m in rows], "h boolean, m double, r double, u double")
    rank = rules.school_rank(F.col("h"), F.col("m"), F.col("r"), F.col("u"))
    assert evaluated(df, rank) == [
        fv.SCHOOL_POLARISED, fv.SCHOOL_TYPICAL, fv.SCHOOL_TYPICAL, fv.SCHOOL_TYPICAL, fv.SCHOOL_FLAGSHIP,
    ]


def test_ratio_of_shares_is_rounded_once(spark):
    rows = [(2512499999, 10**10, 1, 4), (1, 2, 1, 4), (1, 0, 1, 4), (1, 2, 0, 4), (0, 2, 1, 4), (1, 2, 1, 0)]
    df = spark.createDataFrame(rows, "a long, b long, c long, d long")
    ratio = F.round(rules.ratio_of_shares(*[F.col(c) for c in "abcd"]), 2)
    assert evaluated(df, ratio) == [Decimal("1.00"), Decimal("2.00"), None, None, Decimal("0.00"), Decimal("0.00")]
