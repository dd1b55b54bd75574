"""Order tables in the shape of raw exam records.

One order stands for one participant and one customer for one institution; every
line of an order is an exam: lines 1 to 3 in the mandatory subjects, the others in
electives. An order that has a subject more than once gets as many records, each
with its own values and a later date. Integer arithmetic throughout, so any
engine derives the same records from the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.operators.scan import numbered
from scoreloom.operators.skew import heavy_values
from scoreloom.schemas import ELECTIVE, STAGING_FIELDS, SUBJECTS
from scoreloom.sources.scratch import written
from scoreloom.sources.tables import load

INPUTS = ("orders", "customer", "nation", "lineitem")

# --- fixed values of the adapter --------------------------------------------
LINES = {1: "Ukr", 2: "Hist", 3: "Math"}
ABSENT = "Не з'явився"
RESULT = "Отримав результат"
FIRST_SESSION = "2025-05-17"
SESSION_DAYS = 60
DAYS_TO_NEXT_RECORD = 7
NATIONS_WITHOUT_CENTRE = (2, 3)


def _text(col: Column) -> Column:
    return col.cast("string")


_EXAM_ORDER = ("l_linenumber", "cents", "quantity", "l_partkey")


def _exams(lineitem: DataFrame) -> DataFrame:
    """Every line as an exam: its order, subject and figures."""
    subject = F.element_at(F.array(*[F.lit(code) for code in ELECTIVE]), (F.col("l_partkey") % len(ELECTIVE) + 1).cast("int"))
    for number, code in LINES.items():
        subject = F.when(F.col("l_linenumber") == number, code).otherwise(subject)
    return lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        subject.alias("subject"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("quantity"),
    )


def _texts() -> Column:
    cents, quantity = F.col("cents"), F.col("quantity")
    points = F.lit(10000) + cents % 10001
    comma = F.concat(_text(F.floor(points / 100)), F.lit(","), F.lpad(_text(points % 100), 2, "0"))
    absent = quantity >= 48
    return F.struct(
        F.when(absent, ABSENT).when(quantity.isNotNull(), RESULT).otherwise(fv.MISSING).alias("status"),
        F.when(absent | cents.isNull(), fv.MISSING).when(quantity <= 5, "0,0").otherwise(comma).alias("ball100"),
        F.when(absent | quantity.isNull(), fv.MISSING).otherwise(_text(quantity)).alias("ball"),
    )


def _records(numbered_exams: DataFrame) -> DataFrame:
    """One row per order and record with the texts of each subject; NULL for a subject that it does not have."""
    exams = numbered_exams.select("l_orderkey", "record", "subject", _texts().alias("texts"))
    texts = [F.max(F.when(F.col("subject") == s.code, F.col("texts"))).alias(s.code) for s in SUBJECTS]
    return exams.groupBy("l_orderkey", "record").agg(*texts)


def _records_with_orders(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The records of every order beside it, and orders without lines.

    Lines are dealt by order once: they are numbered, folded to records and joined where they then lie. An order with more
    lines than a task's share goes another way: its lines are numbered along a long order in range blocks, its records meet
    the few such orders by broadcast.
    """
    exams = _exams(lineitem)
    heavy = heavy_values(exams, "l_orderkey")
    light, few = exams, orders.limit(0)
    if heavy:
        light = exams.filter(F.col("l_orderkey").isNull() | ~F.col("l_orderkey").isin(heavy))
        few, orders = orders.filter(F.col("o_orderkey").isin(heavy)), orders.filter(F.col("o_orderkey").isNull() | ~F.col("o_orderkey").isin(heavy))
    again = W.partitionBy("l_orderkey", "subject").orderBy(*_EXAM_ORDER)
    dealt = light.repartition("l_orderkey").withColumn("record", F.row_number().over(again).cast("long"))
    joined = orders.join(_records(dealt), F.col("o_orderkey") == F.col("l_orderkey"), "full")
    if not heavy:
        return joined
    hot = written(exams.filter(F.col("l_orderkey").isin(heavy)), "hot-lines")
    group = ["l_orderkey", "subject"]
    placed = written(numbered(hot, [F.col(c) for c in (*group, *_EXAM_ORDER)], "_place"), "hot-numbered")
    # a row for each subject of the few orders
    first = placed.groupBy(F.col("l_orderkey").alias("_order"), F.col("subject").alias("_subject")).agg(F.min("_place").alias("_first"))
    same = (F.col("l_orderkey") == F.col("_order")) & F.col("subject").eqNullSafe(F.col("_subject"))
    placed = placed.join(F.broadcast(first), same).withColumn("record", F.col("_place") - F.col("_first") + 1)
    return joined.unionByName(_records(placed).join(F.broadcast(few), F.col("o_orderkey") == F.col("l_orderkey"), "left").select(*joined.columns))


def _block(subject) -> list[Column]:
    """The columns of one subject block."""
    used = F.col(subject.code).isNotNull()
    texts = {"block": F.lit(subject.code), "lang": F.lit("українська")}
    texts |= {part: F.col(f"{subject.code}.{part}") for part in ("status", "ball100", "ball")}
    return [
        F.when(used, texts[field.removeprefix(f"{subject.prefix}_")]).otherwise(F.lit(fv.MISSING)).alias(field)
        for field in subject.fields
    ]


def staging(spark: SparkSession, directory: str) -> DataFrame:
    """The staging table derived from orders, customer, nation and lineitem."""
    orders = load(spark, directory, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customer = load(spark, directory, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = load(spark, directory, "nation").select("n_nationkey", "n_name")
    known = customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left")
    # customers meet the narrow orders, so that the wide records are not dealt and sorted again
    placed = orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = (
        _records_with_orders(load(spark, directory, "lineitem"), placed)
        .withColumn("k", F.coalesce("o_orderkey", "l_orderkey"))
        .withColumn("later", (F.coalesce("record", F.lit(1)) - 1) * DAYS_TO_NEXT_RECORD)
    )

    k, c, country = F.col("k"), F.col("o_custkey"), F.col("n_nationkey")
    status, name, missing = F.col("o_orderstatus"), F.col("n_name"), F.lit(fv.MISSING)
    digest = F.md5(_text(k))
    uuid_form = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    with_centre = ~country.isin(*NATIONS_WITHOUT_CENTRE)
    district = F.concat(F.lit("District "), _text(c % 4))
    columns = {
        "outid": uuid_form,
        "birth": F.when(k % 50 == 0, missing).otherwise(_text(F.lit(2008) - k % 5)),
        "sex_type_name": F.when(k % 2 == 0, fv.WOMEN).otherwise(fv.MEN),
        "reg_name": name,
        "area_name": district,
        "ter_name": missing,
        "reg_type_name": F.when(status == "F", fv.STATUS_CURRENT_YEAR)
        .when(status == "O", fv.STATUS_PREVIOUS_YEARS)
        .when(status == "P", fv.STATUS_PENITENTIARY)
        .otherwise(missing),
        "ter_type_name": F.when(k % 97 == 0, missing)
        .when(c % 10 == 0, fv.TERRITORY_ABROAD)
        .when(c % 10 <= 6, fv.TERRITORY_CITY)
        .otherwise(fv.TERRITORY_VILLAGE),
        "eo_name": F.when((status == "O") & (k % 4 == 0), missing).otherwise(F.concat(F.lit("School #"), _text(c))),
        "eo_type_name": F.col("c_mktsegment"),
        "eo_reg_name": F.when(country == 0, fv.CAPITAL_AS_REGION).when(country == 1, fv.CAPITAL_HOME_REGION).otherwise(name),
        "eo_area_name": F.when(c % 12 == 0, missing).when((c % 5 < 2) & with_centre, "м. Львів").otherwise(district),
        "eo_ter_name": F.when((c % 7 == 0) & with_centre, "м. Луцьк").otherwise(F.concat(F.lit("с. Town "), _text(c % 9))),
        "eo_parent": F.when(k % 3 == 0, missing).otherwise(F.concat(F.lit("Dept "), _text(c % 25))),
        "eo_edrpou": F.when(c % 6 == 0, missing).otherwise(F.concat(F.lit("R"), _text(c))),
        "eo_edeboid": F.when(c % 3 == 0, missing).otherwise(_text(c)),
        "test": F.lit("session"),
        "test_date": F.date_format(F.date_add(F.lit(FIRST_SESSION).cast("date"), ((k + F.col("later")) % SESSION_DAYS).cast("int")), "dd.MM.yyyy"),
        "pt_reg_name": name,
        "pt_area_name": missing,
        "pt_ter_name": missing,
    }
    columns.update({column_name: column for subject in SUBJECTS for column_name, column in zip(subject.fields, _block(subject), strict=True)})
    return rows.select(*[F.coalesce(columns[field], missing).alias(field) for field in STAGING_FIELDS])
