"""Staging to star schema, the raw file, quality checks."""

import datetime
import itertools
import random
from decimal import Decimal
from types import SimpleNamespace

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from oracle import statements
from scoreloom import schemas
from scoreloom.plans import etl, quality
from scoreloom.plans.warehouse import TABLES, QualityError, Warehouse, shared_folder
from scoreloom.sources import adapter
from scoreloom.sources.results import write_result
from scoreloom.sources.staging_csv import read_staging, write_staging

ID = "00000000-0000-0000-0000-00000000000{}"
SCHOOL = {"eo_name": "S", "eo_reg_name": "R", "eo_area_name": "A", "eo_ter_name": "T"}


def test_staging_has_the_declared_columns():
    assert len(schemas.STAGING_FIELDS) == 75
    assert len([s for s in schemas.SUBJECTS if s.language is None]) == 6
    assert schemas.MANDATORY == ["Ukr", "Hist", "Math"]


def test_subject_dimension(spark):
    got = {r.subject_code: r.is_mandatory for r in schemas.subjects_df(spark).collect()}
    assert len(got) == 12 and sum(got.values()) == 3


# --- institutions ------------------------------------------------------------


def test_the_best_informed_record_survives(staging_of):
    same = {**SCHOOL, "eo_edeboid": "7"}
    got = etl.institutions(
        staging_of(
            {**same, "eo_edrpou": "code"},
            {**same, "eo_parent": "gov"},
            {**same, "eo_parent": "gov", "eo_edrpou": "code"},
        )
    ).collect()
    assert [(r.parent_governance, r.edrpou, r.institution_id) for r in got] == [("gov", "code", 1)]


def test_key_falls_back_to_raw_place_texts(staging_of):
    got = etl.institutions(
        staging_of({**SCHOOL, "eo_area_name": None}, SCHOOL | {"eo_area_name": "null"}, {"eo_name": "null"}, {"eo_name": None})
    )
    assert got.count() == 2, "a NULL and a missing-value text make two keys"


# --- lookup ------------------------------------------------------------------


def resolve(staging_of, institutions, **reference):
    """Institution found for one reference; unresolved is None."""
    records = [dict(i, outid=ID.format(9)) for i in institutions]
    dimension = etl.institutions(staging_of(*records))
    got = etl.participants(staging_of({"outid": ID.format(1), **reference}), dimension)
    names = dimension.select("institution_id", "parent_governance")
    return got.join(names, "institution_id", "left").first().parent_governance


def test_unknown_id_does_not_fall_through_to_the_name(staging_of):
    known = [{**SCHOOL, "eo_edeboid": "7", "eo_parent": "x"}]
    assert resolve(staging_of, known, **SCHOOL, eo_edeboid="8") is None
    assert resolve(staging_of, known, **SCHOOL, eo_edeboid="7") == "x"


def test_code_needs_the_same_name(staging_of):
    known = [{**SCHOOL, "eo_edrpou": "c", "eo_parent": "x"}]
    assert resolve(staging_of, known, eo_name="other", eo_edrpou="c") is None
    assert resolve(staging_of, known, eo_name="S", eo_edrpou="c") == "x"


def test_missing_district_is_a_wildcard_but_null_matches_nothing(staging_of):
    known = [{**SCHOOL, "eo_parent": "x"}]
    assert resolve(staging_of, known, **(SCHOOL | {"eo_area_name": "null"})) == "x"
    assert resolve(staging_of, known, **(SCHOOL | {"eo_area_name": None})) is None
    assert resolve(staging_of, known, **(SCHOOL | {"eo_ter_name": "elsewhere"})) is None


def test_same_town_wins_then_same_district(staging_of):
    known = [
        {**SCHOOL, "eo_edeboid": e, "eo_edrpou": "c", "eo_ter_name": t, "eo_area_name": a, "eo_parent": t + a}
        for e, t, a in (("1", "T2", "A"), ("2", "T", "A2"), ("3", "T", "A"), ("4", "null", "A"))
    ]
    ask = {"eo_name": "S", "eo_edrpou": "c"}
    assert resolve(staging_of, known, **ask, eo_ter_name="T", eo_area_name="A") == "TA"
    assert resolve(staging_of, known, **ask, eo_ter_name="T", eo_area_name="A2") == "TA2"
    assert resolve(staging_of, known, **ask, eo_ter_name="T9", eo_area_name="A2") == "TA2", "different beats unknown"


def test_lookup_against_brute_force(spark, staging_of):
    """Random colliding institutions and references, compared with the OR-ed ranked join."""
    rng = random.Random(20)
    options = {
        "eo_edeboid": ["1", "2", "3", "99", "null", "null", None],
        "eo_edrpou": ["a", "b", "z", "null", "null", None],
        "eo_name": ["S", "P", "null", None],
        "eo_reg_name": ["R", "Q", "null", None],
        "eo_area_name": ["A", "B", "C", "null", None],
        "eo_ter_name": ["T", "U", "V", "null", None],
    }
    dimension_rows = [
        (i, rng.choice([None, None, None, str(i)]), rng.choice(["a", "b", None]), rng.choice("SP"), rng.choice(["R", "Q", None]),
         rng.choice(["A", "B", None]), rng.choice(["T", "U", None]))
        for i in range(1, 41)
    ]
    dimension = spark.createDataFrame(
        dimension_rows,
        "institution_id long, edebo_id string, edrpou string, institution_name string, reg_name string, area_name string, ter_name string",
    )
    fields = list(options)
    references = [tuple(rng.choice(options[f]) for f in fields) for _ in range(2500)]
    staging = staging_of(*[dict(zip(fields, r)) for r in references])
    order = etl.REFERENCE
    got = {tuple(r[c] for c in order): r.institution_id for r in etl.resolve_institutions(staging, dimension).collect()}

    con = duckdb.connect()
    con.register("staging", staging.select(*fields).toPandas())
    con.register("institutions", dimension.toPandas())
    listed = ", ".join(order)
    expected = con.execute(f"WITH {statements._LOOKUP} SELECT {listed}, institution_id FROM matches").fetchall()
    assert got == {tuple(r[:-1]): r[-1] for r in expected}
    assert len(got) > 150


def test_lookup_is_linear_when_one_group_is_hot(spark, staging_of):
    """Many references and many institutions under one code and name: no row-by-row pairing."""
    towns = [f"T{i}" for i in range(400)]
    known = [{**SCHOOL, "eo_edeboid": str(i), "eo_edrpou": "c", "eo_ter_name": t} for i, t in enumerate(towns)]
    asked = [{"eo_name": "S", "eo_edrpou": "c", "eo_ter_name": t, "eo_area_name": a} for t, a in itertools.product(towns, "AB")]
    dimension = etl.institutions(staging_of(*known))
    mapping = etl.resolve_institutions(staging_of(*asked), dimension)
    town = dimension.select("institution_id", "ter_name")
    assert mapping.join(town, "institution_id").filter(F.col("eo_ter_name") == F.col("ter_name")).count() == 800
    plan = mapping._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- participants and results --------------------------------------------------


def test_one_row_per_person_and_reruns_agree(staging_of):
    rows = [{"outid": f" {ID.format(1).upper()} ", "birth": b} for b in ("2007", "2006", "null")] + [{"outid": "null"}, {"outid": None}]
    empty = etl.institutions(staging_of())
    for arrangement in (rows, rows[::-1]):
        got = etl.participants(staging_of(*arrangement), empty).collect()
        assert [(r.out_id, r.birth_year) for r in got] == [(ID.format(1), None)]


def test_exam_rows(staging_of):
    got = {
        r.subject_code: r
        for r in etl.exam_results(
            staging_of(
                {
                    "outid": ID.format(1), "test_date": "2.6.2025",
                    "ukr_status": "Отримав", "ukr_ball": "40", "ukr_ball100": "180,5",
                    "math_status": "Не з'явився", "math_lang": "мова",
                    "geo_ball100": "150", "bio_ball": "12",
                }
            )
        ).collect()
    }
    assert set(got) == {"Ukr", "Math", "Geo"}
    assert (got["Ukr"].raw_score, got["Ukr"].scaled_score, got["Ukr"].is_present) == (Decimal("40.00"), Decimal("180.50"), True)
    assert (got["Math"].is_present, got["Math"].exam_lang, got["Geo"].exam_lang) == (False, "мова", None)
    assert got["Geo"].is_present is None
    assert got["Ukr"].exam_lang == "українська" and got["Ukr"].test_date == datetime.date(2025, 6, 2)


def test_repeated_person_keeps_both_sets_of_results(staging_of):
    record = {"outid": ID.format(1), "ukr_ball100": "150", "ukr_status": "ok"}
    got = etl.exam_results(staging_of(record, record))
    assert got.count() == 2 and got.select("result_id").distinct().count() == 2


# --- raw file ----------------------------------------------------------------


def raw_lines(first_fields, rest=73):
    header = ";".join(schemas.STAGING_FIELDS)
    return "\n".join([header, *[";".join([*fields, *["null"] * rest]) for fields in first_fields]]) + "\n"


def test_raw_reader_tells_null_empty_and_missing_apart(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(raw_lines([["a", ""], ["b", '""'], ["c", "null"], ["d", '"x ""q"" ; y"']]), encoding="utf-8")
    got = {r.outid: r.birth for r in read_staging(spark, str(tmp_path / "raw.csv")).select("outid", "birth").collect()}
    assert got == {"a": None, "b": "", "c": "null", "d": 'x "q" ; y'}


def test_short_row_raises_even_on_a_narrow_read(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(raw_lines([["a", "b"]], rest=72), encoding="utf-8")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_staging(spark, str(tmp_path / "raw.csv")).select("outid").collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_staging(spark, str(tmp_path / "raw.csv")).count()


def test_line_break_inside_quotes_needs_multi_line(spark, tmp_path):
    (tmp_path / "raw.csv").write_text(raw_lines([["a", '"x\ny"']]), encoding="utf-8")
    path = str(tmp_path / "raw.csv")
    assert read_staging(spark, path, multi_line=True).first().birth == "x\ny"
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_staging(spark, path).collect()


def test_raw_file_round_trip(spark, staging_of, tmp_path):
    df = staging_of({"outid": "a", "birth": None}, {"outid": "b", "birth": ""}, {"outid": "c", "eo_name": 'x "q" ; y'})
    write_staging(df, str(tmp_path / "out"))
    back = read_staging(spark, str(tmp_path / "out"))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def test_result_export_quotes_everything(spark, tmp_path):
    df = spark.createDataFrame([("a", None, Decimal("1.50"))], "x string, y string, z decimal(5,2)").coalesce(1)
    write_result(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("*.csv")
    assert part.read_text(encoding="utf-8") == '"x","y","z"\n"a","","1.50"\n'


# --- quality -----------------------------------------------------------------


def test_checks_return_the_violating_rows(spark):
    child = spark.createDataFrame([("a", 1), ("a", 2), ("bb", None), (None, 3)], "k string, p int")
    parent = spark.createDataFrame([(1,), (2,)], "id int")
    assert [tuple(r) for r in quality.unique(child, ["k"]).collect()] == [("a", 2)]
    assert [r.p for r in quality.foreign_key(child, "p", parent, "id").collect()] == [3]
    assert quality.not_null(child, "k").count() == 1
    assert [r.k for r in quality.too_long(child, "k", 1).collect()] == ["bb"]


def test_orphans_are_counted_by_row(spark):
    tables = {
        "subjects": spark.createDataFrame([("Ukr",)], "subject_code string"),
        "institutions": spark.createDataFrame([(1,)], "institution_id long"),
        "participants": spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "out_id string, institution_id long"),
        "exam_results": spark.createDataFrame([("a", "Ukr"), ("z", "Ukr"), ("z", "Xyz")], "out_id string, subject_code string"),
    }
    got = {(r.table_name, r.rule): r.violations for r in quality.foreign_key_report(tables).collect()}
    assert got == {
        ("participants", "institution_id in institutions"): 1,
        ("exam_results", "out_id in participants"): 2,
        ("exam_results", "subject_code in subjects"): 1,
    }


def test_a_failed_write_can_be_repeated(spark, staging_of, tmp_path):
    calls = []

    def source():
        calls.append(1)
        good = staging_of({"outid": ID.format(1)})
        return good if len(calls) > 1 else good.select(F.raise_error(F.lit("lost")).cast("string").alias("outid"))

    load = Warehouse(spark, source, str(tmp_path))
    with pytest.raises((PySparkException, Py4JJavaError)):
        load["staging"]
    assert load["staging"].count() == 1


def test_staging_checks(staging_of):
    staging = staging_of(
        {"outid": ID.format(1), **SCHOOL, "eo_edeboid": "1", "ukr_ball100": "12x"},
        {"outid": ID.format(2), "eo_name": "S", "eo_edrpou": "missing", "ukr_ball100": "150,5"},
    )
    dimension = etl.institutions(staging_of({**SCHOOL, "eo_edeboid": "1"}))
    assert [r.outid for r in quality.unresolved(staging, dimension).collect()] == [ID.format(2)]
    assert [r.outid for r in quality.unreadable_scores(staging, "ukr_ball100").collect()] == [ID.format(1)]
    summary = {r.resolved_by: r.participants for r in quality.resolution_summary(staging, dimension).collect()}
    assert summary == {quality.RESOLVED_BY_ID: 1, quality.UNRESOLVED: 1}


def test_publish_accepts_a_sound_load_and_rejects_a_broken_one(spark, staging_of, tmp_path):
    good = {"outid": ID.format(1), **SCHOOL, "test_date": "02.06.2025", "ukr_status": "ok", "ukr_ball": "1", "ukr_ball100": "150"}
    sound = Warehouse(spark, lambda: staging_of(good), str(tmp_path)).publish()
    assert spark.table("student_academic_profiles").count() == 1
    assert spark.table("clean_exam_results").count() == 1
    assert sound.check().count() == 0

    broken = Warehouse(spark, lambda: staging_of(good, {**good, "outid": "not-an-id"}), str(tmp_path))
    with pytest.raises(QualityError, match="out_id form"):
        broken.publish()


def fake_session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" and folder else default),
        sparkContext=SimpleNamespace(master=master),
    )


def test_tables_go_to_the_shared_folder_only():
    assert shared_folder(fake_session("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert shared_folder(fake_session("local[2]")) is not None
    for master in ("yarn", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_folder(fake_session(master))


def test_a_finished_load_opens_by_its_path(spark, staging_of, tmp_path):
    good = {"outid": ID.format(1), **SCHOOL, "test_date": "02.06.2025", "ukr_status": "ok", "ukr_ball": "1", "ukr_ball100": "150"}
    load = Warehouse(spark, lambda: staging_of(good), str(tmp_path))
    path = load.finish()
    files = sorted(p.name for p in tmp_path.rglob("*"))
    again = Warehouse.open(spark, path)
    for name in TABLES:
        assert sorted(again[name].collect(), key=str) == sorted(load[name].collect(), key=str)
    assert again.clean_exam_results().first().institution_id == 1
    assert sorted(p.name for p in tmp_path.rglob("*")) == files, "opening writes nothing"


def test_an_unfinished_load_does_not_open(spark, staging_of, tmp_path):
    load = Warehouse(spark, lambda: staging_of({"outid": ID.format(1)}), str(tmp_path))
    load["staging"]
    with pytest.raises(PySparkException):
        Warehouse.open(spark, load.path)


def test_result_ids_do_not_depend_on_partitions(staging_of):
    records = [{"outid": ID.format(k), "ukr_status": "ok", "ukr_ball100": "150", "geo_ball100": str(100 + k)} for k in range(9)]
    records += records[:2]
    found = [etl.exam_results(staging_of(*rows).repartition(n)).collect() for rows, n in ((records, 3), (records[::-1], 7))]
    first, second = [sorted(rows, key=lambda r: r.result_id) for rows in found]
    assert first == second
    assert [r.result_id for r in first] == list(range(1, 23))


def test_an_order_with_most_lines_is_read_alike(spark, monkeypatch):
    """The way of heavy orders gives the records of the plain way; ties and unknown orders included."""
    lines = [(7, k % 9 + 1, k % 50, 100.0 + k % 13, float(k % 50), ) for k in range(3000)] + [(k, 1 + k % 7, k, 50.0, 10.0) for k in range(20, 200)] + [(None, 1, 1, 1.0, 1.0)]
    lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double").repartition(4)
    orders = spark.createDataFrame([(k, k, "F") for k in range(10, 300)] + [(7, 7, "O")], "o_orderkey long, o_custkey long, o_orderstatus string")
    found = []
    assert adapter.heavy_values(lineitem, "l_orderkey") == [7]
    for heavy in ([7], []):
        monkeypatch.setattr(adapter, "heavy_values", lambda *_: heavy)
        found.append(adapter._records_with_orders(lineitem, orders))
    assert found[0].columns == found[1].columns
    one, two = [sorted(map(str, df.collect())) for df in found]
    assert one == two and len(one) > 300


def test_lines_are_dealt_once(spark):
    """Numbering, folding and joining need one shuffle of the lines and one of the orders."""
    lineitem = spark.createDataFrame([(k, 1, k, 50.0, 10.0) for k in range(50)], "l_orderkey long, l_linenumber int, l_partkey long, l_extendedprice double, l_quantity double")
    orders = spark.createDataFrame([(k, k, "F") for k in range(50)], "o_orderkey long, o_custkey long, o_orderstatus string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = adapter._records_with_orders(lineitem, orders)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2
