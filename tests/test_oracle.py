"""Every registered query against its SQL, and invariants that hold on any input."""

import os

import duckdb
import pytest

import __spark_entry__ as contract
from oracle.statements import STATEMENTS
from scoreloom.catalogue import QUERIES

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DIRECTORY}/{table}.parquet'")
    return con


@pytest.fixture(scope="module")
def result(spark):
    kept = {}

    def run(name):
        if name not in kept:
            kept[name] = contract.queries()[name](spark, DIRECTORY).collect()
        return kept[name]

    return run


def test_every_query_has_sql():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(contract.queries()) and set(STATEMENTS) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(name, result, engine):
    statement = engine.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in statement.description]
    expected = [dict(zip(columns, row)) for row in statement.fetchall()]
    got = [row.asDict() for row in result(name)]

    def ordered(rows):
        return sorted((tuple(sorted(r.items())) for r in rows), key=lambda r: [(v is None, str(v)) for _, v in r])

    assert len(got) == len(expected)
    assert ordered(got) == ordered(expected)


def test_entry_runs(spark):
    assert contract.entry(spark).count() == 3


def total(rows, column):
    return sum(r[column] for r in rows)


def test_person_days_cover_all_students(result):
    students = len(result("mart_student_profiles"))
    days = {(r.out_id, r.test_date) for r in result("mart_clean_exam_results")}
    assert total(result("m1_daily_sessions"), "total_participants") == len(days) > students, "some sit on several days"
    assert total(result("m3_macro"), "total_students") <= students
    assert total(result("m2_regions"), "total_participants") <= students


def test_every_line_is_an_exam(spark, result):
    lines = spark.read.parquet(f"{contract.ENTRY_TABLES}/lineitem.parquet").count()
    assert len(result("etl_exam_results")) == lines
    assert len({r.outid for r in result("etl_staging")}) < len(result("etl_staging")), "records repeat"


def test_choices_are_part_of_both_their_sources(result):
    assert total(result("m5_choices"), "students_count") <= total(result("m5_archetypes"), "total_students")
    assert total(result("m5_choices"), "students_count") <= total(result("m4_electives"), "total_candidates")


def test_shares_add_up(result):
    for name, column in (
        ("m4_electives", "election_share"), ("m4_electives", "share_of_all_q1_students"),
        ("m4_electives", "share_of_all_q2_students"), ("m4_electives", "share_of_all_q3_students"),
        ("m5_archetypes", "archetype_share"), ("m3_clusters", "cluster_share_pct"),
    ):
        assert total(result(name), column) == pytest.approx(100, abs=0.3)


def test_progress_grows_to_the_end(result):
    progress = [r.cume_progress for r in sorted(result("m1_daily_sessions"), key=lambda r: r.test_date)]
    assert progress == sorted(progress) and progress[-1] == 100.0


def test_clean_results_are_attended_results(result):
    attended = [r for r in result("etl_exam_results") if r.is_present and r.scaled_score is not None]
    assert len(result("mart_clean_exam_results")) == len(attended)
    assert len(result("etl_participants")) >= len(result("mart_student_profiles"))
