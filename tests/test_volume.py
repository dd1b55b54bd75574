"""How often rows are moved and written between the steps of a load."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scoreloom import catalogue, schemas
from scoreloom.functions.text import packed_id, unpacked_id
from scoreloom.operators import scan
from scoreloom.plans import etl, marts, quality, quarantine, sessions
from scoreloom.sources import adapter

SMALL = "/root/testdata/sf0.01"


@pytest.fixture
def no_broadcast(spark):
    """Plans as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_records_are_not_dealt_by_customer(spark, no_broadcast):
    """Texts of subjects are made last: no shuffle lies between them and the staging row."""
    plan = adapter.staging(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    fold = min(depth(line) for line in plan.splitlines() if "SortAggregate" in line)
    assert exchanges and not [line for line in exchanges if "custkey" in line and depth(line) < fold]


def test_results_are_dealt_once_and_not_stored_to_be_numbered(spark, staging_of, monkeypatch):
    stored = []
    monkeypatch.setattr(scan, "written", lambda df, name: stored.append(name) or df)
    record = {"ukr_status": "ok", "ukr_ball100": "150"}
    made = etl.exam_results(staging_of(*[{**record, "outid": f"p{k}"} for k in range(3000)]))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert stored == [] and plan.count("Repartition") == 1
    assert sorted(r["result_id"] for r in made.collect()) == list(range(1, 3001))


def test_numbers_follow_the_digest_where_equal_rows_are_many(spark):
    """Digits with more than a task's share of rows go another way; numbers are those of one window."""
    df = spark.range(12_000).select(F.when(F.col("id") < 5000, "same").when(F.col("id") < 8000, "again").otherwise(F.col("id").cast("string")).alias("v"))
    names = []
    keep = scan.written
    try:
        scan.written = lambda frame, name: names.append(name) or keep(frame, name)
        got = scan.numbered_by_digest(df, F.md5("v"), "n").orderBy("n").collect()
    finally:
        scan.written = keep
    expected = sorted((hashlib.md5(r["v"].encode()).hexdigest(), r["v"]) for r in df.collect())
    assert [(r["n"], r["v"]) for r in got] == [(k, v) for k, (_, v) in enumerate(expected, 1)]
    assert "hot-digests" in names


def test_rows_are_not_dealt_to_meet_few_marks(spark, tmp_path, monkeypatch):
    """A key that repeats and a parent that is missing are known before the rows are read for good."""
    rows = spark.range(50_000)
    child = rows.select((F.col("id") - (F.col("id") == 7).cast("long")).alias("result_id"), F.concat(F.lit("p"), (F.col("id") % 900).cast("string")).alias("out_id"))
    child = child.withColumns({c: F.lit("Ukr" if c == "subject_code" else None).cast("string") for c in schemas.TEXT_WIDTHS["exam_results"]})
    parents = {
        "participants": rows.limit(899).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("out_id")),
        "subjects": schemas.subjects_df(spark),
    }
    path = str(tmp_path / "in")
    child.write.parquet(path)
    parents["participants"].write.parquet(f"{path}-parents")
    parents["participants"] = spark.read.parquet(f"{path}-parents")
    plans = []
    marked = quarantine._marked
    monkeypatch.setattr(quarantine, "_marked", lambda *args: plans.append(marked(*args)) or plans[-1])
    judged = quarantine.judge(spark.read.parquet(path), "exam_results", parents, str(tmp_path / "out"))
    assert judged.violations["result_id unique"] == 2 and judged.violations["out_id in participants"] == 50_000 // 900
    assert "Exchange hashpartitioning" not in plans[-1]._jdf.queryExecution().executedPlan().toString()


def test_identifiers_travel_in_sixteen_bytes_and_come_back(spark):
    ids = [None, "", "x", "null", "0" * 16, "\x00" * 16, "Ї" * 8, "0123abcd-0000-ffff-8000-00000000000f", "0123ABCD-0000-ffff-8000-00000000000f", "0123abcd0000ffff800000000000000f"]
    df = spark.createDataFrame([(i,) for i in ids], "v string")
    got = df.select("v", packed_id(F.col("v")).alias("p")).select("v", "p", unpacked_id(F.col("p")).alias("back")).collect()
    assert [r["back"] for r in got] == ids
    assert [len(r["p"]) == 16 for r in got if r["v"] is not None] == [len(i) == 36 and i.islower() for i in ids if i is not None]
    assert len({bytes(r["p"]) for r in got if r["p"] is not None}) == len(ids) - 1


def test_result_ids_with_identifiers_of_any_form(staging_of):
    record = {"ukr_status": "ok", "ukr_ball100": "150"}
    ids = [f"{k:08x}-0000-4000-8000-{k:012x}" for k in range(300)] + [f"person {k}" for k in range(300)]
    staging = staging_of(*[{**record, "outid": i} for i in ids])
    made = etl.exam_results(staging)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan[plan.index("Repartition") :]
    fields = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in made.columns[1:]]
    got = made.withColumn("h", F.md5(F.concat_ws("|", *fields))).orderBy("result_id").collect()
    assert [r["h"] for r in got] == sorted(r["h"] for r in got) and [r["result_id"] for r in got] == list(range(1, 601))
    assert sorted(r["out_id"] for r in got) == sorted(ids)


def test_people_are_grouped_by_sixteen_bytes(spark, no_broadcast):
    """Profiles, days of people and checks deal exams by the short form of an identifier, not by its text."""
    load = catalogue.warehouse(spark, SMALL)
    exams, people = load["exam_results"], load["participants"]
    for made in (marts.student_profiles(exams, people, load["institutions"]), sessions.person_days(exams, people), quality.unique_report(load.star), quality.foreign_key_report(load.star)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(_" in plan and "unhex(" in plan
