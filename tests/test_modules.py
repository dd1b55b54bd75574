"""Marts and analytic statements on small inputs."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from scoreloom import fixed_values as fv
from scoreloom.plans import archetypes, electives, marts, regions, resilience, sessions

PEOPLE = "out_id string, participant_status string, ter_type string, gender string, institution_id long"
SCHOOLS = "institution_id long, institution_name string, institution_type string, reg_name string, area_name string, ter_name string"
EXAMS = "result_id long, out_id string, subject_code string, test_date date, raw_score decimal(5,2), scaled_score decimal(5,2), is_present boolean"
DAY = datetime.date(2025, 6, 2)


def exam_rows(*rows):
    """(person, subject, score[, date[, present]]) as exam results."""
    out = []
    for i, row in enumerate(rows):
        person, subject, score = row[:3]
        day = row[3] if len(row) > 3 else DAY
        present = row[4] if len(row) > 4 else True
        out.append((i, person, subject, day, None, None if score is None else Decimal(score), present))
    return out


@pytest.fixture
def star(spark):
    def build(exams, people, schools=()):
        return (
            spark.createDataFrame(exam_rows(*exams), EXAMS),
            spark.createDataFrame(people, PEOPLE),
            spark.createDataFrame(list(schools), SCHOOLS),
        )

    return build


def test_only_attended_dated_scored_exams_count(star):
    exams = [("a", "Ukr", "150"), ("a", "Hist", "150", DAY, False), ("a", "Math", None), ("a", "Geo", "150", None), ("a", "Bio", "150", DAY, None)]
    tables = star(exams, [("a", None, "місто", None, None)])
    assert [r.subject_code for r in marts.clean_exam_results(*tables).collect()] == ["Ukr"]


def test_clean_result_of_a_person_without_institution(star):
    row = marts.clean_exam_results(*star([("a", "Ukr", "150")], [("a", "s", None, None, 5)])).first()
    assert (row.macro_location, row.institution_id, row.full_institution_location, row.is_regional_center) == (fv.UNDEFINED, None, "", False)
    assert row.__fields__ == marts.CLEAN_COLUMNS


def test_profile_of_an_elective_only_student(star):
    row = marts.student_profiles(*star([("a", "Geo", "0")], [("a", "s", "місто", None, None)])).first()
    assert (row.mandatory_avg_score, row.failed_mandatory, row.failed) == (None, False, True)
    assert (row.elective_subject, row.elective_score, row.total_subjects_completed) == ("Geo", Decimal("0.00"), 1)


@pytest.mark.parametrize(("eng", "geo"), [("110", "190"), ("190", "110")])
def test_profile_with_two_electives_takes_both_maxima(star, eng, geo):
    row = marts.student_profiles(*star([("a", "Eng", eng), ("a", "Geo", geo)], [("a", None, None, None, None)])).first()
    assert (row.elective_subject, row.elective_score) == ("Geo", Decimal("190.00"))


def test_profile_without_elective_and_rounded_means(star):
    exams = [("a", "Ukr", "100"), ("a", "Hist", "100"), ("a", "Math", "100.01")]
    row = marts.student_profiles(*star(exams, [("a", None, None, None, None)])).first()
    assert (row.elective_subject, row.mandatory_avg_score, row.overall_avg_score) == (None, Decimal("100.00"), Decimal("100.00"))
    assert row.overall_mean == Decimal("100.003333333333")


def test_profiles_are_hash_aggregated(star):
    plan = marts.student_profiles(*star([("a", "Ukr", "100")], [("a", None, None, None, None)]))
    assert "SortAggregate" not in plan._jdf.queryExecution().executedPlan().toString()


def test_two_dates_make_two_person_days_but_one_profile(star):
    later = datetime.date(2025, 7, 17)
    tables = star([("a", "Ukr", "150"), ("a", "Math", "0", later)], [("a", fv.STATUS_CURRENT_YEAR, None, None, None)])
    assert marts.student_profiles(*tables).first().test_date == later
    days = sessions.daily_sessions(*tables[:2]).collect()
    assert [(r.total_participants, float(r.fail_rate_mandatory)) for r in days] == [(1, 0.0), (1, 100.0)]


def test_first_and_last_session(star):
    dates = [datetime.date(2025, 6, d) for d in (2, 3, 4)]
    exams = [(str(i), "Ukr", s, d) for i, (s, d) in enumerate(zip(("126.41", "130.24", "129.73"), dates))]
    people = [(str(i), fv.STATUS_CURRENT_YEAR, None, None, None) for i in range(3)]
    got = sessions.daily_sessions(*star(exams, people)[:2]).collect()
    assert [r.day_over_day_delta_current_year for r in got] == [None, Decimal("3.83"), Decimal("-0.51")]
    assert [r.smoothed_avg_current_year for r in got] == [Decimal("128.33"), Decimal("128.79"), Decimal("129.99")]
    assert float(got[-1].cume_progress) == 100.0


def test_session_without_mandatory_scores(star):
    row = sessions.daily_sessions(*star([("a", "Geo", "150")], [("a", None, None, None, None)])[:2]).first()
    assert (row.total_participants, row.avg_scaled_score_overall, row.median_scaled_score_overall, float(row.fail_rate_mandatory)) == (1, None, None, 0.0)


def student(region, central, mean, failed=False):
    return {"reg_name": region, "is_regional_center": central, "overall_mean": float(mean), "failed": failed}


def test_region_without_centre_or_without_high_scores_has_no_quotient(profiles_of):
    got = {
        r.reg_name: r
        for r in regions.regions(
            profiles_of(
                student("A", False, 190), student("B", True, 150), student("B", False, 150, True),
                student("C", True, 190), student("C", False, 100), student(None, False, 100),
                student("м.Київ", True, 190), student("Київська область", False, 190, True),
            )
        ).collect()
    }
    assert set(got) == {"A", "B", "C", "Київська область"}
    assert (got["A"].monopoly_lq_index, got["A"].median_center_score, got["A"].region_classification) == (None, None, fv.UNDEFINED)
    assert got["B"].monopoly_lq_index is None and got["B"].fail_rate_ratio is None
    assert (float(got["C"].monopoly_lq_index), got["C"].region_classification) == (2.0, fv.REGION_CLASSES[0][1])
    assert float(got["Київська область"].monopoly_lq_index) == 1.0
    assert float(got["Київська область"].periphery_failed_percentage) == 100.0


def rural(i, mean, school=1, **more):
    return {"out_id": str(i), "macro_location": fv.LOCATION_VILLAGE, "mandatory_avg_score": mean and float(mean), "institution_id": school, **more}


def test_missing_score_is_not_a_failure(profiles_of):
    row = resilience.macro_locations(profiles_of(rural(1, 150, score_ukr=150.0), rural(2, 100, score_math=0.0))).first()
    assert (row.total_students, float(row.failed_percentage)) == (2, 50.0)


def test_location_with_no_mandatory_scores(profiles_of):
    row = resilience.macro_locations(profiles_of(rural(1, None), rural(2, None))).first()
    assert (row.total_students, row.mandatory_median_score, row.iqr, float(row.high_achievers_percentage)) == (2, None, None, 0.0)


def test_group_filter_keeps_the_limit_itself(profiles_of):
    rows = [rural(i, 150, institution_type=t) for t, n in (("big", 3), ("small", 2)) for i in range(n)]
    assert [r.institution_type for r in resilience.institution_types(profiles_of(*rows), min_students=3).collect()] == ["big"]


def test_school_on_the_rural_median_is_not_polarised(spark, profiles_of):
    rows = [rural(i, m) for i, m in enumerate((100, 120, 185))] + [
        {"out_id": "c", "macro_location": fv.LOCATION_CITY, "mandatory_avg_score": 150.0}
    ]
    names = spark.createDataFrame([(1, "S", "R", "t")], "institution_id long, institution_name string, reg_name string, institution_type string")
    got = resilience.rural_schools(profiles_of(*rows), names, min_students=3).first()
    assert (got.school_rank, got.institution_name, float(got.mandatory_median_score)) == (fv.SCHOOL_TYPICAL, "S", 120.0)


def test_list_and_clusters_classify_the_same_schools(spark, profiles_of):
    rows = [rural(f"{s}{i}", 100 + 7 * s + i * (11 if s % 2 else 45), school=s) for s in range(1, 7) for i in range(3)]
    rows.append({"out_id": "c", "macro_location": fv.LOCATION_CITY, "mandatory_avg_score": 131.0})
    profiles = profiles_of(*rows)
    names = spark.createDataFrame([(s, "S", "R", "t") for s in range(1, 7)], "institution_id long, institution_name string, reg_name string, institution_type string")
    listed = {r.school_rank: r["count"] for r in resilience.rural_schools(profiles, names, 3).groupBy("school_rank").count().collect()}
    clusters = resilience.school_clusters(profiles, 3).collect()
    assert {r.school_cluster: r.institutions_count for r in clusters} == listed
    assert sum(r.total_graduates_covered for r in clusters) == 18


def test_quartile_ends_belong_to_the_middle(profiles_of):
    means = (100, 110, 120, 130, 140)
    got = electives.elective_strategy(
        profiles_of(*[
            {"elective_subject": s, "elective_score": 150.0, "mandatory_avg_score": float(m), "failed_mandatory": False}
            for s, m in zip(("Geo", "Eng", "Eng", "Eng", "Bio"), means)
        ])
    ).collect()
    shares = {r.elective_subject: tuple(float(v or 0) for v in (r.share_of_all_q1_students, r.share_of_all_q2_students, r.share_of_all_q3_students)) for r in got}
    assert shares == {"Geo": (100.0, 0.0, 0.0), "Eng": (0.0, 100.0, 0.0), "Bio": (0.0, 0.0, 100.0)}


def test_share_of_an_empty_cohort_is_null(profiles_of):
    row = electives.elective_strategy(profiles_of({"elective_subject": "Geo", "elective_score": 150.0, "mandatory_avg_score": 120.0, "failed_mandatory": False})).first()
    assert (row.share_of_all_q1_students, float(row.share_of_all_q2_students)) == (None, 100.0)


def test_bounds_use_all_students_but_shares_only_those_with_an_elective(profiles_of):
    rows = [{"mandatory_avg_score": float(m)} for m in (100, 101, 102, 103)]
    rows.append({"elective_subject": "Geo", "elective_score": 0.0, "mandatory_avg_score": 190.0, "failed_mandatory": True})
    row = electives.elective_strategy(profiles_of(*rows)).first()
    assert (row.total_candidates, float(row.share_of_all_q3_students), float(row.mandatory_failed_prc), float(row.elective_subject_failed_prc)) == (1, 100.0, 100.0, 100.0)


def test_archetype_statements_need_all_three_scores(profiles_of):
    full = {"score_math": 155.0, "score_ukr": 140.0, "score_hist": 140.0, "gender": fv.WOMEN, "macro_location": fv.LOCATION_CITY}
    profiles = profiles_of(full, {**full, "elective_subject": "Phys", "elective_score": 150.0}, {**full, "score_hist": None})
    row = archetypes.archetype_profiles(profiles).first()
    assert (row.archetype, row.total_students, float(row.avg_asymmetry_delta), float(row.women_pct), float(row.city_pct)) == (fv.ARCHETYPE_STEM, 2, 15.0, 100.0, 100.0)
    assert [(r.elective_subject, r.students_count) for r in archetypes.elective_choices(profiles).collect()] == [("Phys", 1)]


def test_equal_counts_share_a_rank(profiles_of):
    full = {"score_math": 155.0, "score_ukr": 140.0, "score_hist": 140.0, "elective_score": 150.0}
    rows = [{**full, "elective_subject": s} for s, n in (("Eng", 5), ("Fra", 3), ("Spa", 3), ("Deu", 1)) for _ in range(n)]
    got = archetypes.elective_choices(profiles_of(*rows)).collect()
    assert [(r.elective_subject, r.subject_rank_in_archetype) for r in got] == [("Eng", 1), ("Fra", 2), ("Spa", 2), ("Deu", 3)]


def test_hot_person_and_hot_school(spark):
    """One person and one school hold most rows; totals stay whole."""
    exams = spark.range(6000).select(
        F.col("id").alias("result_id"),
        F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("p"), F.col("id"))).alias("out_id"),
        F.lit("Ukr").alias("subject_code"),
        F.lit(DAY).alias("test_date"),
        F.lit(None).cast("decimal(5,2)").alias("raw_score"),
        F.lit(150).cast("decimal(5,2)").alias("scaled_score"),
        F.lit(True).alias("is_present"),
    )
    people = exams.select("out_id").distinct().select(
        "out_id", F.lit("s").alias("participant_status"), F.lit(fv.TERRITORY_VILLAGE).alias("ter_type"), F.lit(None).cast("string").alias("gender"), F.lit(1).cast("long").alias("institution_id")
    )
    schools = spark.createDataFrame([(1, "S", "t", "R", None, None)], SCHOOLS)
    profiles = marts.student_profiles(exams, people, schools)
    assert profiles.count() == 2001
    assert profiles.filter("out_id = 'hot'").first().total_subjects_completed == 4000
    assert resilience.rural_schools(profiles, schools).first().total_students == 2001
