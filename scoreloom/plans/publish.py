"""From raw files to the published results: load, integrity checks, views, and a file for each result.

    python -m scoreloom RAW_FILES OUTPUT_FOLDER
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from scoreloom.plans import archetypes, electives, regions, resilience, sessions
from scoreloom.plans.warehouse import Warehouse
from scoreloom.sources.results import write_result

Result = Callable[[Warehouse], DataFrame]


def _profiles(w: Warehouse) -> DataFrame:
    return w["student_academic_profiles"]


#: Every published result, by the name of its view and its folder.
RESULTS: dict[str, Result] = {
    "daily_sessions": lambda w: sessions.calendar_of(w["person_days"]),
    "regions": lambda w: regions.regions(_profiles(w)),
    "macro_locations": lambda w: resilience.macro_locations(_profiles(w)),
    "institution_types": lambda w: resilience.institution_types(_profiles(w)),
    "rural_schools": lambda w: resilience.rural_schools(_profiles(w), w["institutions"]),
    "school_clusters": lambda w: resilience.school_clusters(_profiles(w)),
    "elective_strategy": lambda w: electives.elective_strategy(_profiles(w)),
    "archetype_profiles": lambda w: archetypes.archetype_profiles(_profiles(w)),
    "elective_choices": lambda w: archetypes.elective_choices(_profiles(w)),
}

#: Subjects of a region beside its students, from both marts.
REGION_SUBJECTS = """
    WITH exams AS (
        SELECT reg_name, subject_code, count(*) AS results, sum(scaled_score) / count(*) AS mean
        FROM clean_exam_results GROUP BY reg_name, subject_code
    ), students AS (
        SELECT reg_name, count(*) AS students, count_if(failed) AS failed_students, count(elective_subject) AS with_elective
        FROM student_academic_profiles GROUP BY reg_name
    )
    SELECT e.reg_name, e.subject_code, e.results, round(e.mean, 2) AS mean_score, s.students, s.failed_students, s.with_elective
    FROM exams e JOIN students s ON e.reg_name <=> s.reg_name
"""


def with_results(w: Warehouse) -> Warehouse:
    """Make every result a table of the load as well: computed and written on first use, read from then on."""
    for name, build in RESULTS.items():
        w.add(name, lambda build=build: build(w))
    return w


def with_views(w: Warehouse) -> Warehouse:
    """Check the load, then make its tables, both marts and all results available to SQL."""
    w.publish()
    for name, build in RESULTS.items():
        build(w).createOrReplaceTempView(name)
    return w


def region_subjects(w: Warehouse) -> DataFrame:
    return with_views(w).spark.sql(REGION_SUBJECTS)


def result_sizes(w: Warehouse) -> DataFrame:
    """Rows of every result by SQL on its view."""
    with_views(w)
    return w.spark.sql(" UNION ALL ".join(f"SELECT '{name}' AS result, count(*) AS row_count FROM {name}" for name in RESULTS))


def write_results(w: Warehouse, folder: str) -> dict[str, str]:
    """Write every result of a checked load below the folder; the paths by result."""
    paths = {name: f"{folder}/{name}" for name in RESULTS}
    with_views(w)
    for name, path in paths.items():
        write_result(w.spark.table(name), path)
    return paths
