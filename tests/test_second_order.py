"""Second-order statistics on the published result figures."""

import datetime
from decimal import Decimal

from scoreloom import fixed_values as fv
from scoreloom.plans import second_order

# Published daily results. Date, participants, current-year mean and median, failure rate, delta.
DAYS = """
2025-05-17 11728 126.41 130.67 19.92 -
2025-05-24 14021 130.24 133.67 18.37 3.83
2025-05-31 15018 129.73 132.67 11.89 -0.51
2025-06-02 16733 147.02 147.33 4.83 17.29
2025-06-03 18103 138.10 139.33 8.62 -8.92
2025-06-04 18979 133.49 136.00 9.92 -4.61
2025-06-05 15480 144.36 145.00 5.88 10.87
2025-06-06 18817 132.23 135.00 17.11 -12.13
2025-06-09 18785 129.28 132.33 18.07 -2.95
2025-06-10 18359 133.77 136.67 14.90 4.49
2025-06-11 18181 136.87 137.67 7.34 3.10
2025-06-12 16098 146.50 145.67 3.78 9.63
2025-06-13 18175 132.72 134.67 12.03 -13.78
2025-06-16 14817 143.99 144.33 4.57 11.27
2025-06-17 18170 128.39 132.67 20.90 -15.60
2025-06-18 14657 142.49 143.33 8.13 14.10
2025-06-19 18219 127.64 130.67 18.41 -14.85
2025-07-17 2458 127.23 132.00 24.25 -0.41
2025-07-18 2864 127.65 131.00 18.05 0.42
"""

# Published regional results. Quotient, median gap, failure ratio.
REGIONS = """
1.68 7.50 1.99
1.64 7.00 1.55
1.61 5.25 1.47
1.58 7.00 1.93
1.57 4.75 1.70
1.55 7.00 1.67
1.55 2.00 1.19
1.45 5.00 1.60
1.43 4.50 1.47
1.40 4.00 1.47
1.34 3.75 1.31
1.32 2.25 1.44
1.27 5.00 1.53
1.24 2.50 1.11
1.24 4.25 1.51
1.24 5.50 1.60
1.22 4.63 1.57
1.21 2.25 1.40
1.19 4.50 1.67
1.14 3.75 1.35
1.11 3.75 1.22
0.97 3.25 1.40
"""


def days(spark):
    rows = []
    for number, line in enumerate(DAYS.split("\n")[1:-1], 1):
        day, n, mean, median, fail, delta = line.split()
        rows.append((datetime.date.fromisoformat(day), number, int(n), *map(Decimal, (mean, median, fail)), None if delta == "-" else Decimal(delta)))
    return spark.createDataFrame(
        rows,
        "test_date date, seq_session_number long, total_participants long, avg_score_current_year decimal(10,2), "
        "median_score_current_year decimal(10,2), fail_rate_mandatory decimal(10,2), day_over_day_delta_current_year decimal(10,2)",
    )


def test_main_session_volatility(spark):
    row = second_order.day_volatility(days(spark)).first()
    assert row.sessions == 14
    assert round(float(row.delta_stddev), 2) == 11.69
    assert (float(row.delta_min), float(row.delta_max)) == (-15.60, 17.29)
    assert round(float(row.score_trend), 2) == -0.43
    assert round(float(row.load_score_correlation), 2) == -0.80


def test_weekly_failures(spark):
    got = [round(float(r.mean_fail_rate), 2) for r in second_order.weekly_failures(days(spark)).collect()]
    assert got == [9.27, 11.22, 13.00]


def test_day_clusters(spark):
    got = {r.day_cluster: r for r in second_order.day_clusters(days(spark)).collect()}
    assert {k: (r.sessions, round(float(r.mean_score_current_year), 2), round(float(r.mean_fail_rate), 2)) for k, r in got.items()} == {
        "language": (5, 144.87, 5.44),
        "mass": (9, 132.50, 14.14),
    }
    assert round(float(got["language"].mean_participants)) == 15557


def test_region_summary(spark):
    rows = [tuple(map(Decimal, line.split())) for line in REGIONS.split("\n")[1:-1]] + [(None, None, None)] * 2
    frame = spark.createDataFrame(rows, "monopoly_lq_index decimal(10,2), delta_median decimal(10,2), fail_rate_ratio decimal(10,2)")
    row = second_order.region_summary(frame).first()
    assert (row.regions, row.regions_above_one, row.regions_centralised) == (22, 21, 10)
    assert [round(float(v), 2) for v in (row.mean_lq, row.mean_delta_median, row.mean_fail_rate_ratio, row.gap_ratio_correlation)] == [1.36, 4.52, 1.51, 0.81]


def test_headline_ratios(spark):
    electives = spark.createDataFrame(
        [("Geo", Decimal("32.82")), ("Bio", Decimal("27.63")), ("UkrLit", Decimal("18.38")), ("Eng", Decimal("17.45"))],
        "elective_subject string, share_of_all_q1_students decimal(10,2)",
    )
    groups = spark.createDataFrame([(fv.ARCHETYPE_HUMANITIES, 66985), (fv.ARCHETYPE_STEM, 6462)], "archetype string, total_students long")
    choices = spark.createDataFrame(
        [(fv.ARCHETYPE_STEM, "Phys", Decimal("13.91")), (fv.ARCHETYPE_STEM, "Chem", Decimal("1.81")), (fv.ARCHETYPE_STEM, "Eng", Decimal("52.14")), (fv.ARCHETYPE_RISK, "Phys", Decimal("2.34"))],
        "archetype string, elective_subject string, pct_within_archetype decimal(10,2)",
    )
    got = {r.statistic: float(r.value) for r in second_order.headline_ratios(days(spark), electives, groups, choices).collect()}
    assert got["first_month_participants"] == 40767
    assert round(got["humanities_per_stem"], 1) == 10.4
    assert got["weakest_quarter_in_refuge_electives"] == 78.83
    assert got["stem_students_outside_stem_electives"] == 84.28
