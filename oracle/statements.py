"""SQL for DuckDB that answers every registered query independently of Spark.

The statements stay declarative where the Spark side is re-planned for scale: the
institution lookup is one OR-ed condition with a ranking, the marts group by all
person columns, quantiles and means run over the rows themselves.
"""

from __future__ import annotations

from scoreloom import fixed_values as fv
from scoreloom import schemas
from scoreloom.schemas import ELECTIVE, MANDATORY, STAGING_FIELDS, SUBJECTS
from scoreloom.sources import deliveries


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def rounded(expression: str, places: int) -> str:
    return f"CAST(round(CAST({expression} AS DECIMAL(38,10)), {places}) AS DOUBLE)"


def percent(part: str, whole: str, places: int) -> str:
    return rounded(f"100.0 * ({part}) / nullif({whole}, 0)", places)


def quantile(column: str, p: float, where: str | None = None) -> str:
    call = f"quantile_cont(CAST({column} AS DOUBLE), {p})"
    return f"{call} FILTER (WHERE {where})" if where else call


def hits(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def value_or_null(column: str) -> str:
    return f"nullif({column}, '{fv.MISSING}')"


# --- staging -----------------------------------------------------------------

_EXAMS = f"""exams AS (
  SELECT l_orderkey AS k, CASE l_linenumber WHEN 1 THEN 'Ukr' WHEN 2 THEN 'Hist' WHEN 3 THEN 'Math'
         ELSE [{", ".join(text(code) for code in ELECTIVE)}][l_partkey % {len(ELECTIVE)} + 1] END AS subject,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(l_quantity AS BIGINT) AS q, l_linenumber, l_partkey
  FROM lineitem
),
repeated AS (
  SELECT *, row_number() OVER (PARTITION BY k, subject ORDER BY l_linenumber, cents, q, l_partkey) AS record FROM exams
),
records AS (
  SELECT k, record, {", ".join(f"max(cents) FILTER (WHERE subject = '{s.code}') AS c_{s.prefix}, max(q) FILTER (WHERE subject = '{s.code}') AS q_{s.prefix}" for s in SUBJECTS)}
  FROM repeated GROUP BY k, record
)"""


def _block_columns() -> list[str]:
    columns = []
    for subject in SUBJECTS:
        q, points = f"q_{subject.prefix}", f"(10000 + c_{subject.prefix} % 10001)"
        values = {
            "block": f"'{subject.code}'",
            "lang": "'українська'",
            "status": f"CASE WHEN {q} >= 48 THEN 'Не з''явився' ELSE 'Отримав результат' END",
            "ball100": f"CASE WHEN {q} >= 48 THEN 'null' WHEN {q} <= 5 THEN '0,0' "
            f"ELSE ({points} // 100) || ',' || lpad(CAST({points} % 100 AS VARCHAR), 2, '0') END",
            "ball": f"CASE WHEN {q} >= 48 THEN 'null' ELSE CAST({q} AS VARCHAR) END",
        }
        for part, value in values.items():
            if f"{subject.prefix}_{part}" in subject.fields:
                columns.append(f"CASE WHEN {q} IS NOT NULL THEN {value} ELSE 'null' END AS {subject.prefix}_{part}")
    return columns


def _staging() -> str:
    blocks = ",\n         ".join(_block_columns())
    return f"""{_EXAMS},
sources AS (
  SELECT coalesce(o_orderkey, k) AS o_orderkey, o_custkey, o_orderstatus, c_mktsegment, n_nationkey, n_name,
         (coalesce(record, 1) - 1) * 7 AS later, records.* EXCLUDE (k, record)
  FROM orders FULL JOIN records ON k = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
),
texts AS (
  SELECT regexp_replace(md5(CAST(o_orderkey AS VARCHAR)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') AS outid,
         CASE WHEN o_orderkey % 50 = 0 THEN 'null' ELSE CAST(2008 - o_orderkey % 5 AS VARCHAR) END AS birth,
         CASE o_orderkey % 2 WHEN 0 THEN 'жіноча' ELSE 'чоловіча' END AS sex_type_name,
         n_name AS reg_name, 'District ' || (o_custkey % 4) AS area_name, 'null' AS ter_name,
         CASE o_orderstatus WHEN 'F' THEN '{fv.STATUS_CURRENT_YEAR}' WHEN 'O' THEN '{fv.STATUS_PREVIOUS_YEARS}'
              WHEN 'P' THEN '{fv.STATUS_PENITENTIARY}' ELSE 'null' END AS reg_type_name,
         CASE WHEN o_orderkey % 97 = 0 THEN 'null' WHEN o_custkey % 10 = 0 THEN 'інша країна'
              WHEN o_custkey % 10 BETWEEN 1 AND 6 THEN 'місто' ELSE 'селище, село' END AS ter_type_name,
         CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'null' ELSE 'School #' || o_custkey END AS eo_name,
         c_mktsegment AS eo_type_name,
         CASE n_nationkey WHEN 0 THEN 'м.Київ' WHEN 1 THEN 'Київська область' ELSE n_name END AS eo_reg_name,
         CASE WHEN o_custkey % 12 = 0 THEN 'null' WHEN o_custkey % 5 < 2 AND n_nationkey NOT IN (2, 3) THEN 'м. Львів'
              ELSE 'District ' || (o_custkey % 4) END AS eo_area_name,
         CASE WHEN o_custkey % 7 = 0 AND n_nationkey NOT IN (2, 3) THEN 'м. Луцьк' ELSE 'с. Town ' || (o_custkey % 9) END AS eo_ter_name,
         CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE 'Dept ' || (o_custkey % 25) END AS eo_parent,
         CASE WHEN o_custkey % 6 = 0 THEN 'null' ELSE 'R' || o_custkey END AS eo_edrpou,
         CASE WHEN o_custkey % 3 = 0 THEN 'null' ELSE CAST(o_custkey AS VARCHAR) END AS eo_edeboid,
         'session' AS test,
         strftime(DATE '2025-05-17' + CAST((o_orderkey + later) % 60 AS INTEGER), '%d.%m.%Y') AS test_date,
         {blocks},
         n_name AS pt_reg_name, 'null' AS pt_area_name, 'null' AS pt_ter_name
  FROM sources
),
staging AS MATERIALIZED (SELECT {", ".join(f"coalesce({c}, 'null') AS {c}" for c in STAGING_FIELDS)} FROM texts)"""


# --- star schema -------------------------------------------------------------

# One record per institution key; ids follow the hash order of the keys.
_INSTITUTIONS = """named AS (
  SELECT coalesce(nullif(eo_edeboid, 'null'), nullif(eo_edrpou, 'null'),
                  concat_ws('||', eo_name, eo_reg_name, eo_area_name, eo_ter_name)) AS k,
         nullif(eo_edeboid, 'null') AS edebo_id, nullif(eo_edrpou, 'null') AS edrpou, eo_name AS institution_name,
         nullif(eo_type_name, 'null') AS institution_type, nullif(eo_reg_name, 'null') AS reg_name,
         nullif(eo_area_name, 'null') AS area_name, nullif(eo_ter_name, 'null') AS ter_name,
         nullif(eo_parent, 'null') AS parent_governance
  FROM staging WHERE eo_name <> 'null'
),
chosen AS (
  SELECT * FROM named
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY parent_governance IS NULL, edrpou IS NULL, institution_name,
    edebo_id NULLS FIRST, edrpou NULLS FIRST, institution_type NULLS FIRST, reg_name NULLS FIRST,
    area_name NULLS FIRST, ter_name NULLS FIRST, parent_governance NULLS FIRST) = 1
),
institutions AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY md5(k), k) AS institution_id, * EXCLUDE (k) FROM chosen
)"""

# One select per way to find an institution; a smaller place wins, then the smaller id.
_REFERENCE = ("eo_edeboid", "eo_edrpou", "eo_name", "eo_reg_name", "eo_area_name", "eo_ter_name")


def _closeness(known: str, candidate: str) -> str:
    """0 for the same place, 1 for another, 2 where either side says nothing."""
    return f"CASE WHEN {known} = 'null' OR {known} IS NULL OR {candidate} IS NULL THEN 2 WHEN {known} = {candidate} THEN 0 ELSE 1 END"


_LOOKUP = f"""refs AS (
  SELECT DISTINCT {", ".join(_REFERENCE)} FROM staging WHERE eo_name <> 'null'
),
without_id AS (SELECT * FROM refs WHERE eo_edeboid = 'null' OR eo_edeboid IS NULL),
by_id AS (SELECT r.*, 0 AS place, i.institution_id FROM refs r JOIN institutions i ON i.edebo_id = r.eo_edeboid WHERE r.eo_edeboid <> 'null'),
by_code AS (
  SELECT r.*, 10 + 3 * ({_closeness("r.eo_ter_name", "i.ter_name")}) + ({_closeness("r.eo_area_name", "i.area_name")}) AS place, i.institution_id
  FROM without_id r JOIN institutions i ON i.edrpou = r.eo_edrpou AND i.institution_name = r.eo_name WHERE r.eo_edrpou <> 'null'
),
by_place AS (
  SELECT r.*, 20 AS place, i.institution_id
  FROM without_id r JOIN institutions i ON i.institution_name = r.eo_name AND i.reg_name = r.eo_reg_name
  WHERE (r.eo_edrpou = 'null' OR r.eo_edrpou IS NULL)
    AND list_contains(['null', i.area_name], r.eo_area_name) AND list_contains(['null', i.ter_name], r.eo_ter_name)
),
matches AS MATERIALIZED (
  SELECT {", ".join(_REFERENCE)}, min(struct_pack(place := place, id := institution_id)).id AS institution_id
  FROM (FROM by_id UNION ALL FROM by_code UNION ALL FROM by_place) GROUP BY {", ".join(_REFERENCE)}
)"""

_SAME_REFERENCE = " AND ".join(
    f"s.{c} IS NOT DISTINCT FROM m.{c}"
    for c in ("eo_edeboid", "eo_edrpou", "eo_name", "eo_reg_name", "eo_area_name", "eo_ter_name")
)

_PARTICIPANTS = f"""participants AS MATERIALIZED (
  SELECT DISTINCT ON (out_id) lower(trim(s.outid)) AS out_id, CAST(nullif(s.birth, 'null') AS SMALLINT) AS birth_year,
         nullif(s.sex_type_name, 'null') AS gender, nullif(s.reg_type_name, 'null') AS participant_status,
         nullif(s.ter_type_name, 'null') AS ter_type, nullif(s.reg_name, 'null') AS reg_name,
         nullif(s.area_name, 'null') AS area_name, nullif(s.ter_name, 'null') AS ter_name, m.institution_id
  FROM staging s LEFT JOIN matches m ON {_SAME_REFERENCE}
  WHERE s.outid <> 'null'
  ORDER BY out_id, birth_year NULLS FIRST, gender NULLS FIRST, participant_status NULLS FIRST, ter_type NULLS FIRST,
           reg_name NULLS FIRST, area_name NULLS FIRST, ter_name NULLS FIRST, s.eo_edeboid NULLS FIRST, s.eo_edrpou NULLS FIRST,
           s.eo_name NULLS FIRST, s.eo_reg_name NULLS FIRST, s.eo_area_name NULLS FIRST, s.eo_ter_name NULLS FIRST
)"""


def _exam_results() -> str:
    parts = []
    for s in SUBJECTS:
        language = text(s.language) if s.language else value_or_null(f"{s.prefix}_lang")
        parts.append(
            f"  SELECT outid, test_date AS day, pt_reg_name, pt_area_name, pt_ter_name, '{s.code}' AS subject_code, "
            f"{language} AS exam_lang, {value_or_null(s.prefix + '_status')} AS status, "
            f"{value_or_null(s.prefix + '_ball')} AS raw_text, {value_or_null(s.prefix + '_ball100')} AS scaled_text FROM staging"
        )
    stacked = "\n  UNION ALL\n".join(parts)
    fields = ", ".join(
        f"coalesce(CAST({c} AS VARCHAR), '-')"
        for c in ("out_id", "subject_code", "test_date", "exam_lang", "status", "raw_score", "scaled_score", "is_present",
                  "pt_reg_name", "pt_area_name", "pt_ter_name")
    )
    return f"""long AS (
{stacked}
),
results AS (
  SELECT lower(trim(outid)) AS out_id, subject_code, CAST(strptime(nullif(day, 'null'), '%d.%m.%Y') AS DATE) AS test_date,
         exam_lang, status,
         CAST(trim(replace(raw_text, ',', '.')) AS DECIMAL(5,2)) AS raw_score,
         CAST(trim(replace(scaled_text, ',', '.')) AS DECIMAL(5,2)) AS scaled_score,
         NOT (status ILIKE '{fv.ABSENT_PATTERN}') AS is_present,
         nullif(pt_reg_name, 'null') AS pt_reg_name, nullif(pt_area_name, 'null') AS pt_area_name,
         nullif(pt_ter_name, 'null') AS pt_ter_name
  FROM long WHERE status IS NOT NULL OR scaled_text IS NOT NULL
),
keyed AS (SELECT *, concat_ws('|', {fields}) AS k FROM results),
exam_results AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(k), k) AS result_id, * EXCLUDE (k) FROM keyed)"""


def _subjects() -> str:
    rows = ", ".join(f"({text(s.code)}, {text(s.name)}, {str(s.mandatory).upper()})" for s in SUBJECTS)
    return f"subjects(subject_code, subject_name, is_mandatory) AS (VALUES {rows})"


# --- marts -------------------------------------------------------------------

def _bare(column: str) -> str:
    """A place name without its town mark."""
    return f"trim(regexp_replace({column}, '^м\\.\\s*', ''))"


def _centre_places() -> str:
    rows = [("region", name, None) for name in fv.CAPITAL_REGION_SPELLINGS]
    rows += [("district", name, None) for name in fv.CENTRE_DISTRICTS]
    rows += [("town", name, None) for name in fv.CENTRE_TOWNS]
    rows.append(("town", fv.AMBIGUOUS_TOWN, fv.AMBIGUOUS_TOWN_REGION))
    return ", ".join(f"({text(level)}, {text(name)}, {text(region) if region else 'NULL'})" for level, name, region in rows)


# Which institutions lie in a regional centre, from a table of places by level.
_CENTRAL = f"""centre_places(level, place, region) AS (VALUES {_centre_places()}),
named_places AS (
  SELECT institution_id, 'region' AS level, reg_name AS place, reg_name FROM institutions
  UNION ALL SELECT institution_id, 'district', {_bare("area_name")}, reg_name FROM institutions
  UNION ALL SELECT institution_id, 'town', {_bare("ter_name")}, reg_name FROM institutions WHERE ter_name ILIKE 'м.%'
),
central AS MATERIALIZED (
  SELECT DISTINCT institution_id, TRUE AS is_regional_center FROM named_places JOIN centre_places USING (level, place)
  WHERE region IS NULL OR region = reg_name
)"""

_CLEAN = f"""clean AS MATERIALIZED (
  SELECT e.result_id, e.out_id, e.test_date, e.subject_code, e.raw_score, e.scaled_score, p.participant_status,
         coalesce(MAP {{'{fv.TERRITORY_ABROAD}': '{fv.LOCATION_ABROAD}', '{fv.TERRITORY_CITY}': '{fv.LOCATION_CITY}',
                       '{fv.TERRITORY_VILLAGE}': '{fv.LOCATION_VILLAGE}'}}[p.ter_type], '{fv.UNDEFINED}') AS macro_location,
         p.gender, i.institution_id, i.institution_name, i.institution_type, i.reg_name, i.area_name, i.ter_name,
         concat_ws(', ', i.reg_name, i.area_name, i.ter_name) AS full_institution_location,
         coalesce(c.is_regional_center, FALSE) AS is_regional_center
  FROM exam_results e JOIN participants p USING (out_id) LEFT JOIN institutions i USING (institution_id)
  LEFT JOIN central c USING (institution_id)
  WHERE e.is_present AND e.test_date IS NOT NULL AND e.scaled_score IS NOT NULL
)"""

_IS_MANDATORY = f"subject_code IN {listed(MANDATORY)}"

_PROFILES = f"""profiles AS MATERIALIZED (
  SELECT out_id, participant_status, macro_location, gender, institution_id, institution_name, institution_type,
         reg_name, area_name, ter_name, full_institution_location,
         CAST(max(scaled_score) FILTER (WHERE subject_code = 'Ukr') AS DOUBLE) AS score_ukr,
         CAST(max(scaled_score) FILTER (WHERE subject_code = 'Math') AS DOUBLE) AS score_math,
         CAST(max(scaled_score) FILTER (WHERE subject_code = 'Hist') AS DOUBLE) AS score_hist,
         {rounded(f"avg(CAST(scaled_score AS DOUBLE)) FILTER (WHERE {_IS_MANDATORY})", 2)} AS mandatory_avg_score,
         max(subject_code) FILTER (WHERE NOT {_IS_MANDATORY}) AS elective_subject,
         CAST(max(scaled_score) FILTER (WHERE NOT {_IS_MANDATORY}) AS DOUBLE) AS elective_score,
         {rounded("avg(CAST(scaled_score AS DOUBLE))", 2)} AS overall_avg_score,
         max(test_date) AS test_date, count(subject_code) AS total_subjects_completed,
         bool_or(scaled_score = 0) AS failed, bool_or(scaled_score = 0 AND {_IS_MANDATORY}) AS failed_mandatory
  FROM clean GROUP BY ALL
)"""


def _with(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


STAGING = [_staging()]
INSTITUTIONS = [*STAGING, _INSTITUTIONS]
PARTICIPANTS = [*INSTITUTIONS, _LOOKUP, _PARTICIPANTS]
EXAMS = [*STAGING, _exam_results()]
STAR = [*PARTICIPANTS, _exam_results(), _subjects()]
CLEAN = [*PARTICIPANTS, _exam_results(), _CENTRAL, _CLEAN]
PROFILES = [*CLEAN, _PROFILES]


# --- modules -----------------------------------------------------------------

_CURRENT = f"participant_status = '{fv.STATUS_CURRENT_YEAR}'"

# One select per measure of a session, joined on the date; neighbouring sessions by their number.
_PER_DAY = {
    "turnout": ", ".join(
        [
            "count(*) AS total_participants",
            *[
                f"{percent(hits(f'participant_status = {text(status)}'), 'count(*)', 1)} AS {name}_pct"
                for status, name in (
                    (fv.STATUS_CURRENT_YEAR, "current_year_graduates"),
                    (fv.STATUS_PREVIOUS_YEARS, "previous_year_graduates"),
                    (fv.STATUS_PENITENTIARY, "penitentiary_graduates"),
                )
            ],
        ]
    ),
    "overall": f"{rounded('avg(rating)', 2)} AS avg_scaled_score_overall, {rounded(quantile('rating', 0.5), 2)} AS median_scaled_score_overall",
    "losses": f"{percent(hits('failed'), 'count(*)', 2)} AS fail_rate_mandatory",
}

_DAYS = f"""person_days AS MATERIALIZED (
  SELECT out_id, participant_status, test_date, avg(CAST(scaled_score AS DOUBLE)) FILTER (WHERE {_IS_MANDATORY}) AS rating,
         count(*) FILTER (WHERE scaled_score = 0 AND {_IS_MANDATORY}) > 0 AS failed
  FROM clean GROUP BY ALL
),
{", ".join(f"{name} AS (SELECT test_date, {measures} FROM person_days GROUP BY test_date)" for name, measures in _PER_DAY.items())},
graduates AS (
  SELECT test_date, {rounded("avg(rating)", 2)} AS avg_score_current_year, {rounded(quantile("rating", 0.5), 2)} AS median_score_current_year
  FROM person_days WHERE {_CURRENT} GROUP BY test_date
),
numbered AS MATERIALIZED (
  SELECT *, (SELECT count(*) FROM turnout e WHERE e.test_date <= t.test_date) AS seq_session_number
  FROM turnout t JOIN overall USING (test_date) JOIN losses USING (test_date) LEFT JOIN graduates USING (test_date)
),
phases(month_number, session_phase) AS (VALUES {", ".join(f"({m}, {text(label)})" for m, label in fv.SESSION_PHASES.items())}),
weekdays(day_number, day_of_week) AS (VALUES {", ".join(f"({d}, {text(label)})" for d, label in fv.WEEKDAYS.items())}),
nearby AS (
  SELECT a.test_date, {rounded("avg(b.avg_score_current_year)", 2)} AS smoothed_avg_current_year
  FROM numbered a JOIN numbered b ON abs(a.seq_session_number - b.seq_session_number) <= 1 GROUP BY a.test_date
),
progress AS (
  SELECT a.test_date, {percent("sum(b.total_participants)", "(SELECT sum(total_participants) FROM numbered)", 1)} AS cume_progress
  FROM numbered a JOIN numbered b ON b.test_date <= a.test_date GROUP BY a.test_date
),
days AS MATERIALIZED (
  SELECT n.test_date, n.seq_session_number, session_phase, day_of_week, n.total_participants, n.current_year_graduates_pct,
         n.previous_year_graduates_pct, n.penitentiary_graduates_pct, n.avg_scaled_score_overall, n.avg_score_current_year,
         n.median_scaled_score_overall, n.median_score_current_year, n.fail_rate_mandatory,
         {rounded("n.avg_score_current_year - y.avg_score_current_year", 2)} AS day_over_day_delta_current_year,
         smoothed_avg_current_year, cume_progress
  FROM numbered n LEFT JOIN numbered y ON y.seq_session_number = n.seq_session_number - 1
  LEFT JOIN phases ON month_number = month(n.test_date) LEFT JOIN weekdays ON day_number = isodow(n.test_date)
  JOIN nearby w ON w.test_date = n.test_date JOIN progress p ON p.test_date = n.test_date
)"""


def _side(name: str, condition: str) -> str:
    """Figures of the centres or of everywhere else, by region."""
    return f"""{name} AS (
  SELECT reg_name, count(*) AS n, {rounded(quantile("rating", 0.5), 2)} AS median, {hits("rating >= 180")} AS top, {hits("failed")} AS lost,
         {percent(hits("rating >= 180"), "count(*)", 2)} AS top_share, {percent(hits("failed"), "count(*)", 2)} AS lost_share
  FROM residents WHERE {condition} GROUP BY reg_name
)"""


# Centres and the rest as two tables, joined on the region.
_REGIONS = f"""residents AS MATERIALIZED (
  SELECT reg_name, out_id, in_centre, avg(CAST(scaled_score AS DOUBLE)) AS rating, min(scaled_score) = 0 AS failed
  FROM (SELECT coalesce(MAP {{{text(fv.CAPITAL_AS_REGION)}: {text(fv.CAPITAL_HOME_REGION)}}}[reg_name], reg_name) AS reg_name, out_id,
               is_regional_center AS in_centre, scaled_score FROM clean WHERE reg_name IS NOT NULL)
  GROUP BY reg_name, out_id, in_centre
),
{_side("centre", "in_centre")},
{_side("rest", "NOT in_centre")},
both_sides AS (
  SELECT reg_name, c.* EXCLUDE (reg_name), r.n AS r_n, r.median AS r_median, r.top AS r_top, r.lost AS r_lost, r.top_share AS r_top_share,
         r.lost_share AS r_lost_share, coalesce(c.n, 0) + coalesce(r.n, 0) AS everyone, coalesce(c.top, 0) + coalesce(r.top, 0) AS all_top
  FROM centre c FULL JOIN rest r USING (reg_name)
),
quotients AS (
  SELECT *, {rounded("(top / n) / nullif(all_top / everyone, 0)", 2)} AS monopoly_lq_index FROM both_sides
),
regions AS MATERIALIZED (
  SELECT reg_name, everyone AS total_participants, coalesce(n, 0) AS center_participants, coalesce(r_n, 0) AS periphery_participants,
         {percent("coalesce(n, 0)", "everyone", 1)} AS center_participants_percentage,
         median AS median_center_score, r_median AS median_periphery_score, {rounded("median - r_median", 2)} AS delta_median,
         top_share AS center_high_achievers_percentage, r_top_share AS periphery_high_achievers_percentage, monopoly_lq_index,
         lost_share AS center_failed_percentage, r_lost_share AS periphery_failed_percentage,
         {rounded("(r_lost / r_n) / nullif(lost / n, 0)", 2)} AS fail_rate_ratio,
         CASE {" ".join(f"WHEN monopoly_lq_index >= {floor} THEN '{name}'" for floor, name in fv.REGION_CLASSES)}
              WHEN monopoly_lq_index IS NULL THEN '{fv.UNDEFINED}' ELSE '{fv.REGION_BALANCED}' END AS region_classification
  FROM quotients
)"""

_ANY_FAIL = "score_ukr = 0 OR score_math = 0 OR score_hist = 0"
_MEAN = "mandatory_avg_score"
_SPREAD = rounded(f"{quantile(_MEAN, 0.75)} - {quantile(_MEAN, 0.25)}", 2)
_HIGH_SHARE = percent(hits(f"{_MEAN} >= 180"), "count(*)", 2)
_FAIL_SHARE = percent(hits(_ANY_FAIL), "count(*)", 2)

_MACRO = f"""SELECT macro_location, count(*) AS total_students,
       {rounded(quantile(_MEAN, 0.25), 2)} AS mandatory_q1_score, {rounded(quantile(_MEAN, 0.5), 2)} AS mandatory_median_score,
       {rounded(quantile(_MEAN, 0.75), 2)} AS mandatory_q3_score, {_SPREAD} AS iqr,
       {_HIGH_SHARE} AS high_achievers_percentage, {_FAIL_SHARE} AS failed_percentage
FROM profiles WHERE macro_location <> '{fv.UNDEFINED}' GROUP BY macro_location"""

_TYPES = f"""SELECT institution_type, count(*) AS total_students,
       {rounded(quantile(_MEAN, 0.25), 2)} AS q1, {rounded(quantile(_MEAN, 0.5), 2)} AS median,
       {rounded(quantile(_MEAN, 0.75), 2)} AS q3, {_SPREAD} AS iqr,
       {_HIGH_SHARE} AS high_achievers_percentage, {_FAIL_SHARE} AS failed_percentage,
       {rounded(f"stddev_samp({_MEAN}) / nullif(avg({_MEAN}), 0)", 2)} AS coefficient_of_variation
FROM profiles WHERE macro_location = '{fv.LOCATION_VILLAGE}' AND institution_type IS NOT NULL
GROUP BY institution_type HAVING count(*) >= {fv.MIN_STUDENTS_PER_TYPE}"""

_SETTLED = "CAST({} AS DECIMAL(18,10))"
_SCHOOLS = f"""national AS (
  SELECT {_SETTLED.format(quantile(_MEAN, 0.5, f"macro_location = '{fv.LOCATION_VILLAGE}'"))} AS rural,
         {_SETTLED.format(quantile(_MEAN, 0.5, f"macro_location = '{fv.LOCATION_CITY}'"))} AS urban
  FROM profiles
),
schools AS (
  SELECT institution_id, institution_name, reg_name, institution_type, count(*) AS total_students,
         {quantile(_MEAN, 0.5)} AS mid, {_SETTLED.format("mid")} AS own,
         {_SPREAD} AS iqr, {_HIGH_SHARE} AS high_achievers_percentage, {_FAIL_SHARE} AS failed_percentage,
         CASE WHEN bool_or({_MEAN} >= 180) AND own < (SELECT rural FROM national) THEN '{fv.SCHOOL_POLARISED}'
              WHEN own > (SELECT urban FROM national) THEN '{fv.SCHOOL_FLAGSHIP}'
              ELSE '{fv.SCHOOL_TYPICAL}' END AS school_rank
  FROM profiles WHERE macro_location = '{fv.LOCATION_VILLAGE}' AND institution_id IS NOT NULL
  GROUP BY institution_id, institution_name, reg_name, institution_type HAVING count(*) >= {fv.MIN_STUDENTS_PER_SCHOOL}
)"""

_CUT = "(SELECT {} FROM cuts)"
_BOTTOM = f"{_MEAN} < {_CUT.format('q1')}"
_MIDDLE = f"{_MEAN} BETWEEN {_CUT.format('q1')} AND {_CUT.format('q3')}"
_TOP = f"{_MEAN} > {_CUT.format('q3')}"


def _cohort_share(condition: str) -> str:
    return percent(hits(condition), f"sum({hits(condition)}) OVER ()", 2)


_ELECTIVES = f"""cuts AS (
  SELECT {_SETTLED.format(quantile(_MEAN, 0.25))} AS q1, {_SETTLED.format(quantile(_MEAN, 0.75))} AS q3 FROM profiles
),
typed_profiles AS (
  SELECT elective_subject, elective_score, failed_mandatory, CAST({_MEAN} AS DECIMAL(18,10)) AS {_MEAN} FROM profiles
),
electives AS MATERIALIZED (
  SELECT elective_subject, count(*) AS total_candidates, {percent("count(*)", "sum(count(*)) OVER ()", 2)} AS election_share,
         {rounded("avg(elective_score)", 2)} AS elective_avg, {rounded(f"avg(CAST({_MEAN} AS DOUBLE))", 2)} AS mandatory_avg,
         {rounded(quantile("elective_score", 0.5), 2)} AS elective_median, {rounded(quantile(_MEAN, 0.5), 2)} AS mandatory_median,
         {rounded("elective_median - mandatory_median", 2)} AS median_delta,
         {_cohort_share(_BOTTOM)} AS share_of_all_q1_students, {_cohort_share(_MIDDLE)} AS share_of_all_q2_students,
         {_cohort_share(_TOP)} AS share_of_all_q3_students,
         {percent(hits("failed_mandatory"), "count(*)", 1)} AS mandatory_failed_prc,
         {percent(hits(f"{_MEAN} >= 180"), "count(*)", 1)} AS mandatory_high_achievers_prc,
         {percent(hits("elective_score = 0"), "count(*)", 1)} AS elective_subject_failed_prc,
         {percent(hits("elective_score >= 180"), "count(*)", 1)} AS elective_subject_high_achievers_prc
  FROM typed_profiles WHERE elective_subject IS NOT NULL GROUP BY elective_subject
)"""

_TYPED = f"""minds AS (
  SELECT gender, macro_location, elective_subject, elective_score, score_math AS stem, (score_ukr + score_hist) / 2 AS hum,
         CASE WHEN least(score_math, score_ukr, score_hist) = 0 OR greatest(stem, hum) < 130 THEN '{fv.ARCHETYPE_RISK}'
              WHEN least(stem, hum) >= 160 THEN '{fv.ARCHETYPE_UNIVERSAL}'
              WHEN round(stem - hum, 6) >= 15 AND stem >= 140 THEN '{fv.ARCHETYPE_STEM}'
              WHEN round(hum - stem, 6) >= 15 AND hum >= 140 THEN '{fv.ARCHETYPE_HUMANITIES}'
              ELSE '{fv.ARCHETYPE_BALANCED}' END AS archetype
  FROM profiles WHERE score_math IS NOT NULL AND score_ukr IS NOT NULL AND score_hist IS NOT NULL
),
archetypes AS MATERIALIZED (
  SELECT archetype, count(*) AS total_students, {percent("count(*)", "sum(count(*)) OVER ()", 1)} AS archetype_share,
         {rounded("avg(stem)", 1)} AS avg_stem_score, {rounded("avg(hum)", 1)} AS avg_humanities_score,
         {rounded("avg(stem - hum)", 1)} AS avg_asymmetry_delta,
         {percent(hits(f"gender = '{fv.WOMEN}'"), "count(*)", 1)} AS women_pct,
         {percent(hits(f"gender = '{fv.MEN}'"), "count(*)", 1)} AS men_pct,
         {percent(hits(f"macro_location = '{fv.LOCATION_VILLAGE}'"), "count(*)", 1)} AS rural_pct,
         {percent(hits(f"macro_location = '{fv.LOCATION_CITY}'"), "count(*)", 1)} AS city_pct,
         {percent(hits(f"macro_location = '{fv.LOCATION_ABROAD}'"), "count(*)", 1)} AS abroad_pct
  FROM minds GROUP BY archetype
),
choices AS MATERIALIZED (
  SELECT archetype, elective_subject, count(*) AS students_count,
         {percent("count(*)", "sum(count(*)) OVER (PARTITION BY archetype)", 2)} AS pct_within_archetype,
         dense_rank() OVER (PARTITION BY archetype ORDER BY count(*) DESC) AS subject_rank_in_archetype,
         {rounded("avg(elective_score)", 1)} AS avg_elective_score
  FROM minds WHERE elective_subject IS NOT NULL GROUP BY archetype, elective_subject
)"""

_DAY_TEXT = "strftime(test_date, '%Y-%m-%d')"

# --- quality -----------------------------------------------------------------


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _unique_parts() -> list[str]:
    parts = []
    for table, key in schemas.PRIMARY_KEYS.items():
        parts.append(
            f"SELECT '{table}' AS table_name, '{key}' AS rule, count(*) AS keys_checked, {hits('n > 1')} AS violations "
            f"FROM (SELECT {key}, count(*) AS n FROM {table} GROUP BY {key})"
        )
    return parts


def _foreign_key_parts() -> list[str]:
    return [
        f"SELECT '{child}' AS table_name, '{column} in {parent}' AS rule, count(*) AS violations FROM {child} c "
        f"WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{key} = c.{column})"
        for child, column, parent, key in schemas.FOREIGN_KEYS
    ]


def _rule(table: str, rule: str, condition: str) -> str:
    return f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS rows_checked, {hits(condition)} AS violations FROM {table}"


def _not_null_parts() -> list[str]:
    return [
        _rule(table, column, f"{column} IS NULL")
        for table, columns in schemas.REQUIRED.items()
        for column in columns
    ]


def _domain_parts() -> list[str]:
    parts = [
        _rule(table, f"{column} width", f"length({column}) > {width}")
        for table, widths in schemas.TEXT_WIDTHS.items()
        for column, width in widths.items()
    ]
    parts.append(_rule("participants", "out_id form", "TRY_CAST(out_id AS UUID) IS NULL"))
    parts += [
        _rule("staging", f"{c} score", f"{c} <> 'null' AND TRY_CAST(trim(replace({c}, ',', '.')) AS DECIMAL(5,2)) IS NULL")
        for c in STAGING_FIELDS
        if c.endswith(("_ball", "_ball100"))
    ]
    return parts


_RESOLUTION = f"""SELECT CASE WHEN m.institution_id IS NULL THEN 'unresolved' WHEN s.eo_edeboid <> 'null' THEN 'id'
            WHEN s.eo_edrpou <> 'null' THEN 'code and name' ELSE 'name and place' END AS resolved_by,
       CAST(sum(s.n) AS BIGINT) AS participants, count(*) AS distinct_references
FROM (SELECT eo_edeboid, eo_edrpou, eo_name, eo_reg_name, eo_area_name, eo_ter_name, count(*) AS n
      FROM staging WHERE eo_name <> 'null' GROUP BY ALL) s
LEFT JOIN matches m ON {_SAME_REFERENCE} GROUP BY 1"""

# --- results as published ----------------------------------------------------

_CLUSTERS = (
    "SELECT school_rank AS school_cluster, count(*) AS institutions_count, "
    "CAST(sum(total_students) AS BIGINT) AS total_graduates_covered, "
    f"{percent('count(*)', 'sum(count(*)) OVER ()', 2)} AS cluster_share_pct, "
    f"{rounded('avg(mid)', 2)} AS cluster_avg_median_score FROM schools GROUP BY school_rank"
)
_PUBLISHED = {
    "daily_sessions": "SELECT * FROM days",
    "regions": "SELECT * FROM regions",
    "macro_locations": _MACRO,
    "institution_types": _TYPES,
    "rural_schools": "SELECT * EXCLUDE (own) FROM schools",
    "school_clusters": _CLUSTERS,
    "elective_strategy": "SELECT * FROM electives",
    "archetype_profiles": "SELECT * FROM archetypes",
    "elective_choices": "SELECT * FROM choices",
}


def _empty_fields(statement: str) -> str:
    return f"SELECT count(*) AS n, CAST(coalesce(sum(len(regexp_extract_all(CAST(to_json(t) AS VARCHAR), ':null'))), 0) AS BIGINT) AS e FROM ({statement}) t"


_REGION_TEXT = "SELECT reg_name, " + ", ".join(
    f"CAST({c} AS VARCHAR) AS {c}" if scale is None else f"CAST(CAST({c} AS DECIMAL(18,{scale})) AS VARCHAR) AS {c}"
    for c, scale in {
        "total_participants": None, "center_participants": None, "periphery_participants": None, "center_participants_percentage": 1,
        "median_center_score": 2, "median_periphery_score": 2, "delta_median": 2, "center_high_achievers_percentage": 2,
        "periphery_high_achievers_percentage": 2, "monopoly_lq_index": 2, "center_failed_percentage": 2,
        "periphery_failed_percentage": 2, "fail_rate_ratio": 2, "region_classification": None,
    }.items()
) + " FROM regions"

# A delivery with faults: what is wrong with each row, parents first; a child may only refer to parents without a fault.


def _delivered(table: str) -> str:
    changed = [(c, deliveries.spoiled_column(table, c)) for c in dict.fromkeys(f[0] for f in deliveries.FAULTS.get(table, []))]
    if table == "subjects":
        literal = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else text(v)
        values = ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in deliveries.FURTHER_SUBJECTS)
        return f"SELECT * FROM subjects UNION ALL SELECT * FROM (VALUES {values})"
    return f"SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in changed)}) FROM {table}"


def _faults(table: str) -> dict[str, str]:
    if table == "staging":
        fields = [f"{s.prefix}_{part}" for s in SUBJECTS for part in ("ball100", "ball")]
        return {f"{c} score": f"{c} <> 'null' AND TRY_CAST(trim(replace({c}, ',', '.')) AS DECIMAL(5,2)) IS NULL" for c in fields}
    key = schemas.PRIMARY_KEYS[table]
    found = {f"{key} unique": f"{key} IS NOT NULL AND count(*) OVER (PARTITION BY {key}) > 1"}
    for child, column, parent, parent_key in schemas.FOREIGN_KEYS:
        if child == table:
            found[f"{column} in {parent}"] = f"{column} IS NOT NULL AND {column} NOT IN (SELECT {parent_key} FROM {parent}_sound)"
    found |= {f"{c} required": f"{c} IS NULL" for c in schemas.REQUIRED[table]}
    found |= {f"{c} width": f"length({c}) > {width}" for c, width in schemas.TEXT_WIDTHS[table].items()}
    if table == "participants":
        found["out_id form"] = "TRY_CAST(out_id AS UUID) IS NULL AND out_id IS NOT NULL"
    return found


_DELIVERED = ("staging", "subjects", "institutions", "participants", "exam_results")


def _judged_parts() -> list[str]:
    parts = []
    for t in _DELIVERED:
        listed_faults = ", ".join(f"CASE WHEN {condition} THEN {text(rule)} END" for rule, condition in _faults(t).items())
        parts.append(f"{t}_given AS MATERIALIZED ({_delivered(t)})")
        parts.append(f"{t}_judged AS MATERIALIZED (SELECT *, list_sort(list_filter([{listed_faults}], lambda f: f IS NOT NULL)) AS faults FROM {t}_given)")
        parts.append(f"{t}_sound AS MATERIALIZED (SELECT * FROM {t}_judged WHERE len(faults) = 0)")
    return parts


def _judged_rules() -> str:
    return _union([
        f"SELECT '{t}' AS table_name, {text(rule)} AS rule, count(*) AS rows_checked, "
        + hits("len(faults) > 0" if rule == "any rule" else f"list_contains(faults, {text(rule)})")
        + f" AS violations FROM {t}_judged"
        for t in _DELIVERED
        for rule in [*_faults(t), "any rule"]
    ])


_SET_ASIDE = _union([
    f"SELECT '{t}' AS table_name, array_to_string(faults, '; ') AS rules, count(*) AS row_count FROM {t}_judged WHERE len(faults) > 0 GROUP BY 2"
    for t in _DELIVERED
])

# Requests whose answer may be ambiguous: every pair of a request and a branch that fits, then the best place.


def _stated(kind: str) -> str:
    """Place a request names: nothing, the first place, another branch's, or one that no branch has."""
    k = "o_orderkey % 20"
    first, third, nowhere = ([0, 1, 2, 3, 4, 12, 13, 14, 19], [11, 17], [5, 6, 7, 18]) if kind == "Town" else ([0, 1, 2, 5, 8, 12, 13, 15, 19], [11, 17], [3, 6, 9, 18])
    within = lambda ks: "(" + ", ".join(map(str, ks)) + ")"
    return f"CASE WHEN {k} IN {within(first)} THEN '{kind} A' WHEN {k} IN {within(third)} THEN '{kind} B' WHEN {k} IN {within(nowhere)} THEN '{kind} X' ELSE 'null' END"


_ASKED = f"""branches AS (
  SELECT c_custkey + 1 AS id, 'E' || c_custkey AS edebo, 'R' || (c_custkey // 4) AS code, 'School ' || (c_custkey // 4) AS school,
         'Region ' || (c_custkey // 4 % 5) AS region, 'District ' || ['A', 'A', 'B', NULL][c_custkey % 4 + 1] AS district,
         'Town ' || ['A', 'A', 'B', NULL][c_custkey % 4 + 1] AS town FROM customer
),
asked AS (
  SELECT CASE o_orderkey % 20 WHEN 0 THEN 'E' || o_custkey WHEN 1 THEN 'E?' ELSE 'null' END AS eo_edeboid,
         CASE WHEN o_orderkey % 20 BETWEEN 2 AND 11 THEN 'R' || (o_custkey // 4) WHEN o_orderkey % 20 = 12 THEN 'R?' ELSE 'null' END AS eo_edrpou,
         'School ' || (o_custkey // 4) AS eo_name, 'Region ' || (CASE WHEN o_orderkey % 20 = 19 THEN '?' ELSE (o_custkey // 4 % 5)::VARCHAR END) AS eo_reg_name,
         {_stated("District")} AS eo_area_name, {_stated("Town")} AS eo_ter_name
  FROM orders
),
asked_once AS (SELECT *, count(*) AS n FROM asked GROUP BY ALL),
fits AS (
  SELECT a.*, b.id, CASE
    WHEN a.eo_edeboid = b.edebo THEN 0
    WHEN a.eo_edrpou = b.code THEN 1 + 3 * ({_closeness("a.eo_ter_name", "b.town")}) + ({_closeness("a.eo_area_name", "b.district")})
    WHEN a.eo_area_name <> 'null' AND a.eo_ter_name <> 'null' THEN 10 WHEN a.eo_ter_name <> 'null' THEN 11
    WHEN a.eo_area_name <> 'null' THEN 12 ELSE 13 END AS tier
  FROM asked_once a JOIN branches b ON a.eo_edeboid = b.edebo
    OR (a.eo_edeboid = 'null' AND a.eo_edrpou = b.code AND a.eo_name = b.school)
    OR (a.eo_edeboid = 'null' AND a.eo_edrpou = 'null' AND a.eo_name = b.school AND a.eo_reg_name = b.region
        AND list_contains(['null', b.district], a.eo_area_name) AND list_contains(['null', b.town], a.eo_ter_name))
),
answers AS (
  SELECT {", ".join(_REFERENCE)}, tier, count(*) AS candidates, min(id) AS institution_id
  FROM (FROM fits QUALIFY tier = min(tier) OVER (PARTITION BY {", ".join(_REFERENCE)})) GROUP BY ALL
)"""

_FINISHED = hits("o_orderstatus = 'F'")

_STAR_COLUMNS = (
    "institution_id, edebo_id, edrpou, institution_name, institution_type, reg_name, area_name, ter_name, parent_governance"
)

STATEMENTS: dict[str, str] = {
    "etl_staging": _with(*STAGING, select="SELECT * FROM staging"),
    "etl_subjects": _with(
        *EXAMS, _subjects(),
        select="SELECT s.*, count(e.subject_code) AS result_count, count(*) FILTER (WHERE e.is_present) AS attended_count "
        "FROM subjects s LEFT JOIN exam_results e USING (subject_code) GROUP BY ALL",
    ),
    "etl_institutions": _with(*INSTITUTIONS, select=f"SELECT {_STAR_COLUMNS} FROM institutions"),
    "etl_participants": _with(
        *PARTICIPANTS, select="SELECT * REPLACE (CAST(birth_year AS BIGINT) AS birth_year) FROM participants"
    ),
    "etl_exam_results": _with(
        *EXAMS,
        select=f"SELECT * REPLACE ({_DAY_TEXT} AS test_date, CAST(raw_score AS DOUBLE) AS raw_score, "
        "CAST(scaled_score AS DOUBLE) AS scaled_score) FROM exam_results",
    ),
    "csv_raw_file": _with(*STAGING, select="SELECT * FROM staging"),
    "csv_result_export": _with(
        *PROFILES,
        select="SELECT macro_location, CAST(total_students AS VARCHAR) AS total_students, "
        + ", ".join(
            f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR) AS {c}"
            for c in ("mandatory_q1_score", "mandatory_median_score", "mandatory_q3_score", "iqr",
                      "high_achievers_percentage", "failed_percentage")
        )
        + f" FROM ({_MACRO})",
    ),
    "csv_regions_export": _with(*CLEAN, _REGIONS, select=_REGION_TEXT),
    "csv_raw_to_results": _with(
        *PROFILES, _DAYS, _REGIONS, _SCHOOLS, _ELECTIVES, _TYPED,
        select=_union([f"SELECT '{name}' AS result, n AS row_count, e AS empty_fields FROM ({_empty_fields(sql)})" for name, sql in _PUBLISHED.items()]),
    ),
    "sql_region_subjects": _with(
        *PROFILES,
        select="SELECT e.*, s.* EXCLUDE (region) FROM (SELECT reg_name, subject_code, count(*) AS results, "
        f"{rounded('avg(CAST(scaled_score AS DOUBLE))', 2)} AS mean_score FROM clean GROUP BY ALL) e "
        f"JOIN (SELECT reg_name AS region, count(*) AS students, {hits('failed')} AS failed_students, count(elective_subject) AS with_elective "
        "FROM profiles GROUP BY reg_name) s ON e.reg_name IS NOT DISTINCT FROM s.region",
    ),
    "sql_result_sizes": _with(
        *PROFILES, _DAYS, _REGIONS, _SCHOOLS, _ELECTIVES, _TYPED,
        select=_union([f"SELECT '{name}' AS result, count(*) AS row_count FROM ({sql})" for name, sql in _PUBLISHED.items()]),
    ),
    "mart_clean_exam_results": _with(
        *CLEAN,
        select=f"SELECT * REPLACE ({_DAY_TEXT} AS test_date, CAST(raw_score AS DOUBLE) AS raw_score, "
        "CAST(scaled_score AS DOUBLE) AS scaled_score) FROM clean",
    ),
    "mart_student_profiles": _with(*PROFILES, select=f"SELECT * REPLACE ({_DAY_TEXT} AS test_date) FROM profiles"),
    "m1_daily_sessions": _with(*CLEAN, _DAYS, select=f"SELECT * REPLACE ({_DAY_TEXT} AS test_date) FROM days"),
    "m2_regions": _with(*CLEAN, _REGIONS, select="SELECT * FROM regions"),
    "m3_macro": _with(*PROFILES, select=_MACRO),
    "m3_types": _with(*PROFILES, select=_TYPES),
    "m3_schools": _with(
        *PROFILES, _SCHOOLS,
        select=f"SELECT * EXCLUDE (mid, own), {rounded('mid', 2)} AS mandatory_median_score FROM schools",
    ),
    "m3_clusters": _with(
        *PROFILES, _SCHOOLS,
        select="SELECT school_rank AS school_cluster, count(*) AS institutions_count, "
        "CAST(sum(total_students) AS BIGINT) AS total_graduates_covered, "
        f"{percent('count(*)', 'sum(count(*)) OVER ()', 2)} AS cluster_share_pct, "
        f"{rounded('avg(mid)', 2)} AS cluster_avg_median_score FROM schools GROUP BY school_rank",
    ),
    "m4_electives": _with(*PROFILES, _ELECTIVES, select="SELECT * FROM electives"),
    "m5_archetypes": _with(*PROFILES, _TYPED, select="SELECT * FROM archetypes"),
    "m5_choices": _with(*PROFILES, _TYPED, select="SELECT * FROM choices"),
    "s_day_volatility": _with(
        *CLEAN, _DAYS,
        select=f"SELECT year(test_date) AS session_year, count(*) AS sessions, {rounded('stddev_samp(day_over_day_delta_current_year)', 4)} AS delta_stddev, "
        "min(day_over_day_delta_current_year) AS delta_min, max(day_over_day_delta_current_year) AS delta_max, "
        f"{rounded('regr_slope(avg_score_current_year, seq_session_number)', 4)} AS score_trend, "
        f"{rounded('corr(total_participants, avg_score_current_year)', 4)} AS load_score_correlation "
        "FROM days WHERE month(test_date) = 6 GROUP BY 1",
    ),
    "s_weekly_fail": _with(
        *CLEAN, _DAYS,
        select=f"SELECT isoyear(test_date) AS iso_year, weekofyear(test_date) AS iso_week, count(*) AS sessions, {rounded('avg(fail_rate_mandatory)', 4)} "
        "AS mean_fail_rate FROM days WHERE month(test_date) = 6 GROUP BY ALL",
    ),
    "s_day_clusters": _with(
        *CLEAN, _DAYS,
        select=f"SELECT CASE WHEN {_DAY_TEXT} IN {listed(fv.LANGUAGE_DAYS)} THEN 'language' ELSE 'mass' END AS day_cluster, "
        f"count(*) AS sessions, {rounded('avg(total_participants)', 4)} AS mean_participants, "
        f"{rounded('avg(avg_score_current_year)', 4)} AS mean_score_current_year, "
        f"{rounded('avg(median_score_current_year)', 4)} AS mean_median_current_year, "
        f"{rounded('avg(fail_rate_mandatory)', 4)} AS mean_fail_rate FROM days "
        f"WHERE {_DAY_TEXT} IN {listed([*fv.LANGUAGE_DAYS, *fv.MASS_DAYS])} GROUP BY 1",
    ),
    "s_region_summary": _with(
        *CLEAN, _REGIONS,
        select=f"SELECT count(*) AS regions, {rounded('avg(monopoly_lq_index)', 4)} AS mean_lq, "
        f"{hits('monopoly_lq_index > 1')} AS regions_above_one, {hits('monopoly_lq_index >= 1.4')} AS regions_centralised, "
        f"{rounded('avg(delta_median)', 4)} AS mean_delta_median, {rounded('avg(fail_rate_ratio)', 4)} AS mean_fail_rate_ratio, "
        f"{rounded('corr(delta_median, fail_rate_ratio)', 4)} AS gap_ratio_correlation "
        "FROM regions WHERE monopoly_lq_index IS NOT NULL",
    ),
    "s_ratios": _with(
        *PROFILES, _DAYS, _ELECTIVES, _TYPED,
        select=_union([
            "SELECT 'first_month_participants' AS statistic, CAST(sum(total_participants) AS DOUBLE) AS value "
            "FROM days WHERE month(test_date) = 5 AND year(test_date) = (SELECT max(year(test_date)) FROM days)",
            f"SELECT 'humanities_per_stem', {rounded(f'''sum(total_students) FILTER (WHERE archetype = '{fv.ARCHETYPE_HUMANITIES}') / sum(total_students) FILTER (WHERE archetype = '{fv.ARCHETYPE_STEM}')''', 4)} FROM archetypes",
            f"SELECT 'weakest_quarter_in_refuge_electives', {rounded('sum(share_of_all_q1_students)', 2)} FROM electives "
            f"WHERE elective_subject IN {listed(fv.REFUGE_ELECTIVES)}",
            f"SELECT 'stem_students_outside_stem_electives', {rounded('100 - coalesce(sum(pct_within_archetype), 0)', 2)} FROM choices "
            f"WHERE archetype = '{fv.ARCHETYPE_STEM}' AND elective_subject IN {listed(fv.STEM_ELECTIVES)}",
        ]),
    ),
    "dq_unique": _with(*STAR, select=_union(_unique_parts())),
    "dq_foreign_key": _with(*STAR, select=_union(_foreign_key_parts())),
    "dq_not_null": _with(*STAR, select=_union(_not_null_parts())),
    "dq_domain": _with(*STAR, select=_union(_domain_parts())),
    "dq_unresolved": _with(*INSTITUTIONS, _LOOKUP, select=_RESOLUTION),
    "dq_quarantine": _with(*STAR, *_judged_parts(), select=_judged_rules()),
    "dq_quarantined_rows": _with(*STAR, *_judged_parts(), select=_SET_ASIDE),
    "lookup_ambiguity": _with(
        _ASKED,
        select="SELECT coalesce(tier, -1)::BIGINT AS tier, sum(q.n)::BIGINT AS requests, count(*) AS distinct_references, "
        "count(*) FILTER (WHERE candidates > 1) AS ambiguous_references, coalesce(sum(candidates), 0)::BIGINT AS candidates, "
        f"coalesce(sum(institution_id), 0)::BIGINT AS sum_of_ids FROM asked_once q LEFT JOIN answers USING ({', '.join(_REFERENCE)}) GROUP BY 1",
    ),
    "lookup_resolved": _with(_ASKED, select=f"SELECT {', '.join(_REFERENCE)}, institution_id, tier::BIGINT AS tier FROM answers"),
    "first_per_key_latest_order": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, "
    "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders "
    "ORDER BY o_custkey, orders.o_orderdate DESC NULLS LAST, o_orderkey",
    "percentile_by_group": "SELECT l_returnflag, count(*) AS line_count, "
    + ", ".join(
        f"{rounded(quantile('l_extendedprice', p), 2)} AS {name}"
        for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )
    + " FROM lineitem GROUP BY l_returnflag",
    "percentile_filtered": f"SELECT l_linestatus, {rounded(quantile('l_extendedprice', 0.5), 2)} AS median_price, "
    f"{rounded(quantile('l_extendedprice', 0.5, 'l_discount >= 0.05'), 2)} AS median_discounted_price "
    "FROM lineitem GROUP BY l_linestatus",
    "cv_iqr": f"SELECT l_returnflag, l_linestatus, {rounded('avg(l_quantity)', 2)} AS mean_quantity, "
    f"{rounded('stddev_samp(l_quantity) / avg(l_quantity)', 4)} AS coefficient_of_variation, "
    f"{rounded(quantile('l_quantity', 0.75) + ' - ' + quantile('l_quantity', 0.25), 2)} AS iqr "
    "FROM lineitem GROUP BY ALL",
    "share_of_total": "SELECT o_orderpriority, count(*) AS order_count, "
    f"{percent('count(*)', 'sum(count(*)) OVER ()', 2)} AS order_share, "
    + percent(hits("o_orderstatus = 'F'"), f"sum({_FINISHED}) OVER ()", 2)
    + " AS finished_share FROM orders GROUP BY o_orderpriority",
    "share_within_rank": "SELECT o_orderpriority, o_orderstatus, count(*) AS order_count, "
    f"{percent('count(*)', 'sum(count(*)) OVER (PARTITION BY o_orderpriority)', 2)} AS share_within, "
    "dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC) AS rank_within FROM orders "
    "GROUP BY o_orderpriority, o_orderstatus",
    "sequence_daily_events": "WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS event_count, "
    f"{rounded('avg(value)', 2)} AS mean_value FROM events GROUP BY day) "
    "SELECT strftime(day, '%Y-%m-%d') AS event_date, row_number() OVER w AS day_number, event_count, mean_value, "
    f"{rounded('mean_value - lag(mean_value) OVER w', 2)} AS delta_value, "
    f"{rounded('avg(mean_value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 2)} AS smoothed_value, "
    f"{percent('sum(event_count) OVER w', 'sum(event_count) OVER ()', 1)} AS cumulative_share "
    "FROM d WINDOW w AS (ORDER BY day)",
    "sequence_event_instants": "WITH d AS (SELECT ts, count(*) AS event_count, "
    f"{rounded('avg(value)', 2)} AS mean_value FROM events GROUP BY ts) "
    "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS instant, row_number() OVER w AS instant_number, event_count, mean_value, "
    f"{rounded('mean_value - lag(mean_value) OVER w', 2)} AS delta_value, "
    f"{rounded('avg(mean_value) OVER (w ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)', 2)} AS smoothed_value, "
    f"{percent('sum(event_count) OVER w', 'sum(event_count) OVER ()', 4)} AS cumulative_share "
    "FROM d WINDOW w AS (ORDER BY ts)",
    "share_rank_prices": "SELECT o_orderstatus, o_totalprice, count(*) AS order_count, "
    "dense_rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC) AS rank_within, "
    f"{percent('count(*)', 'sum(count(*)) OVER (PARTITION BY o_orderstatus)', 4)} AS share_within "
    "FROM orders GROUP BY o_orderstatus, o_totalprice",
    "location_quotient": "WITH s AS (SELECT CAST(c_nationkey AS BIGINT) AS c_nationkey, count(*) AS total_orders, "
    "count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS segment_orders, "
    "count(*) FILTER (WHERE o_totalprice >= 400000) AS total_large, "
    "count(*) FILTER (WHERE o_totalprice >= 400000 AND c_mktsegment = 'BUILDING') AS segment_large "
    "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY customer.c_nationkey) SELECT *, "
    f"{rounded('segment_large * total_orders / nullif(total_large * segment_orders, 0)', 4)} AS quotient FROM s",
    "quartile_cohorts": "WITH p AS (SELECT o_orderpriority, o_totalprice AS price FROM orders), "
    f"b AS (SELECT {quantile('price', 0.25)} AS q1, {quantile('price', 0.75)} AS q3 FROM p) "
    "SELECT o_orderpriority, count(*) FILTER (WHERE price < (SELECT q1 FROM b)) AS below, "
    "count(*) FILTER (WHERE price BETWEEN (SELECT q1 FROM b) AND (SELECT q3 FROM b)) AS inside, "
    "count(*) FILTER (WHERE price > (SELECT q3 FROM b)) AS above FROM p GROUP BY o_orderpriority",
    "any_where_flags": "SELECT o_custkey, bool_or(o_orderstatus = 'P') AS has_pending, "
    "bool_or(o_totalprice >= 400000) AS has_large FROM orders GROUP BY o_custkey",
    "benchmark_compare": "WITH c AS (SELECT o_custkey, count(*) AS n, "
    f"{quantile('o_totalprice', 0.5)} AS own FROM orders GROUP BY o_custkey), "
    f"a AS (SELECT {quantile('o_totalprice', 0.5)} AS mid FROM orders), "
    "g AS (SELECT CASE WHEN own > (SELECT mid FROM a) THEN 'above' WHEN own < (SELECT mid FROM a) THEN 'below' ELSE 'at' END "
    "AS position, count(*) AS customers, CAST(sum(n) AS BIGINT) AS order_count FROM c GROUP BY 1) "
    f"SELECT *, {percent('customers', 'sum(customers) OVER ()', 2)} AS customer_share FROM g",
}
