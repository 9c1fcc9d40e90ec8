"""SQL counterparts of the registered queries, as text for DuckDB.

Each statement is put together from named common table expressions. They say the same
thing as the Spark plans in the plainest way (self joins, per-row windows), without any
of the care for scale.
"""

from __future__ import annotations

PARTS: dict[str, tuple[str, str]] = {}  # name -> (names it needs, body)
ORACLES: dict[str, str] = {}


def part(name: str, needs: str, body: str) -> None:
    PARTS[name] = (needs, body)


def oracle(name: str, needs: str, body: str) -> None:
    order: list[str] = []

    def visit(part_name: str) -> None:
        for need in PARTS[part_name][0].split():
            visit(need)
        if part_name not in order:
            order.append(part_name)

    for need in needs.split():
        visit(need)
    heads = ",\n".join(f"{p} AS ({PARTS[p][1].strip()})" for p in order)
    ORACLES[name] = f"WITH {heads}\n{body.strip()}" if heads else body.strip()


def r(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def i(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


def band_case(value: str, bands: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {cond.replace('x', value)} THEN '{label}'" for cond, label in bands) + " END"


FIVE = [(f"x >= {a} AND x < {a + 5}", f"[{a},{a + 5})") for a in range(15, 50, 5)]
MODEL = [("x > 0 AND x <= 24", "15-24"), ("x > 24 AND x <= 34", "25-34"), ("x > 34 AND x <= 49", "35-49")]
REPORT = [("x >= 15 AND x < 25", "15-24"), ("x >= 25 AND x < 35", "25-34"), ("x >= 35 AND x <= 50", "35-49")]
Z = "1.96"

# --- survey tables -----------------------------------------------------------------

part("survey", "", """
SELECT * FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS study_id, o_custkey AS id, o_orderkey AS key, o_orderstatus AS state,
    o_orderpriority AS priority, CAST(o_orderdate AS DATE) AS visit_date,
    CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS rnd,
    sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER s AS cum,
    row_number() OVER s AS ordinal,
    row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders
  WINDOW s AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE rn = 1""")

part("status_raw", "survey", """
SELECT study_id, rnd, visit_date,
  CASE WHEN state = 'P' THEN NULL
       WHEN cum >= 300000000 THEN CASE WHEN key % 7 = 0 THEN 'S' ELSE 'P' END
       WHEN id % 20 = 0 AND priority = '5-LOW' THEN 'P' ELSE 'N' END AS finalhiv
FROM survey""")

part("visits", "status_raw", """
SELECT study_id AS research_id, rnd AS round, finalhiv,
  CASE WHEN finalhiv = 'N' THEN 0 WHEN finalhiv IN ('P', 'S') THEN 1 END AS hivstatus,
  CAST(visit_date - DATE '1970-01-01' AS DOUBLE) AS visit_day, CAST(year(visit_date) AS INTEGER) AS year
FROM status_raw""")

part("verif", "survey", """
SELECT s.study_id AS research_id, s.rnd AS round,
  CASE WHEN s.rnd % 5 <> 0 THEN CASE WHEN c.c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END END AS sex,
  CAST(year(s.visit_date) - year(DATE '1945-01-01' + CAST((c.c_custkey * 37) % 14000 AS INTEGER)) AS INTEGER) AS ageyrs,
  CASE WHEN c.c_custkey % 50 <> 7 THEN CAST((c.c_custkey * 37) % 14000 + (DATE '1945-01-01' - DATE '1970-01-01') AS DOUBLE) END AS birth_day,
  CASE WHEN c.c_acctbal >= 0 THEN 1 ELSE 0 END AS resident
FROM survey s JOIN customer c ON c.c_custkey = s.id""")

part("quest", "survey", """
SELECT study_id AS research_id, rnd AS round,
  CASE WHEN priority = '1-URGENT' THEN 1 WHEN priority <> '2-HIGH' THEN 2 END AS arvmed,
  CASE WHEN key % 3 = 0 THEN 1 ELSE 2 END AS cuarvmed,
  CASE WHEN id % 25 = 0 AND ordinal = 7 THEN 0 WHEN priority = '3-MEDIUM' THEN NULL WHEN ordinal >= 5 THEN 1 ELSE 0 END AS circ,
  CASE WHEN key % 10 = 0 THEN 1 WHEN key % 10 = 1 THEN NULL WHEN key % 10 <= 3 THEN 0 ELSE 1 END AS eversex_clean,
  CAST(CASE WHEN key % 50 = 0 THEN 97 ELSE 8 + key % 20 END AS INTEGER) AS ag1stsex
FROM survey""")

# --- panel -------------------------------------------------------------------------

part("round_days", "visits", "SELECT round, avg(visit_day) AS mean_day FROM visits GROUP BY round")

part("completed", "visits", """
SELECT b.research_id, b.round, v.research_id IS NOT NULL AS visited, v.hivstatus, v.visit_day, v.year
FROM (SELECT research_id, CAST(unnest(range(lo, hi + 1)) AS INTEGER) AS round
      FROM (SELECT research_id, min(round) AS lo, max(round) AS hi FROM visits GROUP BY research_id)) b
LEFT JOIN visits v ON v.research_id = b.research_id AND v.round = b.round""")


def imputation(source: str, value: str, out: str) -> str:
    """Value where the last one before and the first one after a row agree."""
    return f"""
SELECT *, CASE WHEN dn = up THEN dn END AS {out} FROM (
  SELECT *,
    last_value({value} IGNORE NULLS) OVER (PARTITION BY research_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dn,
    first_value({value} IGNORE NULLS) OVER (PARTITION BY research_id ORDER BY round ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS up
  FROM {source})"""


def both_ways(value: str) -> str:
    return f"""coalesce(
    last_value({value} IGNORE NULLS) OVER (PARTITION BY research_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value({value} IGNORE NULLS) OVER (PARTITION BY research_id ORDER BY round ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


part("between_rows", "completed", imputation("completed", "hivstatus", "hivstatus_imputed"))

part("imputed", "between_rows round_days", """
SELECT b.research_id, b.round, b.hivstatus, b.hivstatus_imputed, coalesce(b.visit_day, d.mean_day) AS visit_day,
  coalesce(b.year, CAST(year(DATE '1970-01-01' + CAST(floor(d.mean_day) AS INTEGER)) AS INTEGER)) AS year
FROM between_rows b LEFT JOIN round_days d ON d.round = b.round""")

part("subjects", "imputed", """
SELECT *, CASE
    WHEN first_neg IS NULL AND first_pos IS NULL THEN 'No Testing'
    WHEN first_neg IS NULL THEN 'serially positive'
    WHEN first_pos IS NOT NULL THEN 'Seroconversion'
    WHEN first_neg <> last_neg THEN 'Serially negative' ELSE 'One test negative' END AS cohortclass
FROM (SELECT research_id,
    min(CASE WHEN hivstatus_imputed = 0 THEN round END) AS first_neg,
    max(CASE WHEN hivstatus_imputed = 0 THEN round END) AS last_neg,
    min(CASE WHEN hivstatus_imputed = 1 THEN round END) AS first_pos
  FROM imputed GROUP BY research_id)""")

part("drawn", "subjects", """
SELECT *, CASE WHEN cohortclass = 'Seroconversion' THEN
    CAST(last_neg + 1 + CAST('0x' || substr(md5(research_id || '|1984'), 1, 8) AS BIGINT) % (first_pos - last_neg) AS INTEGER) END AS seroconv_imp
FROM subjects WHERE NOT (first_neg IS NOT NULL AND first_pos IS NOT NULL AND first_pos <= last_neg)""")

part("coded", "imputed drawn", """
SELECT p.*, s.first_neg, s.last_neg, s.first_pos, s.cohortclass, s.seroconv_imp,
  CASE WHEN s.cohortclass = 'Serially negative' THEN p.hivstatus_imputed
       WHEN s.cohortclass = 'Seroconversion' AND p.round = s.seroconv_imp THEN 1
       WHEN s.cohortclass = 'Seroconversion' AND p.round < s.seroconv_imp THEN 0 END AS hivinc
FROM imputed p LEFT JOIN drawn s ON s.research_id = p.research_id""")

part("timed", "coded", """
SELECT *, CASE WHEN hivinc IN (0, 1) THEN
  (visit_day - lag(visit_day) OVER (PARTITION BY research_id ORDER BY visit_day ASC NULLS LAST, round)) / 365.25 END AS py
FROM coded""")

part("joined", "timed verif quest", """
SELECT t.*, v.sex AS sex0, v.ageyrs, v.birth_day AS birth0, v.resident, q.circ, q.eversex_clean,
  CASE WHEN q.arvmed = 1 THEN 1 ELSE 0 END AS onART,
  CASE WHEN q.ag1stsex BETWEEN 10 AND 96 THEN q.ag1stsex END AS ag1stsex_clean
FROM timed t
LEFT JOIN verif v ON v.research_id = t.research_id AND v.round = t.round
LEFT JOIN quest q ON q.research_id = t.research_id AND q.round = t.round""")

part("joined_sex", "joined", f"""
SELECT *, {both_ways('sex0')} AS sex, {both_ways('birth0')} AS birth_day, {both_ways('resident')} AS resident_imputed FROM joined""")
part("with_circ", "joined_sex", imputation("joined_sex", "circ", "circ_imputed").replace("SELECT *, CASE", "SELECT * EXCLUDE (dn, up), CASE", 1))
part("with_ever", "with_circ", imputation("with_circ", "eversex_clean", "eversex_clean_imputed").replace("SELECT *, CASE", "SELECT * EXCLUDE (dn, up), CASE", 1))
part("with_lag", "with_ever", "SELECT *, lag(circ_imputed) OVER (PARTITION BY research_id ORDER BY round) AS circ_lag FROM with_ever")
part("demo", "with_lag", """
SELECT *,
  CASE WHEN max(CASE WHEN circ_lag = 1 AND circ_imputed = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY research_id) = 0 THEN circ_imputed END AS circ_imputed_fix,
  coalesce(CAST(floor((visit_day - birth_day) / 365.25) AS INTEGER), ageyrs) AS ageyrs2
FROM with_lag""")
part("panel", "demo", f"""
SELECT *, {band_case('ageyrs2', FIVE)} AS agecat, {band_case('ageyrs2', MODEL)} AS agecat3, {band_case('ageyrs2', REPORT)} AS age_band
FROM demo WHERE ageyrs2 BETWEEN 15 AND 50""")

# --- sources, sinks ----------------------------------------------------------------

oracle("survey_tables_profile", "survey", f"""
SELECT t.table_name, {i('count(*)', 'n_rows')}, {i('count(DISTINCT study_id)', 'n_subjects')}, {i('count(DISTINCT rnd)', 'n_rounds')}
FROM survey CROSS JOIN (VALUES ('eligibility'), ('questionnaire'), ('status')) t(table_name) GROUP BY t.table_name""")


def crude(strata: str, extra: str = "", where: str = "") -> str:
    lead = f"{strata}, " if strata else ""
    group = f" GROUP BY {strata}" if strata else ""
    return f"SELECT {lead}{r('sum(py)', 'pysum')}, {i('sum(hivinc)', 'events')}{extra} FROM panel WHERE py IS NOT NULL{where}{group}"


oracle("parquet_hand_off", "panel", crude("sex, agecat"))


def proportion(flag: str, strata: str, where: str = "", n: str | None = None, k: str | None = None, names: str = "n positives prop se lb ub") -> str:
    n = n or f"count({flag})"
    k = k or f"count(CASE WHEN {flag} = 1 THEN 1 END)"
    names_ = names.split()
    return f"""SELECT {strata}, {i('n', names_[0])}, {i('k', names_[1])}, {r('p', names_[2])}, {r('sqrt(p * (1 - p) / n)', names_[3])},
  {r(f'p - {Z} * sqrt(p * (1 - p) / n)', names_[4])}, {r(f'p + {Z} * sqrt(p * (1 - p) / n)', names_[5])}
FROM (SELECT {strata}, {n} AS n, {k} AS k, {k} / CAST(nullif({n}, 0) AS DOUBLE) AS p FROM panel {where} GROUP BY {strata})"""


oracle("bucketed_hand_off", "panel", f"""
SELECT round, {i('count(*)', 'n_rows')}, {i('count(CASE WHEN hivstatus_imputed <> before THEN 1 END)', 'n_changes')}, {i('sum(round - first)', 'rounds_since_first')}
FROM (SELECT round, hivstatus_imputed, lag(hivstatus_imputed) OVER s AS before, min(round) OVER (PARTITION BY research_id) AS first
  FROM panel WINDOW s AS (PARTITION BY research_id ORDER BY round)) GROUP BY round""")
oracle("csv_round_trip", "panel", f"""
SELECT CAST(year AS VARCHAR) AS year, sex, CAST(n AS INTEGER) AS n, CAST(positives AS INTEGER) AS positives, prop AS prevalence, se, lb, ub
FROM ({proportion('hivstatus_imputed', 'year, sex')})""")

oracle("prediction_grid", "panel", f"""
SELECT round, ageyrs2, {band_case('ageyrs2', FIVE)} AS agecat FROM
  (SELECT CAST(unnest(range(r0, r1 + 1)) AS INTEGER) AS round, a0, a1 FROM (SELECT min(round) r0, max(round) r1, min(ageyrs2) a0, max(ageyrs2) a1 FROM panel)),
  (SELECT CAST(unnest(range(b0, b1 + 1)) AS INTEGER) AS ageyrs2 FROM (SELECT min(ageyrs2) b0, max(ageyrs2) b1 FROM panel))""")

# --- panel queries -----------------------------------------------------------------

oracle("status_coding", "visits", f"""
SELECT research_id, round, finalhiv, hivstatus, CASE WHEN year >= 1996 THEN visit_day END AS visit_day, CASE WHEN year >= 1996 THEN year END AS year
FROM visits""")
oracle("status_of_verified", "visits verif", f"""
SELECT round, {i('count(*)', 'n_rows')}, {i('count(DISTINCT research_id)', 'n_subjects')} FROM visits
WHERE research_id IN (SELECT research_id FROM verif) GROUP BY round""")
oracle("duplicate_person_rounds", "", f"""
SELECT CAST(o_custkey AS VARCHAR) AS research_id, CAST((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate) AS INTEGER) AS round, {i('count(*)', 'n_rows')}
FROM orders GROUP BY 1, 2 HAVING count(*) > 1""")
oracle("mean_date_by_round", "round_days", f"""
SELECT round, {r('mean_day')}, CAST(year(DATE '1970-01-01' + CAST(floor(mean_day) AS INTEGER)) AS INTEGER) AS year,
  DATE '1970-01-01' + CAST(floor(mean_day) AS INTEGER) AS mean_date FROM round_days""")
oracle("complete_rounds", "completed", "SELECT research_id, round, visited FROM completed")
oracle("impute_between", "between_rows", "SELECT research_id, round, hivstatus, hivstatus_imputed FROM between_rows")
oracle("fill_visit_day", "imputed", f"SELECT research_id, round, {r('visit_day')}, year FROM imputed")
oracle("fill_downup", "verif", f"SELECT research_id, round, {both_ways('sex')} AS sex, {both_ways('birth_day')} AS birth_day FROM verif")
GAPS = "SELECT research_id, round, round - lag(round) OVER (PARTITION BY research_id ORDER BY round) AS round_diff FROM"
oracle("round_gaps", "visits", f"SELECT * FROM ({GAPS} visits) WHERE round_diff > 1")
oracle("gaps_after_completion", "visits completed", f"""
SELECT 'raw' AS stage, {i('count(*)', 'n_gaps')}, {i('count(DISTINCT research_id)', 'n_subjects')} FROM ({GAPS} visits) WHERE round_diff > 1
UNION ALL
SELECT 'completed', count(*), count(DISTINCT research_id) FROM ({GAPS} completed) WHERE round_diff > 1""")
oracle("classify_subjects", "subjects", "SELECT * FROM subjects")
oracle("class_counts", "subjects", f"SELECT cohortclass, {i('count(*)', 'n')} FROM subjects GROUP BY cohortclass")
BAD = "cohortclass = 'Seroconversion' AND first_pos <= last_neg"
oracle("bad_bounds", "subjects", f"SELECT research_id, last_neg, first_pos FROM subjects WHERE {BAD}")
oracle("subjects_without_bad_bounds", "subjects", f"""
SELECT cohortclass, {i('count(*)', 'n')} FROM subjects WHERE research_id NOT IN (SELECT research_id FROM subjects WHERE {BAD}) GROUP BY cohortclass""")
oracle("draw_event_round", "drawn", "SELECT * FROM drawn")
oracle("draw_invariants", "drawn", f"""
SELECT bool_and(seroconv_imp > last_neg) AS after_last_neg, bool_and(seroconv_imp <= first_pos) AS by_first_pos, {i('count(*)', 'n_draws')}
FROM drawn WHERE seroconv_imp IS NOT NULL""")
oracle("code_events", "coded", "SELECT research_id, round, cohortclass, seroconv_imp, hivinc FROM coded")
oracle("person_time", "timed", f"SELECT research_id, round, {r('visit_day')}, hivinc, {r('py')} FROM timed")
oracle("follow_up_totals", "timed", f"""
SELECT {i('events', 'events')}, {r('person_years')}, {i('n_followed', 'n_followed')}, {i('lacking', 'events_without_py')}, {r('100 * events / person_years', 'rate')}
FROM (SELECT count(CASE WHEN hivinc = 1 THEN 1 END) AS events, sum(py) AS person_years,
  count(DISTINCT CASE WHEN py > 0 THEN research_id END) AS n_followed, count(CASE WHEN hivinc = 1 AND py IS NULL THEN 1 END) AS lacking FROM timed)""")
LEVEL = "CASE " + " ".join(f"WHEN agecat = '{label}' THEN {n + 1}" for n, (_, label) in enumerate(FIVE)) + " END"
oracle("attach_demographics", "panel", f"""
SELECT research_id, round, sex, birth_day, resident_imputed, ageyrs2, agecat, agecat3, age_band, {LEVEL} AS agecat_num FROM panel""")
part("circ_rows", "quest", "SELECT research_id, round, circ FROM quest")
part("circ_filled", "circ_rows", imputation("circ_rows", "circ", "circ_imputed"))
part("circ_lagged", "circ_filled", "SELECT *, lag(circ_imputed) OVER (PARTITION BY research_id ORDER BY round) AS circ_imputed_lag FROM circ_filled")
oracle("clean_absorbing_flag", "circ_lagged", """
SELECT research_id, round, circ, circ_imputed, circ_imputed_lag, CASE WHEN NOT research_id IN
  (SELECT research_id FROM circ_lagged WHERE circ_imputed_lag = 1 AND circ_imputed = 0) THEN circ_imputed END AS circ_imputed_fix
FROM circ_lagged""")
part("ever_rows", "quest", "SELECT research_id, round, eversex_clean FROM quest")
part("ever_filled", "ever_rows", imputation("ever_rows", "eversex_clean", "eversex_clean_imputed"))
oracle("eversex_imputed", "ever_filled", "SELECT research_id, round, eversex_clean, eversex_clean_imputed FROM ever_filled")
part("blanked", "panel visits", """
SELECT t.research_id, t.round, t.hivinc, CASE WHEN v.research_id IS NOT NULL THEN t.py END AS py
FROM panel t LEFT JOIN visits v ON v.research_id = t.research_id AND v.round = t.round""")
oracle("event_without_person_time", "blanked", f"""
SELECT research_id, round, hivinc, {r('py')} FROM blanked
WHERE research_id IN (SELECT research_id FROM blanked WHERE hivinc = 1 AND py IS NULL)""")

# --- counts ------------------------------------------------------------------------

oracle("subjects_by_round", "visits", f"SELECT round, {i('count(DISTINCT research_id)', 'n_subjects')} FROM visits GROUP BY round")


def stages(items: list[tuple[str, str]], table: str, full: bool) -> str:
    rows = []
    for n, (name, cond) in enumerate(items):
        lead = f"{n + 1} AS step, '{name}' AS stage, {i('count(*)', 'n_rows')}," if full else f"'{name}' AS stage,"
        rows.append(f"SELECT {lead} {i('count(DISTINCT research_id)', 'n_subjects')} FROM {table} WHERE {cond}")
    return "\nUNION ALL ".join(rows)


oracle("subjects_overall", "panel", stages([("all", "true"), ("F", "sex = 'F'"), ("M", "sex = 'M'"), ("with_py", "py IS NOT NULL"), ("with_py_u25", "py IS NOT NULL AND ageyrs2 < 25")], "panel", False))
oracle("cohort_flow", "demo", stages([
    ("completed", "true"),
    ("tested", "cohortclass <> 'No Testing'"),
    ("age 15-50", "ageyrs2 BETWEEN 15 AND 50"),
    ("with person-time", "ageyrs2 BETWEEN 15 AND 50 AND py IS NOT NULL"),
    ("events", "ageyrs2 BETWEEN 15 AND 50 AND hivinc = 1"),
    ("resident events", "ageyrs2 BETWEEN 15 AND 50 AND hivinc = 1 AND resident_imputed = 1"),
], "demo", True))
ORACLES["cohort_flow_observed"] = ORACLES["cohort_flow"]
LEVELS = [[], ["sex"], ["round"], ["sex", "round"], ["sex", "agecat"], ["sex", "round", "agecat"]]
oracle("subjects_rollup", "panel", "\nUNION ALL ".join(
    f"SELECT CAST({sum(4 >> n for n, c in enumerate(('sex', 'round', 'agecat')) if c not in level)} AS BIGINT) AS level, "
    + ", ".join(c if c in level else f"CAST(NULL AS {kind}) AS {c}" for c, kind in (("sex", "VARCHAR"), ("round", "INTEGER"), ("agecat", "VARCHAR")))
    + f", {i('count(DISTINCT research_id)', 'n_subjects')} FROM panel" + (f" GROUP BY {', '.join(level)}" if level else "")
    for level in LEVELS))
oracle("events_by_sex", "panel", f"SELECT sex, ageyrs2 < 25 AS under25, {i('count(DISTINCT research_id)', 'n_subjects')} FROM panel WHERE hivinc = 1 GROUP BY 1, 2")
oracle("rounds_per_subject", "panel", f"""
SELECT {i('count(*)', 'n_subjects')}, {r('avg(n)', 'mean_rounds')} FROM (SELECT research_id, count(*) AS n FROM panel GROUP BY research_id)""")
oracle("status_by_round_pivot", "visits", "SELECT round, " + ", ".join(
    f"nullif({f'count(DISTINCT CASE WHEN finalhiv = {v!r} THEN research_id END)'}, 0) AS {v}" for v in "NPS")
    + ", nullif(count(DISTINCT CASE WHEN finalhiv IS NULL THEN research_id END), 0) AS missing FROM visits GROUP BY round")
def zero_filled(table: str, columns: list[str]) -> str:
    known = f"(SELECT * FROM {table} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in columns)})"
    levels = " CROSS JOIN ".join(f"(SELECT DISTINCT {c} FROM {known})" for c in columns)
    same = " AND ".join(f"k.{c} = g.{c}" for c in columns)
    return f"SELECT {', '.join(f'g.{c}' for c in columns)}, {i(f'count(k.{columns[0]})', 'n')} FROM (SELECT * FROM {levels}) g LEFT JOIN {known} k ON {same} GROUP BY ALL"


oracle("events_by_year", "panel", zero_filled("panel", ["hivinc", "year"]))
FIVE_VALUES = ", ".join(f"('{label}')" for _, label in FIVE)
oracle("contingency_3way", "panel", f"""
SELECT f.v AS circ_imputed_fix, CAST(r.v AS INTEGER) AS round, b.v AS agecat, {i('count(p.research_id)', 'n')}
FROM (VALUES (0), (1)) f(v) CROSS JOIN (SELECT DISTINCT round AS v FROM panel WHERE circ_imputed_fix IS NOT NULL AND agecat IS NOT NULL) r CROSS JOIN (VALUES {FIVE_VALUES}) b(v)
LEFT JOIN panel p ON p.circ_imputed_fix = f.v AND p.round = r.v AND p.agecat = b.v GROUP BY 1, 2, 3""")
oracle("contingency_with_missing", "panel", f"SELECT hivstatus_imputed, {i('count(*)', 'n')} FROM panel GROUP BY 1")
oracle("column_proportions", "panel", f"""
SELECT eversex_clean, sex, {i('n', 'n')}, {r('n / CAST(sum(n) OVER (PARTITION BY sex) AS DOUBLE)', 'share')}
FROM (SELECT eversex_clean, sex, count(*) AS n FROM panel WHERE eversex_clean IS NOT NULL AND sex IS NOT NULL GROUP BY 1, 2)""")
part("effective", "panel", f"""
SELECT CAST(y.v AS INTEGER) AS "Year", b.v AS "AgeBin", {i('count(p.research_id)', 'effective_count')}, CASE s.v WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' ELSE s.v END AS "Gender"
FROM (SELECT unnest(range(y0, y1 + 1)) AS v FROM (SELECT min(year) y0, max(year) y1 FROM panel WHERE hivstatus_imputed IS NOT NULL)) y
CROSS JOIN (VALUES {FIVE_VALUES}) b(v)
CROSS JOIN (SELECT 'F' AS v UNION SELECT 'M' UNION SELECT sex FROM panel WHERE sex IS NOT NULL AND year IS NOT NULL AND hivstatus_imputed IS NOT NULL) s
LEFT JOIN panel p ON p.year = y.v AND p.agecat = b.v AND p.sex = s.v AND p.hivstatus_imputed IN (0, 1) GROUP BY 1, 2, 4""")
KINDS = {"hivinc": "INTEGER", "year": "INTEGER", "hivstatus_imputed": "INTEGER", "circ_imputed_fix": "INTEGER", "agecat": "VARCHAR", "eversex_clean": "INTEGER", "sex": "VARCHAR"}


def long_table(name: str, columns: list[str], source: str, share: str = "CAST(NULL AS DOUBLE)") -> str:
    shown = ", ".join(c if c in columns else f"CAST(NULL AS {kind}) AS {c}" for c, kind in KINDS.items())
    return f"SELECT '{name}' AS table_name, {shown}, {i('n', 'n')}, {share} AS share FROM ({source})"


oracle("contingency_tables", "panel", "\nUNION ALL ".join([
    long_table("events by year", ["hivinc", "year"], zero_filled("panel", ["hivinc", "year"])),
    long_table("status", ["hivstatus_imputed"], "SELECT hivstatus_imputed, count(*) AS n FROM panel GROUP BY 1"),
    long_table("circumcised men by band", ["circ_imputed_fix", "agecat"], f"""
SELECT f.v AS circ_imputed_fix, b.v AS agecat, count(p.research_id) AS n FROM (VALUES (0), (1)) f(v) CROSS JOIN (VALUES {FIVE_VALUES}) b(v)
LEFT JOIN panel p ON p.circ_imputed_fix = f.v AND p.agecat = b.v AND p.sex = 'M' GROUP BY 1, 2"""),
    long_table("ever sex within sex", ["eversex_clean", "sex"], "SELECT eversex_clean, sex, count(*) AS n FROM panel WHERE eversex_clean IS NOT NULL AND sex IS NOT NULL GROUP BY 1, 2",
               "round(n / CAST(sum(n) OVER (PARTITION BY sex) AS DOUBLE), 6) + 0.0"),
    long_table("known status by sex and band", ["sex", "agecat"], "SELECT sex, agecat, count(*) AS n FROM panel WHERE hivstatus_imputed IS NOT NULL GROUP BY 1, 2"),
]))
oracle("effective_count_long", "effective", "SELECT * FROM effective")
oracle("residents_only", "panel", crude("sex", f", {r('100 * sum(hivinc) / sum(py)', 'rate')}", " AND resident_imputed = 1"))
oracle("missing_counts", "panel", "\nUNION ALL ".join(
    f"SELECT '{c}' AS \"column\", {i(f'count(*) - count({c})', 'n_missing')} FROM panel" for c in ("sex", "ageyrs2", "agecat", "hivstatus_imputed", "hivinc", "py")))
oracle("numeric_summary", "panel", "\nUNION ALL ".join(f"""
SELECT '{c}' AS "column", {r(f'min(CAST({c} AS DOUBLE))', 'minimum')}, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.25)', 'q25')}, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.5)', 'q50')},
  {r(f'avg({c})', 'mean')}, {r(f'quantile_cont(CAST({c} AS DOUBLE), 0.75)', 'q75')}, {r(f'max(CAST({c} AS DOUBLE))', 'maximum')}, {i(f'count(*) - count({c})', 'n_missing')} FROM panel"""
    for c in ("py", "ageyrs2", "ag1stsex_clean")))


def histogram(long_rows: str, bins: int) -> str:
    return f"""
SELECT * FROM (WITH long_rows AS (SELECT * FROM ({long_rows}) WHERE value IS NOT NULL),
ranges AS (SELECT key, min(value) AS low, max(value) AS high FROM long_rows GROUP BY key),
bins AS (SELECT r.*, CAST(b.v AS INTEGER) AS bin FROM ranges r CROSS JOIN (SELECT unnest(range({bins})) AS v) b),
placed AS (SELECT key, CAST(least(floor((value - low) / ((high - low) / {bins})), {bins - 1}) AS INTEGER) AS bin FROM long_rows JOIN ranges USING (key))
SELECT b.key, b.bin, {r(f'b.low + b.bin * ((b.high - b.low) / {bins})', 'bin_low')}, {r(f'b.low + (b.bin + 1) * ((b.high - b.low) / {bins})', 'bin_high')}, {i('count(p.key)', 'n')}
FROM bins b LEFT JOIN placed p ON p.key = b.key AND p.bin = b.bin GROUP BY b.key, b.bin, b.low, b.high)"""


oracle("person_time_histogram", "panel", histogram(
    "SELECT 'py' AS key, CAST(py AS DOUBLE) AS value FROM panel WHERE py IS NOT NULL UNION ALL SELECT 'ageyrs2', CAST(ageyrs2 AS DOUBLE) FROM panel WHERE py IS NOT NULL", 20))
oracle("plausible_first_age", "quest", f"""
SELECT ag1stsex, CASE WHEN ag1stsex BETWEEN 10 AND 96 THEN ag1stsex END AS ag1stsex_clean, {i('count(*)', 'n')} FROM quest GROUP BY 1, 2""")
oracle("treatment_by_round", "quest", zero_filled("quest", ["arvmed", "cuarvmed", "round"]))

# --- rates and proportions ---------------------------------------------------------

oracle("crude_cases_py", "panel", crude("sex, round, ageyrs2"))
LONG_SEX = "CASE sex WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END"
PLURAL_SEX = "CASE sex WHEN 'F' THEN 'Women' WHEN 'M' THEN 'Men' END"
oracle("crude_cases_py_agecat", "panel", f"SELECT *, {LONG_SEX} AS strata FROM ({crude('sex, round, agecat')}) WHERE sex IS NOT NULL AND agecat IS NOT NULL")
oracle("crude_cases_py_agecat3", "panel", f"""
SELECT {PLURAL_SEX} AS sex, round, agecat3 AS age, round_even(sum(py), 0) AS pysum, {i('sum(hivinc)', 'events')}
FROM panel WHERE py IS NOT NULL AND sex IS NOT NULL AND agecat3 IS NOT NULL GROUP BY sex, round, agecat3""")
RATE = f", {r('100 * sum(hivinc) / sum(py)', 'rate')}"
oracle("crude_rates", "panel", f"""
SELECT NULL AS sex, NULL AS agecat3, * FROM ({crude('', RATE)})
UNION ALL SELECT sex, NULL, pysum, events, rate FROM ({crude('sex', RATE, ' AND sex IS NOT NULL')})
UNION ALL SELECT sex, agecat3, pysum, events, rate FROM ({crude('sex, agecat3', RATE, ' AND sex IS NOT NULL AND agecat3 IS NOT NULL')})""")


def bisect(count: str, tail: float) -> str:
    """Bisection by a fold over 80 steps on the struct (lo, hi)."""
    cdf = (
        f"list_sum(list_transform(range(0, CAST({count} + 1 AS BIGINT)), "
        "lambda j: exp(-((s.lo + s.hi) / 2) + j * ln((s.lo + s.hi) / 2) - lgamma(j + 1))))"
    )
    start = f"{{'lo': CAST(0 AS DOUBLE), 'hi': CAST({count} * 2 + 20 AS DOUBLE)}}"
    dummy = "list_transform(range(0, 80), lambda t: {'lo': CAST(0 AS DOUBLE), 'hi': CAST(0 AS DOUBLE)})"
    move = f"CASE WHEN {cdf} > {tail} THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END"
    return f"list_reduce({dummy}, lambda s, t: {move}, {start}).lo"


def exact_limits(source: str) -> str:
    return f"""
SELECT *, CASE WHEN k = 0 THEN 0.0 ELSE {bisect('(k - 1)', 0.975)} END AS low_events, {bisect('k', 0.025)} AS high_events FROM ({source})"""


oracle("rate_by_sex", "panel", f"""
SELECT sex, {r('t', 'pysum')}, {i('k', 'events')}, {r('100 * k / t', 'rate')}, {r('100 * low_events / t', 'lower_95')}, {r('100 * high_events / t', 'upper_95')}
FROM ({exact_limits('SELECT sex, sum(py) AS t, CAST(sum(hivinc) AS BIGINT) AS k FROM panel WHERE py IS NOT NULL GROUP BY sex')})""")
LEVELS = """SELECT grouping(sex, age_band) AS level, sex, age_band, sum(py) AS t, CAST(sum(hivinc) AS BIGINT) AS k FROM panel
  WHERE hivinc IN (0, 1) AND py IS NOT NULL GROUP BY GROUPING SETS ((), (sex), (sex, age_band))
  HAVING grouping(sex, age_band) <> 0 OR age_band IS NOT NULL"""
oracle("rate_table_3level", "panel", f"""
SELECT CASE level WHEN 3 THEN 'Overall' WHEN 1 THEN 'Sex' ELSE 'Sex × Age' END AS "group",
  CASE level WHEN 1 THEN sex WHEN 0 THEN concat_ws(' / ', sex, age_band) END AS subgroup,
  {r('t', 'person_years')}, {i('k', 'cases')}, {r('100 * k / t', 'inc_per_100py')}, {r('100 * low_events / t', 'lower_95')}, {r('100 * high_events / t', 'upper_95')},
  printf('%.2f (%.2f–%.2f)', 100 * k / t, 100 * low_events / t, 100 * high_events / t) AS inc_95ci
FROM ({exact_limits(LEVELS)})""")
oracle("subgroup_labels", "panel", f"""
SELECT concat_ws(' / ', sex, age_band) AS subgroup, sex, age_band AS band, {i('sum(hivinc)', 'cases')}, {r('sum(py)', 'person_years')}
FROM panel WHERE hivinc IN (0, 1) AND py IS NOT NULL AND age_band IS NOT NULL GROUP BY sex, age_band""")
oracle("prevalence_wald", "panel", proportion("hivstatus_imputed", "year, sex"))
oracle("prevalence_by_agecat", "panel", proportion("hivstatus_imputed", "year, sex, agecat", "WHERE hivstatus_imputed IS NOT NULL"))
oracle("coverage_onart", "panel", proportion("onART", "year, sex, agecat", "WHERE hivstatus_imputed = 1"))
oracle("coverage_circumcised", "panel", f"""
SELECT coalesce(b.v, t.agecat) AS agecat, round, coalesce(n, 0) AS n, coalesce(positives, 0) AS positives, prop, se, lb, ub, 'Male' AS sex
FROM (VALUES {FIVE_VALUES}) b(v) FULL JOIN ({proportion('circ_imputed_fix', 'agecat, round', "WHERE sex = 'M' AND circ_imputed_fix IS NOT NULL")}) t ON t.agecat = b.v""")
EVER = "eversex_clean_imputed"
oracle("eversex_both_null_policies", "panel", f"""
SELECT *, 'ignore' AS null_policy FROM ({proportion(EVER, 'agecat, round, sex')})
UNION ALL
SELECT *, 'count' FROM ({proportion(EVER, 'agecat, round, sex', n='count(*)', k=f'count(CASE WHEN {EVER} = 1 OR {EVER} IS NULL THEN 1 END)')})""")
oracle("median_first_age", "panel", f"SELECT round, sex, {r('median(CAST(ag1stsex_clean AS DOUBLE))', 'median_age1stsex')} FROM panel WHERE ageyrs2 > 20 AND ageyrs2 < 25 GROUP BY 1, 2")

# --- trends ------------------------------------------------------------------------


def factor(per: str) -> str:
    return (
        f"{r('t', 'pysum')}, {i('k', 'events')}, {r('CASE WHEN k > 0 THEN ln(k / t) END', 'fit')}, {r('CASE WHEN k > 0 THEN 1 / sqrt(k) END', 'se_fit')}, "
        f"{r(f'{per} * k / t', 'inc')}, {r(f'CASE WHEN k > 0 THEN {per} * k / t * exp(-{Z} / sqrt(k)) END', 'lb')}, {r(f'CASE WHEN k > 0 THEN {per} * k / t * exp({Z} / sqrt(k)) END', 'ub')}"
    )


def cells(strata: str, where: str = "") -> str:
    return f"SELECT {strata}, sum(py) AS t, sum(hivinc) AS k FROM panel WHERE py > 0{where} GROUP BY {strata}"


KNOWN3 = " AND sex IS NOT NULL AND agecat3 IS NOT NULL"
KNOWN5 = " AND sex IS NOT NULL AND agecat IS NOT NULL"
oracle("rate_trend_factor", "panel", f"""
SELECT sex, agecat3, round, {factor('100')} FROM ({cells('sex, agecat3, round', KNOWN3)})
UNION ALL SELECT sex, NULL, round, {factor('100')} FROM ({cells('sex, round', ' AND sex IS NOT NULL')})
UNION ALL SELECT NULL, NULL, round, {factor('100')} FROM ({cells('round')})""")
part("round_year", "panel", "SELECT round, CAST(year(DATE '1970-01-01' + CAST(floor(avg(visit_day)) AS INTEGER)) AS INTEGER) AS \"Year\" FROM panel GROUP BY round")
oracle("rate_trend_with_year", "panel round_year", f"""
SELECT y."Year", f.round, CASE f.sex WHEN 'F' THEN 'Women' WHEN 'M' THEN 'Men' END AS sex, f.agecat3 AS age, c.pysum, c.events, f.inc, f.lb, f.ub
FROM (SELECT sex, agecat3, round, {factor('100')} FROM ({cells('sex, agecat3, round', KNOWN3)})) f
JOIN round_year y ON y.round = f.round
JOIN ({crude('sex, round, agecat3')}) c ON c.sex = f.sex AND c.round = f.round AND c.agecat3 = f.agecat3""")
oracle("rate_trend_saturated", "panel", f"SELECT sex, agecat, round, {factor('1')} FROM ({cells('sex, agecat, round', KNOWN5)})")


def two_sided(z: str) -> str:
    """p value of a normal statistic: its density integrated from 0 by Simpson's rule."""
    weight = "CASE WHEN j IN (0, 2000) THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, 2001), lambda j: ({weight}) * exp(-pow(j * least(abs({z}), 9.0) / 2000, 2) / 2)))"
    return f"CASE WHEN {z} IS NOT NULL THEN greatest(1 - 2 * (least(abs({z}), 9.0) / 6000) * {area} / sqrt(2 * pi()), 0) END"


oracle("rate_coefficients", "panel", f"""
SELECT sex, agecat3, round, term, {r('estimate')}, {r('std_error')}, {r('estimate / std_error', 'z')}, {r(two_sided('(estimate / std_error)'), 'p')} FROM (
  SELECT c.sex, c.agecat3, c.round, CASE WHEN c.round = 7 THEN '(Intercept)' ELSE 'round ' || CAST(c.round AS VARCHAR) END AS term,
    CASE WHEN c.k > 0 AND b.k > 0 THEN ln(c.k / c.t) - CASE WHEN c.round = 7 THEN 0.0 ELSE ln(b.k / b.t) END END AS estimate,
    CASE WHEN c.k > 0 AND b.k > 0 THEN sqrt(1.0 / c.k + CASE WHEN c.round = 7 THEN 0.0 ELSE 1.0 / b.k END) END AS std_error
  FROM ({cells('sex, agecat3, round', KNOWN3)}) c
  LEFT JOIN (SELECT * FROM ({cells('sex, agecat3, round', KNOWN3)}) WHERE round = 7) b ON b.sex = c.sex AND b.agecat3 = c.agecat3)""")

part("prev_cells", "panel", """
SELECT sex, agecat, round - 13.0 AS x, CAST(count(*) AS DOUBLE) AS n, CAST(sum(hivstatus_imputed) AS DOUBLE) AS k
FROM panel WHERE hivstatus_imputed IS NOT NULL AND sex IS NOT NULL AND agecat IS NOT NULL GROUP BY sex, agecat, round""")
part("newton0", "prev_cells", """
SELECT sex, agecat, CASE WHEN sum(k) > 0 AND sum(k) < sum(n) THEN ln(sum(k) / (sum(n) - sum(k))) END AS b0,
  CASE WHEN sum(k) > 0 AND sum(k) < sum(n) THEN 0.0 END AS b1 FROM prev_cells GROUP BY sex, agecat""")
MOMENTS = """SELECT c.sex, c.agecat, b.b0, b.b1,
    sum(k - n * p) AS g0, sum((k - n * p) * x) AS g1, sum(n * p * (1 - p)) AS h00, sum(n * p * (1 - p) * x) AS h01, sum(n * p * (1 - p) * x * x) AS h11
  FROM (SELECT c.*, 1 / (1 + exp(-(b.b0 + b.b1 * c.x))) AS p FROM prev_cells c JOIN {prev} b ON b.sex = c.sex AND b.agecat = c.agecat) c
  JOIN {prev} b ON b.sex = c.sex AND b.agecat = c.agecat GROUP BY c.sex, c.agecat, b.b0, b.b1"""
for step in range(1, 13):
    part(f"newton{step}", f"newton{step - 1}", f"""
SELECT sex, agecat, b0 + (h11 * g0 - h01 * g1) / nullif(h00 * h11 - h01 * h01, 0) AS b0, b1 + (h00 * g1 - h01 * g0) / nullif(h00 * h11 - h01 * h01, 0) AS b1
FROM ({MOMENTS.format(prev=f'newton{step - 1}')})""")
part("prev_lines", "newton12", f"""
SELECT sex, agecat, b0, b1, h11 / nullif(h00 * h11 - h01 * h01, 0) AS v00, -h01 / nullif(h00 * h11 - h01 * h01, 0) AS v01, h00 / nullif(h00 * h11 - h01 * h01, 0) AS v11
FROM ({MOMENTS.format(prev='newton12')})""")
part("prev_preds", "prev_lines", """
SELECT sex, agecat, round, fit, se_fit, 1 / (1 + exp(-fit)) AS prob, 1 / (1 + exp(-(fit - 1.96 * se_fit))) AS lb, 1 / (1 + exp(-(fit + 1.96 * se_fit))) AS ub
FROM (SELECT sex, agecat, CAST(g.v AS INTEGER) AS round, b0 + b1 * (g.v - 13.0) AS fit,
    sqrt(v00 + 2 * (g.v - 13.0) * v01 + (g.v - 13.0) * (g.v - 13.0) * v11) AS se_fit
  FROM prev_lines JOIN (SELECT sex AS s, agecat AS a, unnest(range(CAST(min(x) + 13 AS BIGINT), CAST(max(x) + 14 AS BIGINT))) AS v FROM prev_cells GROUP BY sex, agecat) g ON g.s = sex AND g.a = agecat)""")
oracle("logit_trend_by_band", "prev_preds", f"""
SELECT p.sex, p.agecat, p.round, {r('p.fit', 'fit')}, {r('p.se_fit', 'se_fit')}, {r('p.prob', 'prob')}, {r('p.lb', 'lb')}, {r('p.ub', 'ub')}, {r('p.prob / b.prob', 'prevrr')}
FROM prev_preds p LEFT JOIN prev_preds b ON b.sex = p.sex AND b.agecat = p.agecat AND b.round = 6""")
oracle("logit_coefficients", "prev_lines", f"""
SELECT sex, agecat, '(Intercept)' AS term, {r('b0', 'estimate')}, {r('sqrt(v00)', 'std_error')}, {r('b0 / sqrt(v00)', 'z')}, {r(two_sided('(b0 / sqrt(v00))'), 'p')} FROM prev_lines
UNION ALL SELECT sex, agecat, 'slope', {r('b1', 'estimate')}, {r('sqrt(v11)', 'std_error')}, {r('b1 / sqrt(v11)', 'z')}, {r(two_sided('(b1 / sqrt(v11))'), 'p')} FROM prev_lines""")
part("art_cells", "panel", """
SELECT *, k / n AS p, CASE WHEN k > 0 AND k < n THEN ln(k / (n - k)) END AS fit, CASE WHEN k > 0 AND k < n THEN 1 / sqrt(n * (k / n) * (1 - k / n)) END AS se
FROM (SELECT sex, agecat, round, CAST(count(*) AS DOUBLE) AS n, CAST(sum(onART) AS DOUBLE) AS k FROM panel
  WHERE hivstatus_imputed = 1 AND sex IS NOT NULL AND agecat IS NOT NULL GROUP BY sex, agecat, round)""")
oracle("logit_saturated", "art_cells", f"""
SELECT a.sex, a.agecat, a.round, {i('a.n', 'n')}, {i('a.k', 'positives')}, {r('a.fit', 'fit')}, {r('a.se', 'se_fit')}, {r('a.p', 'prob')},
  {r(f'1 / (1 + exp(-(a.fit - {Z} * a.se)))', 'lb')},
  CASE WHEN a.fit IS NULL OR a.p < 0.001 THEN 0.0 ELSE round(1 / (1 + exp(-(a.fit + {Z} * a.se))), 6) END AS ub,
  {r('a.p / nullif(b.p, 0)', 'artrr')}
FROM art_cells a LEFT JOIN (SELECT * FROM art_cells WHERE round = 6) b ON b.sex = a.sex AND b.agecat = a.agecat""")
oracle("baseline_ratio", "panel", f"""
SELECT c.sex, c.agecat, c.round, {r('c.k / c.t', 'inc')}, {r('(c.k / c.t) / nullif(b.k / b.t, 0)', 'irr')}
FROM ({cells('sex, agecat, round', KNOWN5)}) c
LEFT JOIN (SELECT * FROM ({cells('sex, agecat, round', KNOWN5)}) WHERE round = 7) b ON b.sex = c.sex AND b.agecat = c.agecat""")
oracle("new_infections", "panel", f"""
SELECT f.sex, f.agecat3, f.round, {r('k / t', 'inc')}, {r(f'CASE WHEN k > 0 THEN k / t * exp(-{Z} / sqrt(k)) END', 'lb')}, {r(f'CASE WHEN k > 0 THEN k / t * exp({Z} / sqrt(k)) END', 'ub')},
  a.ageyrs2, {r('a.py', 'py')}, {r('k / t * a.py', 'newinf')}, {r(f'CASE WHEN k > 0 THEN k / t * exp(-{Z} / sqrt(k)) * a.py END', 'newinf_lb')}, {r(f'CASE WHEN k > 0 THEN k / t * exp({Z} / sqrt(k)) * a.py END', 'newinf_ub')}
FROM ({cells('sex, agecat3, round', KNOWN3)}) f
LEFT JOIN (SELECT sex, agecat3, round, ageyrs2, sum(py) AS py FROM panel WHERE py IS NOT NULL GROUP BY 1, 2, 3, 4) a
  ON a.sex = f.sex AND a.agecat3 = f.agecat3 AND a.round = f.round""")
oracle("ingest_form", "prev_preds effective round_year", f"""
SELECT y."Year", 'All' AS "Province", e."Gender", replace(p.agecat, ',', ':') AS "AgeBin", {r('p.prob', '"Prevalence"')}, '' AS weight, e.effective_count
FROM prev_preds p JOIN round_year y ON y.round = p.round
JOIN effective e ON e."Year" = y."Year" AND e."AgeBin" = p.agecat AND e."Gender" = CASE p.sex WHEN 'F' THEN 'Female' ELSE 'Male' END""")

# --- scenarios ---------------------------------------------------------------------

AGE98 = "floor((DATE '1998-01-01' - (DATE '1945-01-01' + CAST((c_custkey * 37) % 14000 AS INTEGER))) / 365.25)"
part("scenario_orders", "", f"""
SELECT c_mktsegment AS scenario, CASE WHEN c_nationkey % 2 = 0 THEN 'Women' ELSE 'Men' END AS gender,
  coalesce({band_case('age', REPORT)}, '50+') AS age_group, CAST((year(o_orderdate) - 1995) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month, o_totalprice * 100 / 299993 AS price
FROM orders JOIN (SELECT *, {AGE98} AS age FROM customer) ON c_custkey = o_custkey""")
part("curves", "scenario_orders", """
SELECT *, sum(inc_mean) OVER (PARTITION BY scenario, gender, age_group ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cuminc_mean
FROM (SELECT scenario, gender, age_group, month, avg(price) AS inc_mean, quantile_cont(price, 0.025) AS inc_lower, quantile_cont(price, 0.975) AS inc_upper
  FROM scenario_orders GROUP BY 1, 2, 3, 4)""")
oracle("scenario_curves", "curves", f"SELECT scenario, gender, age_group, month, {r('inc_mean')}, {r('inc_lower')}, {r('inc_upper')}, {r('cuminc_mean')} FROM curves")
oracle("result_collection", "curves", f"""
SELECT scenario, {i('count(*)', 'n_rows')}, {r('sum(inc_mean)', 'total')}, 'inc_age_gender' AS table_name FROM curves GROUP BY scenario
UNION ALL SELECT scenario, count(*), {r('sum(cuminc_mean)', 'total')}, 'inf_averted_age_gender' FROM curves GROUP BY scenario""")


def loess(source: str, keys: list[str], x: str, ys: list[str], span: float, names: list[str]) -> str:
    """Direct local quadratic fit at every point: all pairs, ranked by distance."""
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    key_list = ", ".join(keys)
    a_keys = ", ".join(f"a.{k}" for k in keys)
    moments = ", ".join(f"sum(w * power(u, {k})) AS a{k}" for k in range(5))
    tops = ", ".join(f"sum(w * y{n} * power(u, {k})) AS t{k}_{n}" for n in range(len(ys)) for k in range(3))
    values = ", ".join(f"b.{y} AS y{n}" for n, y in enumerate(ys))
    fits = ", ".join(
        r(f"CASE WHEN det > 1e-12 * a0 * a0 * a0 THEN (t0_{n} * (a2 * a4 - a3 * a3) + t1_{n} * (a2 * a3 - a1 * a4) + t2_{n} * (a1 * a3 - a2 * a2)) / det END", name)
        for n, name in enumerate(names)
    )
    return f"""
SELECT {key_list}, {x}, {fits} FROM (SELECT *, a0 * (a2 * a4 - a3 * a3) + a1 * (a2 * a3 - a1 * a4) + a2 * (a1 * a3 - a2 * a2) AS det FROM (
  SELECT {key_list}, {x}, {moments}, {tops} FROM (
    SELECT *, (bx - {x}) / nullif(h, 0) AS u, CASE WHEN abs(bx - {x}) < h THEN power(1 - power(abs(bx - {x}) / h, 3), 3) ELSE 0.0 END AS w FROM (
      SELECT *, max(CASE WHEN nearest <= q THEN abs(bx - {x}) END) OVER (PARTITION BY {key_list}, {x}) AS h FROM (
        SELECT {a_keys}, a.{x}, b.{x} AS bx, {values},
          row_number() OVER (PARTITION BY {a_keys}, a.{x} ORDER BY abs(b.{x} - a.{x})) AS nearest,
          floor(count(*) OVER (PARTITION BY {a_keys}, a.{x}) * {span} + 1e-5) AS q
        FROM {source} a JOIN {source} b ON {same})))
  GROUP BY {key_list}, {x}))"""


part("smoothed", "curves", loess("curves", ["scenario", "gender", "age_group"], "month", ["inc_mean", "inc_lower", "inc_upper"], 0.25, ["loess_inc_mean", "loess_inc_lower", "loess_inc_upper"]))
oracle("smooth_curves", "smoothed", "SELECT * FROM smoothed WHERE month > 12")
def blended_loess(source: str, keys: list[str], x: str, ys: list[str], span: float, names: list[str]) -> str:
    """Fits at the cuts of a median partition, blended; every x occurs once in a curve."""
    k, a_keys = ", ".join(keys), ", ".join(f"a.{c}" for c in keys)

    def same(a: str, b: str) -> str:
        return " AND ".join(f"{a}.{c} = {b}.{c}" for c in keys)

    moments = ", ".join(f"sum(w * power(u, {j})) AS a{j}" for j in range(5))
    tops = ", ".join(f"sum(w * y{n} * power(u, {j})) AS t{j}_{n}" for n in range(len(ys)) for j in range(3))
    fits = ", ".join(
        f"CASE WHEN det > 1e-12 * a0 * a0 * a0 THEN (t0_{n} * (a2 * a4 - a3 * a3) + t1_{n} * (a2 * a3 - a1 * a4) + t2_{n} * (a1 * a3 - a2 * a2)) / det END AS f{n}, "
        f"CASE WHEN det > 1e-12 * a0 * a0 * a0 THEN (t0_{n} * (a2 * a3 - a1 * a4) + t1_{n} * (a0 * a4 - a2 * a2) + t2_{n} * (a1 * a2 - a0 * a3)) / det / h END AS d{n}"
        for n in range(len(ys))
    )
    ahead = ", ".join(f"lead({c}{n}) OVER o AS next_{c}{n}" for n in range(len(ys)) for c in "fd")
    blends = ", ".join(
        r(f"power(1 - s, 2) * (1 + 2 * s) * f{n} + s * s * (3 - 2 * s) * next_f{n} + (s * power(1 - s, 2) * d{n} - s * s * (1 - s) * next_d{n}) * (w - v)", name)
        for n, name in enumerate(names)
    )
    return f"""
WITH RECURSIVE pts AS (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {x}) AS rn, count(*) OVER (PARTITION BY {k}) AS n FROM {source}),
cells AS (
  SELECT DISTINCT {k}, CAST(1 AS BIGINT) AS l, n AS u, n, floor(n * {span * 0.2!r}) AS most FROM pts
  UNION ALL SELECT {k}, CASE side WHEN 0 THEN l ELSE (l + u) // 2 + 1 END, CASE side WHEN 0 THEN (l + u) // 2 ELSE u END, n, most
  FROM cells CROSS JOIN (VALUES (0), (1)) h(side) WHERE u - l + 1 > greatest(most, 1)),
edges AS (SELECT {k}, min({x}) AS lo, max({x}) AS hi, 0.005 * greatest(max({x}) - min({x}), greatest(abs(min({x})), abs(max({x}))) * 1e-3 + 1e-30) AS margin FROM pts GROUP BY {k}),
ends AS (
  SELECT DISTINCT {a_keys}, CAST(p.{x} AS DOUBLE) AS v FROM cells a JOIN pts p ON {same("p", "a")} AND p.rn = a.u WHERE a.u < a.n
  UNION SELECT {k}, lo - margin FROM edges UNION SELECT {k}, hi + margin FROM edges),
fits AS (
  SELECT {k}, v, {fits} FROM (SELECT *, a0 * (a2 * a4 - a3 * a3) + a1 * (a2 * a3 - a1 * a4) + a2 * (a1 * a3 - a2 * a2) AS det FROM (
    SELECT {k}, v, any_value(h) AS h, {moments}, {tops} FROM (
      SELECT *, (bx - v) / nullif(h, 0) AS u, CASE WHEN abs(bx - v) < h THEN power(1 - power(abs(bx - v) / h, 3), 3) ELSE 0.0 END AS w FROM (
        SELECT *, max(CASE WHEN nearest <= q THEN abs(bx - v) END) OVER (PARTITION BY {k}, v) AS h FROM (
          SELECT {a_keys}, a.v, b.{x} AS bx, {", ".join(f"b.{y} AS y{n}" for n, y in enumerate(ys))},
            row_number() OVER (PARTITION BY {a_keys}, a.v ORDER BY abs(b.{x} - a.v)) AS nearest, floor(b.n * {span} + 1e-5) AS q
          FROM ends a JOIN pts b ON {same("a", "b")})))
    GROUP BY {k}, v))),
spans AS (SELECT *, lead(v) OVER o AS w, {ahead} FROM fits WINDOW o AS (PARTITION BY {k} ORDER BY v))
SELECT {k}, {x}, {blends} FROM (SELECT {", ".join(f"p.{c}" for c in keys)}, p.{x}, (p.{x} - c.v) / (c.w - c.v) AS s, c.* EXCLUDE ({k})
  FROM pts p JOIN spans c ON {same("p", "c")} AND p.{x} >= c.v AND p.{x} < c.w)"""


part("blended", "curves", blended_loess("curves", ["scenario", "gender", "age_group"], "month", ["inc_mean", "inc_lower", "inc_upper"], 0.25, ["loess_inc_mean", "loess_inc_lower", "loess_inc_upper"]))
oracle("smooth_curves_interpolated", "blended", "SELECT * FROM blended WHERE month > 12")
part("cover", "panel", """
SELECT sex, round, CASE WHEN isnan(v) THEN 0.0 ELSE v END AS artcov_mean FROM (
  SELECT sex, round, CASE WHEN n = 0 THEN CAST('nan' AS DOUBLE) ELSE k / n END AS v FROM (
    SELECT sex, round, CAST(count(CASE WHEN hivstatus_imputed = 1 THEN 1 END) AS DOUBLE) AS n, CAST(count(CASE WHEN hivstatus_imputed = 1 AND onART = 1 THEN 1 END) AS DOUBLE) AS k
    FROM panel WHERE sex IS NOT NULL GROUP BY sex, round))""")
oracle("smooth_coverage", "cover", loess("cover", ["sex"], "round", ["artcov_mean"], 0.5, ["smooth_artcov_mean"]))
part("averted", "curves", """
SELECT a.gender, a.age_group, a.month, a.scenario, b.cuminc_mean AS base_value, a.cuminc_mean,
  a.cuminc_mean - b.cuminc_mean AS delta_inc_mean, (a.cuminc_mean - b.cuminc_mean) / nullif(a.cuminc_mean, 0) AS delta_inc_mean_pct
FROM curves a JOIN curves b ON b.gender = a.gender AND b.age_group = a.age_group AND b.month = a.month AND b.scenario = 'BUILDING'""")
oracle("infections_averted", "averted", f"SELECT gender, age_group, month, scenario, {r('base_value')}, {r('cuminc_mean')}, {r('delta_inc_mean')}, {r('delta_inc_mean_pct')} FROM averted")
YOUNG = "gender = 'Women' AND age_group IN ('15-24', '25-34')"
oracle("stack_measures", "smoothed averted", f"""
SELECT age_group, gender, month, scenario, 'incidence' AS measure, loess_inc_mean AS value FROM smoothed WHERE {YOUNG} AND month > 12 AND loess_inc_mean IS NOT NULL
UNION ALL SELECT age_group, gender, month, scenario, 'cum_incidence', {r('100 * delta_inc_mean_pct', 'value')} FROM averted WHERE {YOUNG} AND delta_inc_mean_pct IS NOT NULL""")
part("unrounded", "curves", PARTS["smoothed"][1].replace("round(", "(").replace(", 6) + 0.0", ")"))
oracle("compare_to_data", "unrounded scenario_orders", f"""
SELECT m.gender, m.age_group, m.month, {r('m.loess_inc_mean', 'loess_inc_mean')}, {r('o.observed', 'observed')}, {r('m.loess_inc_mean - o.observed', 'difference')}
FROM unrounded m JOIN (SELECT gender, age_group, month, avg(price) AS observed FROM scenario_orders GROUP BY 1, 2, 3) o
  ON o.gender = m.gender AND o.age_group = m.age_group AND o.month = m.month WHERE m.scenario = 'BUILDING'""")
part("parameters", "", "\nUNION ALL ".join(
    f"SELECT '{c}' AS key, {v} AS value FROM lineitem" for c, v in
    (("l_quantity", "l_quantity"), ("l_extendedprice", "l_extendedprice"), ("l_discount", "1 - l_discount"), ("l_tax", "l_tax"))))
oracle("parameter_long", "parameters", f"SELECT key, {i('count(value)', 'n')}, {r('avg(value)', 'mean')} FROM parameters GROUP BY key")
oracle("parameter_quantiles", "parameters", f"""
SELECT key, {r('quantile_cont(value, 0.25)', 'q25')}, {r('quantile_cont(value, 0.5)', 'q50')}, {r('quantile_cont(value, 0.75)', 'q75')} FROM parameters GROUP BY key""")
oracle("parameter_histogram", "parameters", histogram("SELECT * FROM parameters", 7))
PLAIN = "CASE " + " ".join(f"WHEN agecat = '{label}' THEN '{15 + 5 * n}-{19 + 5 * n}'" for n, (_, label) in enumerate(FIVE)) + " END"
oracle("label_bands", "panel", f"""
SELECT agecat, {PLAIN} AS age_group, {LEVEL} AS level, {PLURAL_SEX} AS gender, {r("count(CASE WHEN hivstatus_imputed = 1 THEN 1 END) / CAST(nullif(count(hivstatus_imputed), 0) AS DOUBLE)", 'prop')}
FROM panel GROUP BY agecat, sex""")

# --- output tables -----------------------------------------------------------------


def indicator(flag: str, where: str, source: str) -> str:
    return f"SELECT year, {LONG_SEX} AS strata, agecat, prop AS prob, lb, ub, '{source}' AS source FROM ({proportion(flag, 'year, sex, agecat', where)}) WHERE prop IS NOT NULL"


oracle("combine_indicators", "panel", "\nUNION ALL ".join([
    indicator("circ_imputed_fix", "WHERE sex = 'M'", "vmmc"),
    indicator("eversex_clean_imputed", "WHERE agecat IN ('[15,20)', '[20,25)')", "eversex"),
    indicator("onART", "WHERE hivstatus_imputed = 1", "art"),
]))
oracle("top_rows", "panel", f"SELECT * FROM ({crude('sex, round, agecat', '', KNOWN5)}) ORDER BY events DESC, round DESC, sex, agecat LIMIT 6")
