"""Oracle SQL: every query again, in DuckDB's SQL, on the same driver tables."""

from __future__ import annotations

BINDING = """
subj AS (
  SELECT c.c_custkey AS k, c.c_name AS USUBJID, 'S' || lpad(CAST(c.c_nationkey AS STRING), 2, '0') AS SITEID,
         c.c_mktsegment AS seg, c.c_acctbal AS bal, MIN(CAST(o.o_orderdate AS DATE)) AS d0, MAX(o.o_orderkey) AS last_order
  FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey
  GROUP BY c.c_custkey, c.c_name, c.c_nationkey, c.c_mktsegment, c.c_acctbal
),
dm AS (
  SELECT USUBJID, SITEID, k,
         CASE seg WHEN 'HOUSEHOLD' THEN 'Scrnfail' WHEN 'BUILDING' THEN 'Pbo' WHEN 'MACHINERY' THEN 'Xan_Hi' ELSE 'Xan_Lo' END AS ARMCD,
         CASE WHEN seg <> 'HOUSEHOLD' THEN CAST(d0 AS STRING) END AS RFSTDTC,
         CASE WHEN k % 10 <> 0 THEN CAST(d0 + CAST(-14 AS INT) AS STRING) END AS RFICDTC,
         CAST(d0 + CAST(60 + k % 90 AS INT) AS STRING) AS RFPENDTC
  FROM subj
),
ds AS (
  SELECT s.USUBJID, 'DISPOSITION EVENT' AS DSCAT,
         CASE o.o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ADVERSE EVENT' ELSE 'WITHDRAWAL BY SUBJECT' END AS DSDECOD
  FROM subj s JOIN orders o ON o.o_orderkey = s.last_order WHERE s.k % 29 <> 0
  UNION ALL
  SELECT USUBJID, 'PROTOCOL MILESTONE' AS DSCAT, 'RANDOMIZED' AS DSDECOD FROM subj
),
adsl AS (
  SELECT s.USUBJID, s.SITEID,
         CASE s.seg WHEN 'BUILDING' THEN 'Placebo' WHEN 'MACHINERY' THEN 'Xanomeline High Dose' ELSE 'Xanomeline Low Dose' END AS TRT01P,
         CAST(50 + s.k % 46 AS DOUBLE) AS AGE, CASE WHEN s.k % 2 = 0 THEN 'F' ELSE 'M' END AS SEX,
         CASE WHEN s.k % 37 <> 0 THEN CAST(18 + s.k % 19 AS DOUBLE) END AS BMIBL,
         CAST(6 + s.k % 15 AS DOUBLE) AS EDUCLVL, CAST(s.k % 120 AS DOUBLE) AS DURDIS, CAST(10 + s.k % 14 AS DOUBLE) AS MMSETOT,
         CAST(s.d0 AS STRING) AS RFSTDTC, CAST(s.d0 + CAST((s.k * 5) % 190 AS INT) AS STRING) AS RFENDTC,
         CASE WHEN o.o_orderstatus <> 'F' THEN 'Y' ELSE NULL END AS DISCONFL
  FROM subj s JOIN orders o ON o.o_orderkey = s.last_order WHERE s.seg <> 'HOUSEHOLD'
),
sv0 AS (
  SELECT s.USUBJID, s.d0, o.o_orderkey AS ok, row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS n
  FROM orders o JOIN subj s ON s.k = o.o_custkey
),
sv AS (
  SELECT USUBJID, CAST(n + 2 AS DOUBLE) AS VISITNUM, CAST(14 * (n - 1) + 1 AS DOUBLE) AS VISITDY,
         CASE WHEN n = 1 THEN 'BASELINE' WHEN ok % 11 = 0 THEN 'UNSCHEDULED ' || CAST(n AS STRING)
              WHEN ok % 13 = 0 THEN 'Week ' || CAST(2 * (n - 1) AS STRING) ELSE 'WEEK ' || CAST(2 * (n - 1) AS STRING) END AS VISIT,
         CASE WHEN ok % 97 = 0 THEN NULL
              WHEN ok % 89 = 0 THEN substr(CAST(d0 + CAST(14 * (n - 1) AS INT) AS STRING), 1, 7)
              ELSE CAST(d0 + CAST(14 * (n - 1) + (ok * 7) % 31 - 15 AS INT) AS STRING) END AS SVSTDTC
  FROM sv0
),
ae0 AS (
  SELECT s.USUBJID, s.d0, e.event_id AS id, e.event_type AS et, e.value AS v, CAST((e.event_id * 13) % 200 - 6 AS INT) AS off
  FROM events e JOIN subj s ON s.k = e.user_id
),
ae AS (
  SELECT USUBJID, upper(et) AS AETERM, upper(et) || '-TYPE DISORDERS ' || CAST(id % 3 AS STRING) AS AEBODSYS,
         CASE WHEN v < 20 THEN 'MILD' WHEN v < 80 THEN 'MODERATE' ELSE 'SEVERE' END AS AESEV,
         CASE WHEN v > 150 THEN 'Y' ELSE 'N' END AS AESER,
         CAST(CASE WHEN off >= 0 THEN off + 1 ELSE off END AS DOUBLE) AS AESTDY,
         CASE WHEN id % 43 = 0 THEN substr(CAST(d0 + off AS STRING), 1, 7) ELSE CAST(d0 + off AS STRING) END AS AESTDTC,
         CASE WHEN id % 5 <> 0 THEN CAST(d0 + off + CAST(id % 23 - 1 AS INT) AS STRING) END AS AEENDTC,
         CASE WHEN id % 7 = 0 THEN 'NOT RECOVERED/NOT RESOLVED' WHEN id % 7 < 5 THEN 'RECOVERED/RESOLVED' WHEN id % 7 = 5 THEN 'Recovered' ELSE 'FATAL' END AS AEOUT
  FROM ae0
),
ex AS (
  SELECT s.USUBJID, l.l_quantity AS EXDOSE, CAST(CAST(l.l_shipdate AS DATE) AS STRING) AS EXSTDTC
  FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN subj s ON s.k = o.o_custkey WHERE s.k % 41 <> 0
)
"""


def _over_domains(body: str, *steps: str) -> str:
    """A query that begins with the binding, then further named steps."""
    # DESCENT calls itself; the others do not mind the word.
    return "WITH RECURSIVE" + ",\n".join([BINDING.rstrip(), *(s.strip() for s in steps)]) + "\n" + body.strip()


# --- Views ---

SITES = """
q_sites AS (
  SELECT *, rank() OVER (ORDER BY randomised DESC)::BIGINT AS enrolment_rank,
         round(100.0::DOUBLE * screen_failures / screened, 1) AS screen_fail_pct
  FROM (SELECT SITEID AS site, count(*) AS screened,
               count(*) FILTER (WHERE ARMCD <> 'Scrnfail') AS randomised,
               count(*) FILTER (WHERE ARMCD = 'Scrnfail') AS screen_failures
        FROM dm GROUP BY ALL)
)
"""

MONTHS = """
SELECT month, randomised,
       sum(randomised) OVER (ORDER BY month)::BIGINT AS cumulative_randomised
FROM (SELECT left(RFSTDTC, 7) AS month, count(*) AS randomised
      FROM dm WHERE RFSTDTC IS NOT NULL GROUP BY ALL)
"""

OUTCOMES = """
q_outcomes AS (
  SELECT arm, disposition, subjects,
         round(100.0::DOUBLE * subjects / (sum(subjects) OVER (PARTITION BY arm)), 1) AS pct_of_arm
  FROM (SELECT TRT01P AS arm, DSDECOD AS disposition, count(*) AS subjects
        FROM adsl JOIN ds USING (USUBJID)
        WHERE DSCAT = 'DISPOSITION EVENT' GROUP BY ALL)
)
"""

RETENTION = """
SELECT arm, visitnum, visit, planned_day, attended,
       round(100.0::DOUBLE * attended / arm_size, 1) AS pct_retained
FROM (SELECT TRT01P AS arm, VISITNUM AS visitnum, VISIT AS visit, VISITDY AS planned_day,
             count(DISTINCT USUBJID) AS attended
      FROM sv JOIN adsl USING (USUBJID)
      WHERE VISIT = 'BASELINE' OR VISIT ILIKE 'WEEK%' GROUP BY ALL)
JOIN (SELECT TRT01P AS arm, count(*) AS arm_size FROM adsl GROUP BY ALL) USING (arm)
"""


def _windows(days: int) -> str:
    return f"""
q_windows AS (
  SELECT site, count(*) AS scheduled_visits,
         count(*) FILTER (WHERE abs(off) > {days}) AS out_of_window,
         round(100.0::DOUBLE * count(*) FILTER (WHERE abs(off) > {days}) / count(*), 1)
           AS out_of_window_pct,
         round(avg(off), 1) + 0.0::DOUBLE AS mean_deviation_days
  FROM (SELECT SITEID AS site,
               date_diff('day', TRY_CAST(RFSTDTC AS DATE), TRY_CAST(SVSTDTC AS DATE)) + 1 - VISITDY
                 AS off
        FROM sv JOIN dm USING (USUBJID) WHERE VISIT ILIKE 'week%')
  GROUP BY ALL
)
"""


AE_SITES = """
SELECT site, n_subjects, coalesce(events, 0)::BIGINT AS total_aes,
       round(1.0::DOUBLE * coalesce(events, 0) / n_subjects, 2) AS aes_per_subject,
       round(100.0::DOUBLE * coalesce(grave, 0) / n_subjects, 1) AS pct_severe_or_serious
FROM (SELECT SITEID AS site, count(*) AS n_subjects FROM adsl GROUP BY ALL)
LEFT JOIN (
  SELECT SITEID AS ae_site, sum(n) AS events, count(*) FILTER (WHERE worst) AS grave
  FROM (SELECT SITEID, USUBJID, count(*) AS n, bool_or(AESEV = 'SEVERE') OR bool_or(AESER = 'Y') AS worst
        FROM ae JOIN adsl USING (USUBJID) GROUP BY ALL)
  GROUP BY ALL
) ON ae_site = site
"""

BODY_SYSTEMS = """
q_systems AS (
  SELECT TRT01P AS arm, AEBODSYS AS body_system, count(DISTINCT USUBJID) AS subjects_with_ae
  FROM adsl JOIN ae USING (USUBJID) GROUP BY ALL
)
"""

# The place of every row in each ordered view, under a digest of what names the row.
ORDERS = """
SELECT 'site_enrolment' AS view, row_number() OVER (ORDER BY enrolment_rank, site NULLS FIRST) AS place,
       md5(coalesce(site, '?')) AS digest FROM q_sites
UNION ALL
SELECT 'enrolment_over_time', row_number() OVER (ORDER BY month NULLS FIRST), md5(coalesce(month, '?'))
FROM (SELECT DISTINCT left(RFSTDTC, 7) AS month FROM dm WHERE RFSTDTC IS NOT NULL)
UNION ALL
SELECT 'disposition', row_number() OVER (ORDER BY arm NULLS FIRST, subjects DESC, disposition NULLS FIRST),
       md5(coalesce(arm, '?') || '|' || coalesce(disposition, '?')) FROM q_outcomes
UNION ALL
SELECT 'retention_by_visit',
       row_number() OVER (ORDER BY arm NULLS FIRST, visitnum NULLS FIRST, visit NULLS FIRST, planned_day NULLS FIRST),
       md5(coalesce(arm, '?') || '|' || coalesce(visitnum::BIGINT::VARCHAR, '?') || '|' || coalesce(visit, '?')
           || '|' || coalesce(planned_day::BIGINT::VARCHAR, '?'))
FROM q_retention
UNION ALL
SELECT 'visit_windows', row_number() OVER (ORDER BY out_of_window_pct DESC NULLS LAST, site NULLS FIRST),
       md5(coalesce(site, '?')) FROM q_windows
UNION ALL
SELECT 'ae_by_site', row_number() OVER (ORDER BY aes_per_subject DESC NULLS LAST, site NULLS FIRST),
       md5(coalesce(site, '?')) FROM q_ae_sites
UNION ALL
SELECT 'ae_by_body_system',
       row_number() OVER (ORDER BY subjects_with_ae DESC, arm NULLS FIRST, body_system NULLS FIRST),
       md5(coalesce(arm, '?') || '|' || coalesce(body_system, '?')) FROM q_systems
"""

# --- Edit checks: one SELECT each, giving USUBJID, SITEID, detail ---

HITS = {
    "DM01": "SELECT USUBJID, SITEID, 'RFICDTC is blank' AS detail FROM dm WHERE RFICDTC IS NULL",
    "AE01": """
        SELECT USUBJID, SITEID, AETERM || ': start date recorded as ' || AESTDTC AS detail
        FROM ae JOIN dm USING (USUBJID) WHERE strlen(AESTDTC) < 10""",
    "AE02": """
        SELECT USUBJID, SITEID, AETERM || ': ' || AESTDTC || ' -> ' || AEENDTC AS detail
        FROM ae JOIN dm USING (USUBJID)
        WHERE length(AEENDTC) = 10 AND length(AESTDTC) = 10 AND AEENDTC < AESTDTC""",
    "AE03": """
        SELECT USUBJID, SITEID, AETERM || ': study day ' || trunc(AESTDY)::INT AS detail
        FROM ae JOIN dm USING (USUBJID) WHERE AESTDY < 1""",
    "AE04": """
        SELECT USUBJID, SITEID, AETERM || ' (outcome: ' || AEOUT || ')' AS detail
        FROM ae JOIN dm USING (USUBJID)
        WHERE AEENDTC IS NULL AND AEOUT ILIKE 'RECOVERED%'""",
    "AE05": """
        SELECT USUBJID, SITEID, AETERM || ' ended ' || AEENDTC || ' but outcome: ' || AEOUT AS detail
        FROM ae JOIN dm USING (USUBJID)
        WHERE AEENDTC IS NOT NULL AND AEOUT = 'NOT RECOVERED/NOT RESOLVED'""",
    "SV01": """
        SELECT USUBJID, SITEID, VISIT || ' on ' || SVSTDTC || ', study end ' || RFPENDTC AS detail
        FROM sv JOIN dm USING (USUBJID) WHERE SVSTDTC > RFPENDTC""",
    "SV02": """
        SELECT USUBJID, SITEID,
               VISIT || ' (' || SVSTDTC || ') is before ' || v0 || ' (' || d0 || ')' AS detail
        FROM (SELECT USUBJID, VISIT, SVSTDTC, lag(SVSTDTC) OVER w AS d0, lag(VISIT) OVER w AS v0
              FROM sv
              WINDOW w AS (PARTITION BY USUBJID ORDER BY VISITNUM NULLS FIRST,
                           SVSTDTC NULLS FIRST, VISIT NULLS FIRST))
        JOIN (SELECT USUBJID, SITEID FROM dm) USING (USUBJID)
        WHERE d0 > SVSTDTC""",
    "DS01": """
        SELECT USUBJID, SITEID, 'no DSCAT = DISPOSITION EVENT row' AS detail FROM adsl
        WHERE NOT EXISTS (SELECT 1 FROM ds WHERE ds.USUBJID = adsl.USUBJID
                          AND ds.DSCAT = 'DISPOSITION EVENT')""",
    "EX01": """
        SELECT USUBJID, SITEID, 'no rows in EX' AS detail FROM adsl ANTI JOIN ex USING (USUBJID)""",
}

# Severity, domain and description of each check.
CATALOGUE = """
q_checks AS (
  SELECT * FROM (VALUES
    ('DM01', 'High', 'DM', 'Informed consent date missing for a screened subject'),
    ('AE01', 'Medium', 'AE', 'Adverse event start date is partial (day and/or month missing)'),
    ('AE02', 'High', 'AE', 'Adverse event end date is before its start date'),
    ('AE03', 'Medium', 'AE',
     'Adverse event started before first dose - confirm it is not medical history'),
    ('AE04', 'Medium', 'AE',
     'Adverse event recorded as ongoing (no end date) but outcome says recovered'),
    ('AE05', 'Medium', 'AE',
     'Adverse event has an end date but outcome says not recovered/not resolved'),
    ('SV01', 'Medium', 'SV', 'Scheduled visit dated after the subject''s end of study'),
    ('SV02', 'Low', 'SV', 'Visit dates out of sequence (later visit number with an earlier date)'),
    ('DS01', 'High', 'DS', 'Randomised subject with no end-of-study disposition record'),
    ('EX01', 'High', 'EX', 'Randomised subject with no dosing record')
  ) AS t(check_id, severity, "domain", description)
)
"""


def _listing(*check_ids: str) -> str:
    hits = " UNION ALL ".join(f"SELECT '{c}' AS check_id, * FROM ({HITS[c]})" for c in check_ids)
    return f"""
q_listing AS (
  SELECT check_id, severity, "domain", description, USUBJID, SITEID, detail
  FROM ({hits}) JOIN q_checks USING (check_id)
)
"""


ALL_CHECKS = tuple(HITS)


def _checks(body: str, *check_ids: str) -> str:
    return _over_domains(body, CATALOGUE, _listing(*(check_ids or ALL_CHECKS)))


# --- Dashboard frames ---

KPIS = """
SELECT screened, randomised,
       round(100.0::DOUBLE * (1.0::DOUBLE - randomised::DOUBLE / screened), 1)
         AS screen_failure_rate,
       round(100.0::DOUBLE * completed / randomised, 1) AS completed_pct,
       (SELECT count(*) FROM q_listing) AS open_queries
FROM (SELECT sum(screened)::BIGINT AS screened, sum(randomised)::BIGINT AS randomised FROM q_sites),
     (SELECT sum(subjects) AS completed FROM q_outcomes WHERE disposition = 'COMPLETED')
"""

TOP_SYSTEMS = """
SELECT arm, subjects_with_ae,
       left(array_to_string(list_transform(
              regexp_extract_all(body_system, '([A-Za-z]+|[^A-Za-z]+)'),
              lambda x: upper(x[1]) || lower(x[2:])), ''), 40) AS body_system
FROM q_systems
WHERE body_system IN (
  SELECT body_system FROM q_systems WHERE body_system IS NOT NULL
  GROUP BY body_system ORDER BY sum(subjects_with_ae) DESC, body_system LIMIT 8)
"""

# --- Dropout model ---

FEATURES = """
q_features AS (
  SELECT USUBJID, SITEID, AGE, SEX, BMIBL, EDUCLVL, DURDIS, MMSETOT, TRT01P,
         coalesce(n, 0) AS early_ae_count, coalesce(n_worse, 0) AS early_ae_mod_sev,
         (DISCONFL IS NOT DISTINCT FROM 'Y')::BIGINT AS discontinued
  FROM adsl
  LEFT JOIN (SELECT USUBJID, count(*) AS n,
                    count(*) FILTER (WHERE AESEV IN ('MODERATE', 'SEVERE')) AS n_worse
             FROM ae WHERE AESTDY >= 1 AND AESTDY <= 14 GROUP BY ALL) USING (USUBJID)
  WHERE date_diff('day', RFSTDTC::DATE, RFENDTC::DATE) >= 14
)
"""
NUMBERS = ("AGE", "BMIBL", "EDUCLVL", "DURDIS", "MMSETOT", "early_ae_count", "early_ae_mod_sev")

IMPUTED = (
    "q_imputed AS (SELECT USUBJID, SEX, TRT01P, "
    + ", ".join(f"coalesce({c}, (SELECT median({c}) FROM q_features))::DOUBLE AS {c}" for c in NUMBERS)
    + " FROM q_features)"
)
SCALED = ", ".join(
    f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) + 0.0::DOUBLE AS {c}"
    for c in NUMBERS
)
DUMMIES = """
  (SEX = 'M')::INT::DOUBLE AS "SEX_M",
  (TRT01P = 'Xanomeline High Dose')::INT::DOUBLE AS "TRT01P_Xanomeline High Dose",
  (TRT01P = 'Xanomeline Low Dose')::INT::DOUBLE AS "TRT01P_Xanomeline Low Dose"
"""

FOLDS = """
SELECT USUBJID, repeat, discontinued,
       ((row_number() OVER (PARTITION BY repeat, discontinued ORDER BY draw, USUBJID) - 1) % 5)::BIGINT
         AS fold
FROM (SELECT USUBJID, discontinued, r AS repeat, md5('42:' || r || ':' || USUBJID) AS draw
      FROM q_features, range(1, 11) AS reps(r))
"""

SCORED = """
q_scored AS (
  SELECT discontinued AS y, (early_ae_count + AGE / 100.0::DOUBLE)
         / ((SELECT max(early_ae_count) FROM q_features) + 1) AS score
  FROM q_features
)
"""
# Mann-Whitney form: the sum of average ranks of the positives.
AUC = """
SELECT round((sum(avg_rank) FILTER (WHERE y = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * n), 9) AS roc_auc
FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE
               AS avg_rank,
             (sum(y) OVER ())::DOUBLE AS p, (sum(1 - y) OVER ())::DOUBLE AS n
      FROM q_scored)
GROUP BY p, n
"""
BALANCED = """
SELECT round((avg((score > 0.5)::INT) FILTER (WHERE y = 1)
              + avg((score <= 0.5)::INT) FILTER (WHERE y = 0)) / 2.0::DOUBLE, 9) AS balanced_accuracy
FROM q_scored
"""

# Every fold's rank sum and recalls, then mean and population SD over the folds.
FOLD_SCORED = f"""
q_fold_scored AS (
  SELECT repeat, fold, discontinued AS y, score
  FROM ({FOLDS})
  JOIN (SELECT USUBJID, (early_ae_count + AGE / 100.0::DOUBLE)
               / ((SELECT max(early_ae_count) FROM q_features) + 1) AS score
        FROM q_features) USING (USUBJID)
)
"""
CV_OF_SCORE = """
SELECT model, metric, round(avg(value), 9) AS mean, round(stddev_pop(value), 9) AS sd
FROM (
  SELECT 'Fixed score' AS model, 'ROC-AUC' AS metric,
         (sum(avg_rank) FILTER (WHERE y = 1) - p * (p + 1) / 2.0::DOUBLE) / (p * n) AS value
  FROM (SELECT repeat, fold, y,
               rank() OVER (PARTITION BY repeat, fold ORDER BY score)
                 + (count(*) OVER (PARTITION BY repeat, fold, score) - 1) / 2.0::DOUBLE AS avg_rank,
               (sum(y) OVER (PARTITION BY repeat, fold))::DOUBLE AS p,
               (sum(1 - y) OVER (PARTITION BY repeat, fold))::DOUBLE AS n
        FROM q_fold_scored)
  GROUP BY repeat, fold, p, n
  UNION ALL
  SELECT 'Fixed score', 'Balanced accuracy',
         (avg((score > 0.5)::INT) FILTER (WHERE y = 1)
          + avg((score <= 0.5)::INT) FILTER (WHERE y = 0)) / 2.0::DOUBLE
  FROM q_fold_scored GROUP BY repeat, fold)
GROUP BY model, metric
"""

# --- Logistic model, solved again by descent along the gradient ---

# Names shown to readers, in the order of the design's columns.
SHOWN = (
    "Age (years)",
    "Baseline BMI",
    "Years of education",
    "Disease duration (months)",
    "Baseline MMSE score",
    "AEs in first 14 days",
    "Moderate/severe AEs in first 14 days",
    "Sex: M",
    "Arm: Xanomeline High Dose",
    "Arm: Xanomeline Low Dose",
)
N_INPUTS = len(SHOWN)
DESIGN = (
    """
q_design AS MATERIALIZED (
  SELECT USUBJID, SITEID, discontinued AS y,
         count(*) OVER () / (2.0::DOUBLE * count(*) OVER (PARTITION BY discontinued)) AS w, """
    + ", ".join(f"(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()) AS x{i}" for i, c in enumerate(NUMBERS, 1))
    + """, (SEX = 'M')::INT::DOUBLE AS x8,
         (TRT01P = 'Xanomeline High Dose')::INT::DOUBLE AS x9,
         (TRT01P = 'Xanomeline Low Dose')::INT::DOUBLE AS x10
  FROM q_imputed JOIN (SELECT USUBJID, SITEID, discontinued FROM q_features) USING (USUBJID)
)
"""
)
ALL = range(N_INPUTS + 1)


def _each(form: str, numbers=ALL, glue: str = ", ") -> str:
    return glue.join(form.format(i=i) for i in numbers)


# b is where the descent is, a is where it looks ahead to. Steps are as long as the
# curvature allows anywhere; the penalty spares the intercept.
DESCENT = f"""
q_step AS MATERIALIZED (
  SELECT 1 / (0.25::DOUBLE * sum(w * (1 + {_each("x{i} * x{i}", ALL[1:], " + ")})) + 1) AS length FROM q_design
),
q_fit AS (
  SELECT 0 AS k, {_each("0.0::DOUBLE AS b{i}")}, {_each("0.0::DOUBLE AS a{i}")}
  UNION ALL
  SELECT k + 1, {_each("a{i} - length * g{i}")},
         {_each("a{i} - length * g{i} + 0.9::DOUBLE * (a{i} - length * g{i} - b{i})")}
  FROM (
    SELECT k, {_each("b{i}")}, {_each("a{i}")}, sum(miss) AS g0,
           {_each("sum(miss * x{i}) + a{i} AS g{i}", ALL[1:])}
    FROM (SELECT q_fit.*, {_each("x{i}", ALL[1:])},
                 w * (1 / (1 + exp(-(a0 + {_each("a{i} * x{i}", ALL[1:], " + ")}))) - y) AS miss
          FROM q_fit, q_design WHERE k < 800)
    GROUP BY k, {_each("b{i}")}, {_each("a{i}")}
  ), q_step
),
q_end AS (SELECT * FROM q_fit WHERE k = 800),
q_coefs AS (
  {_each("SELECT {i} AS place, b{i} AS b FROM q_end", ALL[1:], " UNION ALL ")}
)
"""
ODDS_RATIOS = f"""
SELECT feature, round(b, 3) + 0.0::DOUBLE AS coef, round(exp(b), 3) AS odds_ratio
FROM q_coefs JOIN (VALUES {", ".join(f"({i}, '{name}')" for i, name in enumerate(SHOWN, 1))})
  AS names(place, feature) USING (place)
"""
RISKS = f"""
SELECT USUBJID, SITEID, round(1 / (1 + exp(-(b0 + {_each("b{i} * x{i}", ALL[1:], " + ")}))), 3) AS risk
FROM q_design, q_end
"""

# --- Loading ---

TIDY = """
SELECT nullif(regexp_replace(c_name, '^\\s+|\\s+$', '', 'g'), '') AS c_name,
       nullif(regexp_replace(c_mktsegment, '^\\s+|\\s+$', '', 'g'), '') AS c_mktsegment,
       c_custkey
FROM (
  SELECT c_custkey,
         CASE c_custkey % 7 WHEN 0 THEN '  ' || c_name || '   ' WHEN 1 THEN chr(9) || c_name || chr(10)
                            ELSE c_name END AS c_name,
         CASE c_custkey % 7 WHEN 2 THEN '' WHEN 3 THEN '    ' WHEN 4 THEN c_mktsegment || '  '
                            ELSE c_mktsegment END AS c_mktsegment
  FROM customer)
"""
SAS_DATES = """
SELECT o_orderkey,
       CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS "TRTSDT",
       strftime(o_orderdate::DATE - 20000, '%Y-%m-%d') AS "VISIT1DT"
FROM orders
"""
REPORT = " UNION ALL ".join(
    f"SELECT '{name}' AS \"domain\", count(*) AS n_rows, {width}::BIGINT AS n_columns, "
    f"count(DISTINCT USUBJID) AS n_subjects, "
    f"count(*) FILTER (WHERE USUBJID IS NULL) AS n_without_subject FROM {name}"
    # Columns of each domain in the binding.
    for name, width in (("dm", 6), ("ds", 3), ("sv", 5), ("ae", 9), ("ex", 3), ("adsl", 12))
)


def oracle_sql() -> dict[str, str]:
    out = {
        "tidy_blanks": TIDY,
        "sas_dates": SAS_DATES,
        "load_report": _over_domains(REPORT),
        "site_enrolment": _over_domains("SELECT * FROM q_sites", SITES),
        "enrolment_over_time": _over_domains(MONTHS),
        "disposition": _over_domains("SELECT * FROM q_outcomes", OUTCOMES),
        "retention_by_visit": _over_domains(RETENTION),
        "visit_windows": _over_domains("SELECT * FROM q_windows", _windows(7)),
        "visit_windows_3": _over_domains("SELECT * FROM q_windows", _windows(3)),
        "visit_windows_14": _over_domains("SELECT * FROM q_windows", _windows(14)),
        "ae_by_site": _over_domains(AE_SITES),
        "ae_by_body_system": _over_domains("SELECT * FROM q_systems", BODY_SYSTEMS),
        "view_orders": _over_domains(
            ORDERS,
            SITES,
            OUTCOMES,
            f"q_retention AS ({RETENTION})",
            _windows(7),
            f"q_ae_sites AS ({AE_SITES})",
            BODY_SYSTEMS,
        ),
        "ae_by_body_system_estimated": _over_domains(
            "SELECT arm, body_system, subjects_with_ae, TRUE AS within_bound FROM q_systems", BODY_SYSTEMS
        ),
        "retention_by_visit_estimated": _over_domains(
            "SELECT arm, visitnum, visit, planned_day, attended, TRUE AS within_bound FROM q_retention",
            f"q_retention AS ({RETENTION})",
        ),
    }
    for check_id in ALL_CHECKS:
        out[f"check_{check_id.lower()}"] = _checks("SELECT * FROM q_listing", check_id)
    summary = """
        SELECT check_id, severity, description, coalesce(n, 0) AS issues
        FROM q_checks LEFT JOIN (SELECT check_id, count(*) AS n FROM q_listing GROUP BY ALL)
          USING (check_id)"""
    out |= {
        "run_checks": _checks("SELECT * FROM q_listing"),
        "run_checks_subset": _checks("SELECT * FROM q_listing", "AE02", "SV02", "EX01"),
        "check_summary": _checks(summary),
        "issues_by_site_severity": _checks(
            'SELECT SITEID, severity, count(*) AS "size" FROM q_listing GROUP BY ALL'
        ),
        "checks_fired": _checks("SELECT DISTINCT check_id FROM q_listing"),
        "issue_listing": _checks(
            "SELECT * FROM q_listing WHERE check_id = 'AE05' OR check_id = 'SV01'"
        ),
        "systemic_checks": _checks(
            """
            SELECT check_id, subjects, round(100.0::DOUBLE * subjects / total, 1) AS pct_of_subjects,
                   subjects = total AS systemic
            FROM (SELECT check_id, count(DISTINCT USUBJID) AS subjects
                  FROM q_checks LEFT JOIN q_listing USING (check_id) GROUP BY ALL),
                 (SELECT count(*) AS total FROM dm)"""
        ),
        "kpis": _over_domains(KPIS, SITES, OUTCOMES, CATALOGUE, _listing(*ALL_CHECKS)),
        "completion_by_arm": _over_domains(
            """
            SELECT arm, CASE WHEN disposition = 'COMPLETED' THEN disposition ELSE 'DISCONTINUED' END
                          AS status,
                   sum(subjects)::BIGINT AS subjects
            FROM q_outcomes GROUP BY ALL""",
            OUTCOMES,
        ),
        "site_view": _over_domains(
            """
            SELECT q_sites.*, scheduled_visits, out_of_window_pct
            FROM q_sites LEFT JOIN q_windows USING (site)""",
            SITES,
            _windows(7),
        ),
        "discontinuation_reasons": _over_domains(
            "SELECT * FROM q_outcomes WHERE disposition IS DISTINCT FROM 'COMPLETED'", OUTCOMES
        ),
        "top_body_systems": _over_domains(TOP_SYSTEMS, BODY_SYSTEMS),
        "landmark_kpis": _over_domains(
            """SELECT count(*) AS subjects, round(avg(discontinued), 6) AS share_discontinued
               FROM q_features""",
            FEATURES,
        ),
        "landmark_features": _over_domains("SELECT * FROM q_features", FEATURES),
        "imputed_features": _over_domains("SELECT * FROM q_imputed", FEATURES, IMPUTED),
        "scaled_features": _over_domains(
            f"SELECT USUBJID, {SCALED} FROM q_imputed", FEATURES, IMPUTED
        ),
        "design_matrix": _over_domains(
            f"SELECT USUBJID, {SCALED}, {DUMMIES} FROM q_imputed", FEATURES, IMPUTED
        ),
        "class_weights": _over_domains(
            """
            SELECT discontinued, count(*) AS subjects,
                   round((SELECT count(*) FROM q_features) / (2.0::DOUBLE * count(*)), 6)
                     AS class_weight
            FROM q_features GROUP BY ALL""",
            FEATURES,
        ),
        "cv_folds": _over_domains(FOLDS, FEATURES),
        "auc_of_score": _over_domains(AUC, FEATURES, SCORED),
        "balanced_accuracy_of_score": _over_domains(BALANCED, FEATURES, SCORED),
        "cv_of_score": _over_domains(CV_OF_SCORE, FEATURES, FOLD_SCORED),
        "odds_ratios": _over_domains(ODDS_RATIOS, FEATURES, IMPUTED, DESIGN, DESCENT),
        "odds_ratio_direction": _over_domains(
            ODDS_RATIOS.replace(
                "FROM q_coefs", ", CASE WHEN b > 0 THEN 'Raises risk' ELSE 'Lowers risk' END AS direction FROM q_coefs"
            ),
            FEATURES,
            IMPUTED,
            DESIGN,
            DESCENT,
        ),
        "score_subjects": _over_domains(RISKS, FEATURES, IMPUTED, DESIGN, DESCENT),
    }
    return out
