import sqlite3

import pytest
from pyspark.sql import functions as F

from sitewatch.functions.dates import study_day
from sitewatch.functions.text import title_case
from sitewatch.operators import checks, frames, views
from sitewatch.sources.binding import bind
from tests.planted import domains, rows

DATES = [
    "2014-03-01", "2014-03-02", "2013-12-31", "2014-03-01T10:30", "2014-03-02T10:29",
    "2014-03-02 10:30:15", "2014-03-05T23:59:59.5", "2014-03", "not a date", "", None,
    "2014-03-01T10:00Z", "2014-03-01T10:00+05:00", "2014-03-01T01:15:30.25-11:30", "2014-03-01 23:59 z",
    "2014-03-01T10:00+15:00", "2014-03-01T10:00+5:00", "2014-03-01T10:00 +00:45 ", "2014-03-01T10:00X",
]


def test_study_day_equals_sqlite(spark):
    pairs = [(a, b) for a in DATES for b in DATES]
    con = sqlite3.connect(":memory:")
    want = [con.execute("SELECT julianday(?) - julianday(?) + 1", p).fetchone()[0] for p in pairs]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    days = study_day(F.col("a"), F.col("b"))
    got = [r[0] for r in df.orderBy("i").select(days).collect()]
    assert got == want


def test_study_day_ignores_the_session_time_zone(spark):
    # New York changes its clocks between these dates.
    df = spark.createDataFrame([("2014-03-15T01:00", "2014-03-01T01:00")], "a string, b string")
    days = df.select(study_day(F.col("a"), F.col("b")))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert days.first()[0] == 15.0
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_impossible_and_year_only_dates_are_missing(spark):
    rows_in = [("2014-02-30",), ("2014",), ("2014-13-01",), ("2014-3-01",), ("2014-03-01T25:00",)]
    df = spark.createDataFrame(rows_in, "a string")
    days = study_day(F.col("a"), F.lit("2014-01-01"))
    assert {r[0] for r in df.select(days).collect()} == {None}


def test_title_case_equals_python(spark):
    words = ["skin and SUBCUTANEOUS", "o'brien 3rd-line", "x2y", "", "ärzte über ALLES", "a  b"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(title_case(F.col("w"))).collect()] == [w.title() for w in words]


def test_sites_add_up(spark, small):
    sites = views.site_enrolment(bind(spark, small)["dm"]).collect()
    assert all(s["screened"] == s["randomised"] + s["screen_failures"] for s in sites)
    assert sum(s["screened"] for s in sites) == 150
    assert sum(s["randomised"] for s in sites) == 127


def test_missing_arm_counts_nowhere(spark):
    d = domains(spark, dm=[dict(USUBJID="S1", ARMCD=None), dict(USUBJID="S2", ARMCD="Scrnfail")])
    assert rows(views.site_enrolment(d["dm"])) == [("701", 3, 1, 1, 33.3, 1)]


def test_equal_sites_share_a_rank(spark):
    dm = [dict(USUBJID=f"S{i}", SITEID=s) for i, s in enumerate(["702", "703", "703", "704"])]
    got = [(r["site"], r["enrolment_rank"])
           for r in views.site_enrolment(domains(spark, dm=dm)["dm"]).collect()]
    assert got == [("703", 1), ("701", 2), ("702", 2), ("704", 2)]


def test_cumulative_never_falls(spark, small):
    months = views.enrolment_over_time(bind(spark, small)["dm"]).collect()
    assert [m["month"] for m in months] == sorted(m["month"] for m in months)
    running = 0
    for m in months:
        running += m["randomised"]
        assert m["cumulative_randomised"] == running


def test_disposition_counts_events_and_shares_sum_up(spark, small):
    d = domains(spark, ds=[dict(DSDECOD="DEATH"), dict(DSDECOD="DEATH"), dict(DSCAT="OTHER")])
    got = [(r["disposition"], r["subjects"], r["pct_of_arm"])
           for r in views.disposition(d["ds"], d["adsl"]).collect()]
    assert got == [("DEATH", 2, 66.7), ("COMPLETED", 1, 33.3)]
    b = bind(spark, small)
    shares = {}
    for r in views.disposition(b["ds"], b["adsl"]).collect():
        shares[r["arm"]] = shares.get(r["arm"], 0) + r["pct_of_arm"]
    assert all(abs(s - 100) < 0.3 for s in shares.values())


def test_retention_counts_subjects_once(spark):
    visits = [dict(), dict(VISIT="Week 2"), dict(VISIT="UNSCHEDULED 4"), dict(VISIT="BASELINE"),
              dict(VISIT="baseline"), dict(USUBJID="S1"), dict(USUBJID="S1"), dict(VISIT=None)]
    d = domains(spark, sv=visits, adsl=[dict(USUBJID="S1"), dict(USUBJID="S2")])
    got = {(r["visit"], r["attended"], r["pct_retained"])
           for r in views.retention_by_visit(d["sv"], d["adsl"]).collect()}
    assert got == {("WEEK 2", 2, 66.7), ("Week 2", 1, 33.3), ("BASELINE", 1, 33.3)}


@pytest.mark.parametrize("window, out", [(3, 2), (7, 1), (14, 0)])
def test_visits_without_date_are_scheduled_but_not_out(spark, window, out):
    visits = [dict(SVSTDTC="2014-01-24"), dict(SVSTDTC="2014-01-19"), dict(SVSTDTC=None),
              dict(SVSTDTC="2014-01"), dict(VISIT="BASELINE", SVSTDTC="2014-09-09")]
    d = domains(spark, sv=visits)
    row = views.visit_windows(d["sv"], d["dm"], window).first()
    assert (row["scheduled_visits"], row["out_of_window"]) == (5, out)
    assert row["mean_deviation_days"] == pytest.approx(4.3)


def test_timed_visits_are_cut_to_whole_days(spark):
    d = domains(spark, clean=False, sv=[dict(SVSTDTC="2014-01-15T23:00")], dm=[dict()])
    assert views.visit_windows(d["sv"], d["dm"]).first()["mean_deviation_days"] == 0.0


def test_sites_without_events_are_kept(spark):
    d = domains(spark, adsl=[dict(USUBJID="S1", SITEID="702"), dict(USUBJID="S2", SITEID=None)],
                ae=[dict(AESEV="SEVERE"), dict(AESER="Y"), dict(USUBJID="S2")])
    got = sorted(rows(views.ae_by_site(d["ae"], d["adsl"])), key=str)
    assert got == [("701", 1, 3, 3.0, 100.0), ("702", 1, 0, 0.0, 0.0), (None, 1, 0, 0.0, 0.0)]


def test_body_systems_count_subjects(spark):
    d = domains(spark, ae=[dict(), dict(USUBJID="S1"), dict(USUBJID="S1", AEBODSYS=None)],
                adsl=[dict(USUBJID="S1")])
    got = set(rows(views.ae_by_body_system(d["ae"], d["adsl"])))
    assert got == {("Placebo", "SKIN", 2), ("Placebo", None, 1)}
    top = rows(frames.top_body_systems(views.ae_by_body_system(d["ae"], d["adsl"])))
    assert top == [("Placebo", "Skin", 2)]


def test_repeated_adsl_rows_count_as_members_not_as_subjects(spark):
    d = domains(spark, adsl=[dict()])
    assert views.retention_by_visit(d["sv"], d["adsl"]).first()["attended"] == 1
    assert views.retention_by_visit(d["sv"], d["adsl"]).first()["pct_retained"] == 50.0
    assert rows(views.ae_by_site(d["ae"], d["adsl"])) == [("701", 2, 2, 1.0, 0.0)]
    assert rows(views.ae_by_body_system(d["ae"], d["adsl"])) == [("Placebo", "SKIN", 1)]


def test_top_systems_break_ties_by_name(spark):
    by_system = spark.createDataFrame(
        [("A", f"SYS {c}", 1) for c in "JIHGFEDCBA"] + [("B", "SYS J", 1)],
        "arm string, body_system string, subjects_with_ae bigint",
    )
    kept = {r["body_system"] for r in frames.top_body_systems(by_system).collect()}
    assert kept == {"Sys J", *(f"Sys {c}" for c in "ABCDEFG")}


def test_missing_reason_is_a_reason_but_missing_arm_is_no_bar(spark):
    outcomes = spark.createDataFrame(
        [("A", None, 1, 50.0), ("A", "COMPLETED", 1, 50.0), (None, "DEATH", 1, 100.0)],
        "arm string, disposition string, subjects bigint, pct_of_arm double",
    )
    assert frames.discontinuation_reasons(outcomes).count() == 2
    assert rows(frames.completion_by_arm(outcomes)) == [("A", "COMPLETED", 1), ("A", "DISCONTINUED", 1)]


def test_kpis_of_nobody(spark):
    d = domains(spark, clean=False)
    listing = checks.run_checks(d)
    row = frames.kpis(views.site_enrolment(d["dm"]), views.disposition(d["ds"], d["adsl"]), listing)
    assert rows(row) == [(0, 0, None, None, 0)]
    d = domains(spark, clean=False, dm=[dict(ARMCD="Scrnfail")])
    row = frames.kpis(views.site_enrolment(d["dm"]), views.disposition(d["ds"], d["adsl"]), listing)
    assert rows(row) == [(1, 0, 100.0, None, 0)]


def test_long_histories_are_numbered_alike(spark, small):
    whole, pieces = bind(spark, small)["sv"], bind(spark, small, piece_keys=5)["sv"]
    assert whole.exceptAll(pieces).count() == 0
    assert pieces.exceptAll(whole).count() == 0
