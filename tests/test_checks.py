import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitewatch.operators import checks as C
from sitewatch.sources.binding import bind
from tests.planted import domains, rows

# Per check: the rows to plant, and the details they must raise for the subject.
PLANTED = {
    "DM01": (dict(dm=[dict(USUBJID="S1", RFICDTC=None)]), ["RFICDTC is blank"]),
    "AE01": (dict(ae=[dict(AESTDTC="2014-03", AEENDTC="2014-03-09")]),
             ["RASH: start date recorded as 2014-03"]),
    "AE02": (dict(ae=[dict(AESTDTC="2014-03-10", AEENDTC="2014-03-01")]),
             ["RASH: 2014-03-10 -> 2014-03-01"]),
    "AE03": (dict(ae=[dict(AESTDY=-3.0), dict(AESTDY=0.9)]),
             ["RASH: study day -3", "RASH: study day 0"]),
    "AE04": (dict(ae=[dict(AEENDTC=None), dict(AEENDTC=None, AEOUT="Recovered")]),
             ["RASH (outcome: RECOVERED/RESOLVED)", "RASH (outcome: Recovered)"]),
    "AE05": (dict(ae=[dict(AEOUT="NOT RECOVERED/NOT RESOLVED")]),
             ["RASH ended 2014-01-09 but outcome: NOT RECOVERED/NOT RESOLVED"]),
    "SV01": (dict(sv=[dict(VISIT="UNSCHEDULED 9", VISITNUM=9.0, SVSTDTC="2014-07-01")]),
             ["UNSCHEDULED 9 on 2014-07-01, study end 2014-06-30"]),
    "SV02": (dict(sv=[dict(VISIT="WEEK 4", VISITNUM=5.0, SVSTDTC="2014-01-10")]),
             ["WEEK 4 (2014-01-10) is before WEEK 2 (2014-01-15)"]),
    "DS01": (dict(adsl=[dict(USUBJID="S1")], ex=[dict(USUBJID="S1")],
                  ds=[dict(USUBJID="S1", DSCAT="PROTOCOL MILESTONE")]),
             ["no DSCAT = DISPOSITION EVENT row"]),
    "EX01": (dict(adsl=[dict(USUBJID="S1")], ds=[dict(USUBJID="S1")]), ["no rows in EX"]),
}


@pytest.mark.parametrize("check_id", PLANTED)
def test_planted_rows_and_only_they_are_found(spark, check_id):
    extra, details = PLANTED[check_id]
    found = C.run_checks(domains(spark, **extra)).collect()
    assert {r["check_id"] for r in found} == {check_id}
    assert sorted(r["detail"] for r in found) == sorted(details)
    assert {r["SITEID"] for r in found} == {"701"}
    check = next(c for c in C.CHECKS if c.check_id == check_id)
    assert {(r["severity"], r["domain"], r["description"]) for r in found} == {
        (check.severity, check.domain, check.description)
    }


def test_clean_domains_raise_nothing(spark):
    listing = C.run_checks(domains(spark))
    assert rows(listing) == []
    assert tuple(listing.columns) == C.LISTING_COLUMNS
    summary = C.summarise(listing).collect()
    assert [r["check_id"] for r in summary] == [c.check_id for c in C.CHECKS]
    assert {r["issues"] for r in summary} == {0}
    assert rows(C.checks_fired(C.summarise(listing))) == []


def test_no_checks_give_a_typed_empty_listing(spark):
    listing = C.run_checks(domains(spark), [])
    assert tuple(listing.columns) == C.LISTING_COLUMNS and rows(listing) == []


def test_a_check_reads_only_its_own_columns(spark):
    tiny = {
        "dm": spark.createDataFrame([("S1", "701")], "USUBJID string, SITEID string"),
        "ae": spark.createDataFrame(
            [("S1", "HEADACHE", "2014-03-10", "2014-03-01")],
            "USUBJID string, AETERM string, AESTDTC string, AEENDTC string",
        ),
    }
    found = C.run_checks(tiny, C.select_checks("AE02")).collect()
    assert [(r["USUBJID"], r["SITEID"]) for r in found] == [("S1", "701")]


def test_null_condition_is_no_hit_but_null_detail_is(spark):
    trouble = [
        dict(AESTDTC=None, AEENDTC=None, AESTDY=None, AEOUT=None),
        dict(AETERM=None, AESTDY=-1.0),
    ]
    found = C.run_checks(domains(spark, ae=trouble)).collect()
    assert [(r["check_id"], r["detail"]) for r in found] == [("AE03", None)]


def test_text_dates_compare_as_text(spark):
    # Partial dates take part in SV01 and SV02, not in AE02.
    visits = [dict(VISITNUM=5.0, VISIT="WEEK 4", SVSTDTC="2014-01")]
    events = [dict(AESTDTC="2014-03-10", AEENDTC="2014-03")]
    found = C.run_checks(domains(spark, sv=visits, ae=events)).collect()
    assert [(r["check_id"], r["detail"]) for r in found] == [
        ("SV02", "WEEK 4 (2014-01) is before WEEK 2 (2014-01-15)")
    ]


def test_records_of_unknown_subjects_are_left_out(spark):
    found = C.run_checks(
        domains(spark, ae=[dict(USUBJID="GHOST", AESTDY=-1.0)],
                sv=[dict(USUBJID="GHOST", SVSTDTC="2020-01-01")])
    )
    assert rows(found) == []


def test_repeated_subject_rows_repeat_their_hits(spark):
    found = C.run_checks(
        domains(spark, dm=[dict(SITEID="702")], ae=[dict(AESTDY=-1.0)])
    ).collect()
    assert sorted(r["SITEID"] for r in found) == ["701", "702"]


def test_user_checks_are_data(spark):
    own = [
        C.EditCheck("X1", "AE", "Low", "Severe event of a \"quoted\" 'kind'",
                    C.RecordRule("ae", "AESEV = 'SEVERE'", "AETERM")),
        C.EditCheck("X2", "AE", "Low", "Event after the end of the study",
                    C.RecordRule("ae", "AESTDTC > RFPENDTC", "AESTDTC",
                                 subject_columns=("RFPENDTC",))),
        C.EditCheck("X3", "EX", "Low", "Any SQL",
                    C.QueryRule("""SELECT e.USUBJID, d.SITEID, concat('rows: ', count(*)) AS detail
                                   FROM {ex} e JOIN {dm} d USING (USUBJID)
                                   GROUP BY e.USUBJID, d.SITEID""", ("ex", "dm"))),
    ]
    d = domains(spark, ae=[dict(AESEV="SEVERE"), dict(AESTDTC="2015-01-01", AEENDTC="2015-01-02")])
    listing = C.run_checks(d, own)
    assert sorted((r["check_id"], r["detail"]) for r in listing.collect()) == [
        ("X1", "RASH"), ("X2", "2015-01-01"), ("X3", "rows: 1")
    ]
    assert [r["issues"] for r in C.summarise(listing, own).collect()] == [1, 1, 1]


def test_unknown_check_id():
    with pytest.raises(KeyError, match="ZZ99"):
        C.select_checks("AE01", "ZZ99")


def test_listing_filter_and_counts(spark, small):
    listing = C.run_checks(bind(spark, small)).persist()
    total = listing.count()
    summary = {r["check_id"]: r["issues"] for r in C.summarise(listing).collect()}
    assert sum(summary.values()) == total
    assert C.issue_listing(listing).count() == total
    assert C.issue_listing(listing, ["AE01"]).count() == summary["AE01"]
    assert sum(r["size"] for r in C.issues_by_site_severity(listing).collect()) == total
    listing.unpersist()


def test_shared_pass_equals_single_checks(spark, small):
    together = Counter(rows(C.run_checks(bind(spark, small))))
    alone = Counter()
    for check in C.CHECKS:
        alone.update(rows(C.run_checks(bind(spark, small), [check])))
    assert together == alone


def test_systemic_check_fires_for_every_subject(spark):
    d = domains(spark, clean=False, dm=[dict(USUBJID=f"S{i}", RFICDTC=None) for i in range(4)],
                ae=[dict(USUBJID="S1", AESTDY=-1.0), dict(USUBJID="S1", AESTDY=-2.0)])
    found = {
        r["check_id"]: tuple(r)[1:]
        for r in C.systemic_checks(C.run_checks(d), d["dm"]).collect()
    }
    assert found["DM01"] == (4, 100.0, True)
    assert found["AE03"] == (1, 25.0, False)
    assert found["EX01"] == (0, 0.0, False)


def brute_sequence(records):
    """Lag over (number, date, label), missing first, written out in Python."""
    def key(r):
        return tuple((v is not None, v if v is not None else 0) for v in r[1:])

    hits = Counter()
    for subject in {r[0] for r in records}:
        own = sorted((r for r in records if r[0] == subject), key=key)
        for before, here in zip(own, own[1:]):
            if before[2] is not None and here[2] is not None and here[2] < before[2]:
                parts = (here[3], here[2], before[3], before[2])
                detail = None if None in parts else "{} ({}) is before {} ({})".format(*parts)
                hits[subject, detail] += 1
    return hits


@pytest.mark.parametrize("seed, width", [(0, 100_000), (0, 8), (1, 30), (2, 1)])
def test_sequence_equals_brute_force(spark, seed, width, monkeypatch):
    """Ties, copies, missing numbers, subjects cut into pieces."""
    monkeypatch.setattr(C, "STEPS_PER_PIECE", width)
    rng = random.Random(seed)
    dates = [None, "2014", "2014-02"] + [f"2014-02-{d:02d}" for d in range(1, 29)]
    records = []
    for subject, n in (("HOT", 400), ("A", 3), ("B", 40), ("C", 1)):
        for _ in range(n):
            number = rng.choice([None, 99.0, float(rng.randint(1, 90)), rng.randint(1, 900) / 10])
            records.append((subject, number, rng.choice(dates), rng.choice(["V1", "V2", None])))
    records += rng.choices(records, k=100)
    sv = spark.createDataFrame(
        records, "USUBJID string, VISITNUM double, SVSTDTC string, VISIT string"
    )
    dm = sv.select("USUBJID", F.lit("701").alias("SITEID")).distinct()
    found = C.run_checks({"sv": sv, "dm": dm}, C.select_checks("SV02")).collect()
    assert Counter((r["USUBJID"], r["detail"]) for r in found) == brute_sequence(records)
