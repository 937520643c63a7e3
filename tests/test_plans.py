"""What the plans must look like, whatever the data."""

import re

import pytest

from sitewatch.plans import jobs, registry
from sitewatch.sources.binding import bind

# These learn first; what they return is a plain projection of that.
LEARNING = {"odds_ratios", "odds_ratio_direction", "score_subjects", "cv_results"}
LAZY = sorted(set(registry.over_domains()) - LEARNING)


@pytest.fixture(scope="module")
def stored(spark, small, tmp_path_factory):
    return jobs.load_domains(bind(spark, small), str(tmp_path_factory.mktemp("stored")))


@pytest.fixture
def plan(stored, capsys):
    def text(name, mode="simple"):
        df = registry.over_domains()[name](stored)
        capsys.readouterr()
        df.explain(mode)
        return capsys.readouterr().out

    return text


def scans(text, table):
    return re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*stored\d*/{table}\b", text)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(plan, name):
    text = plan(name)
    for operator in ("CartesianProduct", "NestedLoopJoin", "ArrowEval", "BatchEvalPython", "MapIn"):
        assert operator not in text


def test_all_event_checks_share_one_scan(plan):
    text = plan("run_checks")
    assert len(scans(text, "ae")) == 1
    assert len(scans(text, "ex")) == len(scans(text, "ds")) == 1


def test_visit_order_takes_one_scan(stored):
    df = registry.over_domains()["check_sv02"](stored)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # A reused exchange is printed without what lies below it.
    assert len(scans(final, "sv")) == 1


def test_only_needed_columns_are_read(plan):
    def columns(name, table):
        return {re.sub(r"#\d+", "", c) for c in scans(plan(name), table)[0].split(",")}

    assert columns("site_enrolment", "dm") == {"SITEID", "ARMCD"}
    assert columns("check_ex01", "ex") == {"USUBJID"}
    assert columns("ae_by_body_system", "ae") == {"USUBJID", "AEBODSYS"}
    assert columns("visit_windows", "sv") == {"USUBJID", "VISIT", "SVSTDTC", "VISITDY"}


def test_filters_reach_the_scan(plan):
    pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", plan("disposition", "formatted"))
    assert any("EqualTo(DSCAT,DISPOSITION EVENT)" in p for p in pushed)
    pushed = re.findall(r"PushedFilters: \[(.*?)\]\n", plan("landmark_features", "formatted"))
    assert any("LessThanOrEqual(AESTDY,14.0)" in p for p in pushed)


@pytest.mark.parametrize("name, table", [
    ("ae_by_site", "ae"), ("ae_by_body_system", "ae"), ("disposition", "ds"),
    ("retention_by_visit", "sv"), ("check_ex01", "ex"), ("landmark_features", "ae"),
])
def test_events_are_folded_before_their_first_exchange(plan, name, table):
    """Read upwards from the scan: an aggregate comes before any exchange."""
    lines = plan(name).splitlines()
    at = next(i for i, line in enumerate(lines) if re.search(rf"stored\d*/{table}\b", line))
    above = [line for line in reversed(lines[:at])]
    first = next(line for line in above if "Aggregate" in line or "Exchange" in line)
    assert "Aggregate" in first
