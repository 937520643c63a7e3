"""Edit checks: rules declared as data, run together in few passes.

Checks on the records of one domain share one scan of it, whatever their
number, and only records that fail something go on to meet ``dm``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.functions.text import text_sql
from sitewatch.sources.tables import Domains

LISTING_COLUMNS = (
    "check_id",
    "severity",
    "domain",
    "description",
    "USUBJID",
    "SITEID",
    "detail",
)

# A subject's records are compared in pieces this wide in record numbers.
STEPS_PER_PIECE = 100_000


@dataclass(frozen=True)
class RecordRule:
    """A record fails where ``when`` is true; both texts are SQL expressions.

    ``subject_columns`` names columns of ``dm`` the expressions need beside
    those of ``table``.
    """

    table: str
    when: str
    detail: str
    subject_columns: tuple[str, ...] = ()


@dataclass(frozen=True)
class SequenceRule:
    """A record fails where its date lies before that of the record before it."""

    table: str
    order: str
    date: str
    label: str


@dataclass(frozen=True)
class AbsenceRule:
    """A subject of ``expected`` fails without any record of ``evidence``."""

    expected: str
    evidence: str
    detail: str
    evidence_when: str = "true"


@dataclass(frozen=True)
class QueryRule:
    """Any SQL over ``{dm}``, ``{ae}`` ... giving USUBJID, SITEID and detail."""

    sql: str
    tables: tuple[str, ...]


Rule = RecordRule | SequenceRule | AbsenceRule | QueryRule


@dataclass(frozen=True)
class EditCheck:
    check_id: str
    domain: str
    severity: str
    description: str
    rule: Rule


# Ids, domains, severities, descriptions and the wording of details.
CHECKS: tuple[EditCheck, ...] = (
    EditCheck(
        "DM01", "DM", "High", "Informed consent date missing for a screened subject",
        RecordRule("dm", "RFICDTC IS NULL", "'RFICDTC is blank'"),
    ),
    EditCheck(
        "AE01", "AE", "Medium",
        "Adverse event start date is partial (day and/or month missing)",
        RecordRule(
            "ae", "length(AESTDTC) < 10", "concat(AETERM, ': start date recorded as ', AESTDTC)"
        ),
    ),
    EditCheck(
        "AE02", "AE", "High", "Adverse event end date is before its start date",
        RecordRule(
            "ae",
            "length(AEENDTC) = 10 AND length(AESTDTC) = 10 AND AEENDTC < AESTDTC",
            "concat(AETERM, ': ', AESTDTC, ' -> ', AEENDTC)",
        ),
    ),
    EditCheck(
        "AE03", "AE", "Medium",
        "Adverse event started before first dose - confirm it is not medical history",
        RecordRule(
            "ae", "AESTDY < 1", "concat(AETERM, ': study day ', cast(cast(AESTDY AS int) AS string))"
        ),
    ),
    EditCheck(
        "AE04", "AE", "Medium",
        "Adverse event recorded as ongoing (no end date) but outcome says recovered",
        RecordRule(
            "ae",
            "AEENDTC IS NULL AND AEOUT ILIKE 'RECOVERED%'",
            "concat(AETERM, ' (outcome: ', AEOUT, ')')",
        ),
    ),
    EditCheck(
        "AE05", "AE", "Medium",
        "Adverse event has an end date but outcome says not recovered/not resolved",
        RecordRule(
            "ae",
            "AEENDTC IS NOT NULL AND AEOUT = 'NOT RECOVERED/NOT RESOLVED'",
            "concat(AETERM, ' ended ', AEENDTC, ' but outcome: ', AEOUT)",
        ),
    ),
    EditCheck(
        "SV01", "SV", "Medium", "Scheduled visit dated after the subject's end of study",
        RecordRule(
            "sv",
            "SVSTDTC > RFPENDTC",
            "concat(VISIT, ' on ', SVSTDTC, ', study end ', RFPENDTC)",
            subject_columns=("RFPENDTC",),
        ),
    ),
    EditCheck(
        "SV02", "SV", "Low",
        "Visit dates out of sequence (later visit number with an earlier date)",
        SequenceRule("sv", order="VISITNUM", date="SVSTDTC", label="VISIT"),
    ),
    EditCheck(
        "DS01", "DS", "High", "Randomised subject with no end-of-study disposition record",
        AbsenceRule(
            "adsl", "ds", "no DSCAT = DISPOSITION EVENT row", "DSCAT = 'DISPOSITION EVENT'"
        ),
    ),
    EditCheck(
        "EX01", "EX", "High", "Randomised subject with no dosing record",
        AbsenceRule("adsl", "ex", "no rows in EX"),
    ),
)


def select_checks(*check_ids: str) -> tuple[EditCheck, ...]:
    """Checks of the catalogue by id, in catalogue order."""
    unknown = set(check_ids) - {c.check_id for c in CHECKS}
    if unknown:
        raise KeyError(f"unknown checks: {sorted(unknown)}")
    return tuple(c for c in CHECKS if c.check_id in check_ids)


def catalogue(spark: SparkSession, checks: Sequence[EditCheck]) -> DataFrame:
    """The checks themselves as a small frame, one row each."""
    table = pa.table(
        {
            "position": pa.array(range(len(checks)), pa.int64()),
            "check_id": pa.array([c.check_id for c in checks], pa.string()),
            "severity": pa.array([c.severity for c in checks], pa.string()),
            "domain": pa.array([c.domain for c in checks], pa.string()),
            "description": pa.array([c.description for c in checks], pa.string()),
        }
    )
    return spark.createDataFrame(table)


def _about(checks: Sequence[EditCheck]) -> Column:
    """Severity, domain and description of ``check_id``, looked up in a literal map."""
    entries = ", ".join(
        f"{text_sql(c.check_id)}, named_struct('severity', {text_sql(c.severity)}, "
        f"'domain', {text_sql(c.domain)}, 'description', {text_sql(c.description)})"
        for c in checks
    )
    return F.expr(f"map({entries})[check_id]")


def _record_hits(records: DataFrame, checks: list[EditCheck], *ids: str) -> DataFrame:
    """All checks on the records of one table, in one pass over it."""
    fails = [F.expr(c.rule.when) for c in checks]
    # A NULL condition is no hit, a NULL detail still is one.
    findings = F.array_compact(
        F.array(
            *(
                F.when(
                    fail,
                    F.struct(
                        F.lit(c.check_id).alias("check_id"), F.expr(c.rule.detail).alias("detail")
                    ),
                )
                for fail, c in zip(fails, checks)
            )
        )
    )
    return records.filter(reduce(Column.__or__, fails)).select(*ids, F.inline(findings))


def _sequence_hits(domains: Domains, check: EditCheck) -> DataFrame:
    """Records dated before their predecessor in (subject, order)."""
    rule = check.rule
    records = (
        domains[rule.table]
        .select(
            "USUBJID",
            F.col(rule.order).alias("step"),
            F.col(rule.date).alias("date"),
            F.col(rule.label).alias("label"),
        )
        .filter(F.col("USUBJID").isNotNull())
    )
    detail = F.concat(
        F.col("label"), F.lit(" ("), F.col("date"), F.lit(") is before "),
        F.col("before.label"), F.lit(" ("), F.col("before.date"), F.lit(")"),
    )
    return (
        _pairs(records)
        .filter(F.col("date") < F.col("before.date"))
        .select("USUBJID", F.lit(check.check_id).alias("check_id"), detail.alias("detail"))
    )


def _pairs(records: DataFrame) -> DataFrame:
    """The pairs that can be out of sequence, without a subject's records in one task.

    Records of one number are sorted by date and label, so only the first of them can be
    early, and only the last can be a predecessor. That leaves one row per
    (subject, number), folded before any shuffle. The numbers are then cut
    into pieces, and what crosses a cut is compared piece by piece.
    """
    record = F.struct("date", "label")
    steps = (
        records.groupBy("USUBJID", "step")
        .agg(F.min(record).alias("first"), F.max(record).alias("last"))
        .withColumn("piece", F.floor(F.col("step") / STEPS_PER_PIECE))
    )
    within = Window.partitionBy("USUBJID", "piece").orderBy("step")
    inner = steps.select("USUBJID", "first", F.lag("last").over(within).alias("before"))
    pieces = steps.groupBy("USUBJID", "piece").agg(
        F.min(F.struct("step", "first")).alias("head"),
        F.max(F.struct("step", "last")).alias("tail"),
    )
    across = Window.partitionBy("USUBJID").orderBy("piece")
    outer = pieces.select(
        "USUBJID",
        F.col("head.first").alias("first"),
        F.lag("tail.last").over(across).alias("before"),
    )
    return inner.unionByName(outer).select("USUBJID", "first.date", "first.label", "before")


def _absence_hits(domains: Domains, check: EditCheck) -> DataFrame:
    rule = check.rule
    # Folding the evidence first shuffles one row per subject and task, and
    # leaves it placed for the anti join.
    seen = domains[rule.evidence].filter(rule.evidence_when).select("USUBJID").distinct()
    return (
        domains[rule.expected]
        .select("USUBJID", "SITEID")
        .join(seen, "USUBJID", "left_anti")
        .select(
            "USUBJID",
            "SITEID",
            F.lit(check.check_id).alias("check_id"),
            F.lit(rule.detail).alias("detail"),
        )
    )


def _query_hits(domains: Domains, check: EditCheck) -> DataFrame:
    rule = check.rule
    frames = {name: domains[name] for name in rule.tables}
    return SparkSession.active().sql(rule.sql, **frames).select(
        "USUBJID", "SITEID", F.lit(check.check_id).alias("check_id"), "detail"
    )


def run_checks(domains: Domains, checks: Sequence[EditCheck] = CHECKS) -> DataFrame:
    """One row per problem found by any of ``checks``.

    ``placed`` hits know their site already; the others are collected first
    and meet ``dm`` in one join.
    """
    spark = SparkSession.active()
    if not checks:
        return spark.createDataFrame(
            [], T.StructType([T.StructField(c, T.StringType()) for c in LISTING_COLUMNS])
        )
    placed, unplaced = [], []
    by_record: dict[tuple[str, tuple[str, ...]], list[EditCheck]] = {}
    for check in checks:
        rule = check.rule
        if isinstance(rule, RecordRule):
            by_record.setdefault((rule.table, rule.subject_columns), []).append(check)
        elif isinstance(rule, SequenceRule):
            unplaced.append(_sequence_hits(domains, check))
        elif isinstance(rule, AbsenceRule):
            placed.append(_absence_hits(domains, check))
        else:
            placed.append(_query_hits(domains, check))
    for (table, subject_columns), group in by_record.items():
        if table == "dm":
            placed.append(_record_hits(domains["dm"], group, "USUBJID", "SITEID"))
        elif subject_columns:
            subjects = domains["dm"].select("USUBJID", "SITEID", *subject_columns)
            records = domains[table].drop("SITEID", *subject_columns).join(subjects, "USUBJID")
            placed.append(_record_hits(records, group, "USUBJID", "SITEID"))
        else:
            unplaced.append(_record_hits(domains[table], group, "USUBJID"))
    if unplaced:
        sites = domains["dm"].select("USUBJID", "SITEID")
        placed.append(reduce(DataFrame.unionByName, unplaced).join(sites, "USUBJID"))
    hits = reduce(DataFrame.unionByName, placed)
    return hits.withColumn("about", _about(checks)).select(
        "check_id",
        *(F.col("about")[c].alias(c) for c in ("severity", "domain", "description")),
        "USUBJID",
        "SITEID",
        "detail",
    )


def summarise(listing: DataFrame, checks: Sequence[EditCheck] = CHECKS) -> DataFrame:
    """Problems per check in catalogue order, zeros included."""
    counts = listing.groupBy("check_id").agg(F.count("*").alias("n"))
    return (
        catalogue(listing.sparkSession, checks)
        .join(counts, "check_id", "left")
        .orderBy("position")
        .select("check_id", "severity", "description", F.coalesce("n", F.lit(0)).alias("issues"))
    )


def issues_by_site_severity(listing: DataFrame) -> DataFrame:
    return (
        listing.filter(F.col("SITEID").isNotNull() & F.col("severity").isNotNull())
        .groupBy("SITEID", "severity")
        .agg(F.count("*").alias("size"))
        .orderBy("SITEID", "severity")
    )


def checks_fired(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("issues") > 0).select("check_id")


def issue_listing(listing: DataFrame, chosen: Sequence[str] = ()) -> DataFrame:
    """The listing for the chosen checks, or all of it if none is chosen."""
    return listing.filter(F.col("check_id").isin(*chosen)) if chosen else listing


def systemic_checks(
    listing: DataFrame, dm: DataFrame, checks: Sequence[EditCheck] = CHECKS
) -> DataFrame:
    """Share of subjects each check fires for; all of them means one systemic cause."""
    hit = listing.groupBy("check_id").agg(F.count_distinct("USUBJID").alias("n"))
    total = dm.agg(F.count_distinct("USUBJID")).scalar()
    subjects = F.coalesce("n", F.lit(0))
    return (
        catalogue(listing.sparkSession, checks)
        .join(hit, "check_id", "left")
        .orderBy("position")
        .select(
            "check_id",
            subjects.alias("subjects"),
            F.round(F.try_divide(F.lit(100.0) * subjects, total), 1).alias("pct_of_subjects"),
            ((subjects > 0) & (subjects == total)).alias("systemic"),
        )
    )
