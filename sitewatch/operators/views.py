"""The seven analytic views of a running trial.

Event domains (ds, sv, ae) are folded to one row per subject and category
before they meet a subject table, so a subject with very many events reaches
the join as a few rows. No join is hinted: the optimizer broadcasts a side
whose measured size is below its threshold and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewatch.functions.dates import study_day
from sitewatch.functions.text import starts_with_any_case

SCREEN_FAILURE = "Scrnfail"
DISPOSITION_EVENT = "DISPOSITION EVENT"


def percent(part: Column, whole: Column, places: int = 1) -> Column:
    return F.round(F.lit(100.0) * part / whole, places)


def is_week_visit(visit: Column) -> Column:
    return starts_with_any_case(visit, "WEEK")


def site_enrolment(dm: DataFrame) -> DataFrame:
    """Screened, randomised and failed subjects per site, ranked by randomised."""
    sites = dm.groupBy(F.col("SITEID").alias("site")).agg(
        F.count("*").alias("screened"),
        F.count_if(F.col("ARMCD") != SCREEN_FAILURE).alias("randomised"),
        F.count_if(F.col("ARMCD") == SCREEN_FAILURE).alias("screen_failures"),
    )
    # One row per site by now, so the unpartitioned window is small.
    by_size = Window.orderBy(F.desc("randomised"))
    return sites.select(
        "*",
        percent(F.col("screen_failures"), F.col("screened")).alias("screen_fail_pct"),
        F.rank().over(by_size).cast("bigint").alias("enrolment_rank"),
    ).orderBy("enrolment_rank", "site")


def enrolment_over_time(dm: DataFrame) -> DataFrame:
    """Subjects entering per month, and the running total."""
    months = (
        dm.filter(F.col("RFSTDTC").isNotNull())
        .groupBy(F.substring("RFSTDTC", 1, 7).alias("month"))
        .agg(F.count("*").alias("randomised"))
    )
    return months.withColumn(
        "cumulative_randomised", F.sum("randomised").over(Window.orderBy("month"))
    ).orderBy("month")


def disposition(ds: DataFrame, adsl: DataFrame) -> DataFrame:
    """End-of-study events by planned arm, with their share of the arm's events."""
    events = (
        ds.filter(F.col("DSCAT") == DISPOSITION_EVENT)
        .groupBy("USUBJID", F.col("DSDECOD").alias("disposition"))
        .agg(F.count("*").alias("events"))
    )
    counts = (
        events.join(adsl.select("USUBJID", F.col("TRT01P").alias("arm")), "USUBJID")
        .groupBy("arm", "disposition")
        .agg(F.sum("events").alias("subjects"))
    )
    arm_total = F.sum("subjects").over(Window.partitionBy("arm"))
    return counts.withColumn("pct_of_arm", percent(F.col("subjects"), arm_total)).orderBy(
        "arm", F.desc("subjects"), "disposition"
    )


def retention_by_visit(sv: DataFrame, adsl: DataFrame) -> DataFrame:
    """Distinct subjects at each scheduled visit against the size of their arm."""
    visits = (
        sv.filter((F.col("VISIT") == "BASELINE") | is_week_visit(F.col("VISIT")))
        .select(
            "USUBJID",
            F.col("VISITNUM").alias("visitnum"),
            F.col("VISIT").alias("visit"),
            F.col("VISITDY").alias("planned_day"),
        )
        .distinct()
    )
    members = adsl.select("USUBJID", F.col("TRT01P").alias("arm"))
    attended = (
        visits.join(members.distinct(), "USUBJID")
        .groupBy("arm", "visitnum", "visit", "planned_day")
        .agg(F.count("*").alias("attended"))
    )
    sizes = members.groupBy("arm").agg(F.count("*").alias("arm_size"))
    return (
        attended.join(sizes, "arm")
        .withColumn("pct_retained", percent(F.col("attended"), F.col("arm_size")))
        .drop("arm_size")
        .orderBy("arm", "visitnum", "visit", "planned_day")
    )


def visit_windows(sv: DataFrame, dm: DataFrame, window_days: float = 7) -> DataFrame:
    """Week visits held more than ``window_days`` off their planned study day.

    A visit without a usable date counts as scheduled, never as out of window.
    """
    deviation = (
        study_day(F.col("SVSTDTC"), F.col("RFSTDTC")).cast("int") - F.col("VISITDY")
    )
    visits = (
        sv.filter(is_week_visit(F.col("VISIT")))
        .select("USUBJID", "SVSTDTC", "VISITDY")
        .join(dm.select("USUBJID", "SITEID", "RFSTDTC"), "USUBJID")
        .select(F.col("SITEID").alias("site"), deviation.alias("deviation"))
    )
    sites = visits.groupBy("site").agg(
        F.count("*").alias("scheduled_visits"),
        F.count_if(F.abs("deviation") > window_days).alias("out_of_window"),
        # Adding zero turns a rounded -0.0 into 0.0.
        (F.round(F.avg("deviation"), 1) + F.lit(0.0)).alias("mean_deviation_days"),
    )
    return sites.select(
        "site",
        "scheduled_visits",
        "out_of_window",
        percent(F.col("out_of_window"), F.col("scheduled_visits")).alias("out_of_window_pct"),
        "mean_deviation_days",
    ).orderBy(F.desc("out_of_window_pct"), "site")


def ae_by_site(ae: DataFrame, adsl: DataFrame) -> DataFrame:
    """Adverse events per randomised subject, and the share with a severe or serious one."""
    grave = (F.col("AESEV") == "SEVERE") | (F.col("AESER") == "Y")
    per_subject = ae.groupBy("USUBJID").agg(
        F.count("*").alias("n_ae"), F.max(F.when(grave, 1).otherwise(0)).alias("grave")
    )
    # Grouping by subject as well costs no exchange: rows already sit by subject.
    members = (
        adsl.select("USUBJID", F.col("SITEID").alias("site"))
        .join(per_subject, "USUBJID", "left")
        .groupBy("site", "USUBJID")
        .agg(
            F.count("*").alias("members"),
            F.sum("n_ae").alias("n_ae"),
            F.max("grave").alias("grave"),
        )
    )
    known_site = F.col("site").isNotNull()
    totals = members.groupBy("site").agg(
        F.sum("members").alias("n_subjects"),
        F.coalesce(F.sum(F.when(known_site, F.col("n_ae"))), F.lit(0)).alias("total_aes"),
        F.coalesce(F.sum(F.when(known_site, F.col("grave"))), F.lit(0)).alias("grave"),
    )
    per_head = F.round(F.lit(1.0) * F.col("total_aes") / F.col("n_subjects"), 2)
    return totals.select(
        "site",
        "n_subjects",
        "total_aes",
        per_head.alias("aes_per_subject"),
        percent(F.col("grave"), F.col("n_subjects")).alias("pct_severe_or_serious"),
    ).orderBy(F.desc("aes_per_subject"), "site")


def ae_by_body_system(ae: DataFrame, adsl: DataFrame) -> DataFrame:
    """Distinct subjects with an adverse event, by arm and body system."""
    affected = ae.select("USUBJID", F.col("AEBODSYS").alias("body_system")).distinct()
    members = adsl.select("USUBJID", F.col("TRT01P").alias("arm")).distinct()
    return (
        affected.join(members, "USUBJID")
        .groupBy("arm", "body_system")
        .agg(F.count("*").alias("subjects_with_ae"))
        .orderBy(F.desc("subjects_with_ae"), "arm", "body_system")
    )
