"""The frames behind each dashboard chart, built from views and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.text import title_case

COMPLETED = "COMPLETED"


def kpis(sites: DataFrame, outcomes: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: subjects, failure and completion rates, open data queries."""
    completed = F.when(F.col("disposition") == COMPLETED, F.col("subjects"))
    totals = sites.agg(
        F.coalesce(F.sum("screened"), F.lit(0)).alias("screened"),
        F.coalesce(F.sum("randomised"), F.lit(0)).alias("randomised"),
        F.lit(outcomes.agg(F.coalesce(F.sum(completed), F.lit(0))).scalar()).alias("completed"),
        F.lit(listing.agg(F.count("*")).scalar()).alias("open_queries"),
    )
    kept = F.try_divide(F.col("randomised").cast("double"), F.col("screened"))
    finished = F.try_divide(F.lit(100.0) * F.col("completed"), F.col("randomised"))
    return totals.select(
        "screened",
        "randomised",
        F.round(F.lit(100.0) * (F.lit(1.0) - kept), 1).alias("screen_failure_rate"),
        F.round(finished, 1).alias("completed_pct"),
        "open_queries",
    )


def completion_by_arm(outcomes: DataFrame) -> DataFrame:
    status = F.when(F.col("disposition") == COMPLETED, COMPLETED).otherwise("DISCONTINUED")
    return (
        outcomes.filter(F.col("arm").isNotNull())
        .groupBy("arm", status.alias("status"))
        .agg(F.sum("subjects").alias("subjects"))
        .orderBy("arm", "status")
    )


def site_view(sites: DataFrame, windows: DataFrame) -> DataFrame:
    """Enrolment with visit compliance; sites without week visits stay."""
    return sites.join(
        windows.select("site", "scheduled_visits", "out_of_window_pct"), "site", "left"
    )


def discontinuation_reasons(outcomes: DataFrame) -> DataFrame:
    """Everything but completion; a missing reason counts as a reason."""
    return outcomes.filter(~F.col("disposition").eqNullSafe(COMPLETED))


def top_body_systems(by_system: DataFrame, n: int = 8, width: int = 40) -> DataFrame:
    """The view by body system, cut to the ``n`` systems with most subjects."""
    top = (
        by_system.filter(F.col("body_system").isNotNull())
        .groupBy("body_system")
        .agg(F.sum("subjects_with_ae").alias("total"))
        .orderBy(F.desc("total"), "body_system")
        .limit(n)
    )
    return by_system.join(top, "body_system", "left_semi").select(
        "arm",
        F.substring(title_case(F.col("body_system")), 1, width).alias("body_system"),
        "subjects_with_ae",
    )


def landmark_kpis(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("subjects"),
        F.round(F.avg("discontinued"), 6).alias("share_discontinued"),
    )


def odds_ratio_direction(ratios: DataFrame) -> DataFrame:
    raises = F.col("odds_ratio") > 1
    return ratios.withColumn(
        "direction", F.when(raises, "Raises risk").otherwise("Lowers risk")
    )
