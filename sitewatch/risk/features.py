"""What is known of a subject at the landmark day, and the leak guard."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewatch.functions.dates import study_day
from sitewatch.risk.lineage import sources

LANDMARK_DAY = 14
LABEL = "discontinued"

# Model inputs, and columns known only after the outcome.
NUMERIC = (
    "AGE",
    "BMIBL",
    "EDUCLVL",
    "DURDIS",
    "MMSETOT",
    "early_ae_count",
    "early_ae_mod_sev",
)
CATEGORICAL = ("SEX", "TRT01P")
LEAKY = ("TRTDUR", "CUMDOSE", "AVGDD", "DISCONFL", "COMP24FL", "DCREASCD", "RFENDTC")


def check_no_leaks(features: Iterable[str]) -> None:
    leaks = sorted(set(features) & {*LEAKY, LABEL})
    if leaks:
        raise ValueError(f"known only after the outcome: {', '.join(leaks)}")


def check_sources(features: DataFrame) -> DataFrame:
    """``features``, unless an input is computed from a column known only after the outcome.

    Names do not hide it: the plan is followed back from each input to the scans.
    """
    found = sources(features)
    for name in (*NUMERIC, *CATEGORICAL):
        leaks = sorted(found.get(name, set()) & {*LEAKY, LABEL})
        if leaks:
            raise ValueError(f"{name} comes from what is known only after the outcome: {', '.join(leaks)}")
    return features


def known_at_landmark(start_day: Column) -> Column:
    """Events that began while the subject was watched, up to the landmark."""
    return start_day.between(1, LANDMARK_DAY)


def early_counts(events: DataFrame) -> DataFrame:
    """Events per subject, of events that must all be known at the landmark.

    The job fails on any other, or on one without a day, instead of counting it.
    """
    early = F.coalesce(known_at_landmark(F.col("AESTDY")), F.lit(False))
    late = F.concat(F.lit("event after the landmark, or of no known day: "), F.coalesce("USUBJID", F.lit("")))
    worse = F.col("AESEV").isin("MODERATE", "SEVERE")
    checked = events.withColumn("_early", F.when(early, True).otherwise(F.raise_error(late).cast("boolean")))
    return checked.groupBy("USUBJID").agg(
        F.count_if("_early").alias("early_ae_count"),
        F.count_if(F.col("_early") & worse).alias("early_ae_mod_sev"),
    )


def landmark_features(adsl: DataFrame, ae: DataFrame) -> DataFrame:
    """One row per subject still on study after the landmark day."""
    early = early_counts(ae.filter(known_at_landmark(F.col("AESTDY"))))
    on_study = study_day(F.col("RFENDTC"), F.col("RFSTDTC")) > LANDMARK_DAY
    return check_sources(
        adsl.filter(on_study)
        .join(early, "USUBJID", "left")
        .select(
            "USUBJID",
            "SITEID",
            "AGE",
            "SEX",
            "BMIBL",
            "EDUCLVL",
            "DURDIS",
            "MMSETOT",
            "TRT01P",
            F.coalesce("early_ae_count", F.lit(0)).alias("early_ae_count"),
            F.coalesce("early_ae_mod_sev", F.lit(0)).alias("early_ae_mod_sev"),
            F.when(F.col("DISCONFL") == "Y", 1).otherwise(0).cast("bigint").alias(LABEL),
        )
    )
