"""Odds ratios of the fitted logistic model, with readable names."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.risk.train import RiskModel

# Names shown to readers.
LABELS = {
    "AGE": "Age (years)",
    "BMIBL": "Baseline BMI",
    "EDUCLVL": "Years of education",
    "DURDIS": "Disease duration (months)",
    "MMSETOT": "Baseline MMSE score",
    "early_ae_count": "AEs in first 14 days",
    "early_ae_mod_sev": "Moderate/severe AEs in first 14 days",
}
# Words shown before a level.
PREFIXES = {"TRT01P_": "Arm: ", "SEX_": "Sex: "}


def label(name: str) -> str:
    for prefix, shown in PREFIXES.items():
        if name.startswith(prefix):
            return shown + name.removeprefix(prefix)
    return LABELS.get(name, name)


def odds_ratios(model: RiskModel) -> DataFrame:
    """Per SD of a number, or against the first level of a category."""
    table = pa.table({"feature": [label(n) for n in model.names], "coef": model.coefficients})
    return (
        SparkSession.active()
        .createDataFrame(table)
        .withColumn("odds_ratio", F.exp("coef"))
        .orderBy(F.desc("odds_ratio"))
    )
