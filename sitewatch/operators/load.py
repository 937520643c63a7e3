"""Loading steps: tidy text, convert SAS dates, report on what was loaded."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewatch.functions.dates import sas_day_to_iso
from sitewatch.functions.text import blank_to_null
from sitewatch.sources.tables import Domains


def tidy_blanks(df: DataFrame) -> DataFrame:
    """Strip every text column and turn blanks into NULL."""
    return df.select(
        *(
            blank_to_null(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        )
    )


def convert_sas_dates(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Turn SAS day counts into ISO text; columns the table lacks are skipped."""
    present = {c: sas_day_to_iso(F.col(c)) for c in columns if c in df.columns}
    return df.withColumns(present) if present else df


def load_report(domains: Domains) -> DataFrame:
    """Rows and columns per domain, with distinct and missing subject ids."""
    parts = [
        df.agg(
            F.lit(name).alias("domain"),
            F.count("*").alias("n_rows"),
            F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
            F.count_distinct("USUBJID").alias("n_subjects"),
            F.count_if(F.col("USUBJID").isNull()).alias("n_without_subject"),
        )
        for name, df in domains.items()
    ]
    return reduce(DataFrame.unionByName, parts)
