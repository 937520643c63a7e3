"""The six domains and the columns the operators read."""

from __future__ import annotations

from pyspark.sql import types as T

# Domain names.
DOMAIN_NAMES = ("dm", "ds", "sv", "ae", "ex", "adsl")

# Date columns of the analysis dataset that arrive as SAS day counts.
# Columns that hold SAS dates.
SAS_DATE_COLUMNS = {"adsl": ("TRTSDT", "TRTEDT", "VISIT1DT", "DISONSDT", "RFENDT")}

TEXT_COLUMNS = {
    "dm": ("USUBJID", "SITEID", "ARMCD", "RFSTDTC", "RFICDTC", "RFPENDTC"),
    "ds": ("USUBJID", "DSCAT", "DSDECOD"),
    "sv": ("USUBJID", "VISIT", "SVSTDTC"),
    "ae": ("USUBJID", "AETERM", "AEBODSYS", "AESEV", "AESER", "AEOUT", "AESTDTC", "AEENDTC"),
    "ex": ("USUBJID",),
    "adsl": ("USUBJID", "SITEID", "TRT01P", "SEX", "DISCONFL", "RFSTDTC", "RFENDTC"),
}
NUMBER_COLUMNS = {
    "dm": (),
    "ds": (),
    "sv": ("VISITNUM", "VISITDY"),
    "ae": ("AESTDY",),
    "ex": (),
    "adsl": ("AGE", "BMIBL", "EDUCLVL", "DURDIS", "MMSETOT"),
}


def domain_schema(name: str) -> T.StructType:
    """Declared columns of a domain; a table may hold more."""
    fields = [T.StructField(c, T.StringType()) for c in TEXT_COLUMNS[name]]
    fields += [T.StructField(c, T.DoubleType()) for c in NUMBER_COLUMNS[name]]
    return T.StructType(fields)
