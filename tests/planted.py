"""Tiny domains: one clean subject, to which the tests add trouble."""

from sitewatch.sources.schema import DOMAIN_NAMES, domain_schema

CLEAN = {
    "dm": dict(USUBJID="S0", SITEID="701", ARMCD="Pbo", RFSTDTC="2014-01-01",
               RFICDTC="2013-12-20", RFPENDTC="2014-06-30"),
    "ds": dict(USUBJID="S0", DSCAT="DISPOSITION EVENT", DSDECOD="COMPLETED"),
    "sv": dict(USUBJID="S0", VISIT="WEEK 2", SVSTDTC="2014-01-15", VISITNUM=4.0, VISITDY=15.0),
    "ae": dict(USUBJID="S0", AETERM="RASH", AEBODSYS="SKIN", AESEV="MILD", AESER="N",
               AEOUT="RECOVERED/RESOLVED", AESTDTC="2014-01-05", AEENDTC="2014-01-09", AESTDY=5.0),
    "ex": dict(USUBJID="S0"),
    "adsl": dict(USUBJID="S0", SITEID="701", TRT01P="Placebo", SEX="F", DISCONFL=None,
                 RFSTDTC="2014-01-01", RFENDTC="2014-06-30", AGE=70.0, BMIBL=24.0, EDUCLVL=12.0,
                 DURDIS=30.0, MMSETOT=20.0),
}


def domains(spark, clean=True, **extra):
    """Domains holding the clean rows and, per table, rows that differ from them."""
    out = {}
    for name in DOMAIN_NAMES:
        rows = [CLEAN[name]] if clean else []
        rows += [{**CLEAN[name], **changes} for changes in extra.get(name, ())]
        schema = domain_schema(name)
        out[name] = spark.createDataFrame([[r[f] for f in schema.names] for r in rows], schema)
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]
