"""Domains stored as Parquet folders or catalog tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from sitewatch.sources.schema import DOMAIN_NAMES, domain_schema

Domains = Mapping[str, DataFrame]


def check_columns(name: str, df: DataFrame) -> DataFrame:
    """Fail early where a declared column is absent or has another type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name} {f.dataType.simpleString()}"
        for f in domain_schema(name).fields
        if found.get(f.name) != f.dataType
    ]
    if wrong:
        raise ValueError(f"{name}: missing or of another type: {', '.join(wrong)}")
    return df


def read_domains(spark: SparkSession, folder: str) -> Domains:
    return {
        name: check_columns(name, spark.read.parquet(f"{folder}/{name}"))
        for name in DOMAIN_NAMES
    }


def read_domain_tables(spark: SparkSession, database: str) -> Domains:
    return {
        name: check_columns(name, spark.table(f"{database}.{name}")) for name in DOMAIN_NAMES
    }
