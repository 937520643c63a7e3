"""The six domains derived from the driver's order, event and line tables."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.sources.schema import DOMAIN_NAMES

# Orders are numbered in pieces this wide in order keys.
PIECE_KEYS = 1_000_000


class BoundDomains(Mapping):
    """The domains of one data folder; each is planned when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str, piece_keys: int = PIECE_KEYS):
        self._spark = spark
        self._sf_dir = sf_dir
        self._piece_keys = piece_keys
        self._planned: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._sf_dir}/{name}.parquet")

    @cached_property
    def _orders(self) -> DataFrame:
        return self._table("orders")

    @cached_property
    def _subjects(self) -> DataFrame:
        return _subjects(self._table("customer"), self._orders)

    def _plan(self, name: str) -> DataFrame:
        if name == "sv":
            return _sv(self._orders, self._subjects, self._piece_keys)
        if name == "ae":
            return _ae(self._table("events"), self._subjects)
        if name == "ex":
            return _ex(self._table("lineitem"), self._orders, self._subjects)
        return {"dm": _dm, "ds": _ds, "adsl": _adsl}[name](self._subjects)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._planned:
            self._planned[name] = self._plan(name)
        return self._planned[name]

    def __iter__(self) -> Iterator[str]:
        return iter(DOMAIN_NAMES)

    def __len__(self) -> int:
        return len(DOMAIN_NAMES)


def bind(spark: SparkSession, sf_dir: str, piece_keys: int = PIECE_KEYS) -> BoundDomains:
    return BoundDomains(spark, sf_dir, piece_keys)


def _subjects(customer: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per customer with orders; the order history is folded first."""
    history = orders.groupBy(F.col("o_custkey").alias("k")).agg(
        F.min(F.col("o_orderdate").cast("date")).alias("d0"),
        F.max_by("o_orderstatus", "o_orderkey").alias("last_status"),
        F.count("*").alias("n_orders"),
    )
    people = customer.selectExpr(
        "c_custkey AS k",
        "c_name AS USUBJID",
        "concat('S', lpad(cast(c_nationkey AS string), 2, '0')) AS SITEID",
        "c_mktsegment AS seg",
    )
    return people.join(history, "k")


def _dm(subjects: DataFrame) -> DataFrame:
    return subjects.selectExpr(
        "USUBJID",
        "SITEID",
        """CASE seg WHEN 'HOUSEHOLD' THEN 'Scrnfail' WHEN 'BUILDING' THEN 'Pbo'
                    WHEN 'MACHINERY' THEN 'Xan_Hi' ELSE 'Xan_Lo' END AS ARMCD""",
        "if(seg <> 'HOUSEHOLD', cast(d0 AS string), NULL) AS RFSTDTC",
        "if(k % 10 <> 0, cast(date_add(d0, -14) AS string), NULL) AS RFICDTC",
        "cast(date_add(d0, int(60 + k % 90)) AS string) AS RFPENDTC",
    )


def _ds(subjects: DataFrame) -> DataFrame:
    ended = """if(k % 29 <> 0, named_struct('DSCAT', 'DISPOSITION EVENT', 'DSDECOD',
                  CASE last_status WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ADVERSE EVENT'
                                   ELSE 'WITHDRAWAL BY SUBJECT' END), NULL)"""
    entered = "named_struct('DSCAT', 'PROTOCOL MILESTONE', 'DSDECOD', 'RANDOMIZED')"
    return subjects.selectExpr("USUBJID", f"inline(array_compact(array({ended}, {entered})))")


def _adsl(subjects: DataFrame) -> DataFrame:
    return subjects.filter("seg <> 'HOUSEHOLD'").selectExpr(
        "USUBJID",
        "SITEID",
        """CASE seg WHEN 'BUILDING' THEN 'Placebo' WHEN 'MACHINERY' THEN 'Xanomeline High Dose'
                    ELSE 'Xanomeline Low Dose' END AS TRT01P""",
        "double(50 + k % 46) AS AGE",
        "if(k % 2 = 0, 'F', 'M') AS SEX",
        "if(k % 37 <> 0, double(18 + k % 19), NULL) AS BMIBL",
        "double(6 + k % 15) AS EDUCLVL",
        "double(k % 120) AS DURDIS",
        "double(10 + k % 14) AS MMSETOT",
        "cast(d0 AS string) AS RFSTDTC",
        "cast(date_add(d0, int((k * 5) % 190)) AS string) AS RFENDTC",
        "if(last_status <> 'F', 'Y', NULL) AS DISCONFL",
    )


def _numbered_orders(orders: DataFrame, subjects: DataFrame, piece_keys: int) -> DataFrame:
    """Orders with ``n``, their place in the customer's history by order key.

    Order keys are unique, so a piece holds ``piece_keys`` orders at most.
    """
    rows = orders.selectExpr("o_custkey AS k", "o_orderkey AS ok").join(
        subjects.select("k", "USUBJID", "d0"), "k"
    )
    rows = rows.withColumn("piece", F.floor(F.col("ok") / piece_keys))
    before = Window.partitionBy("k").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy("k", "piece")
        .agg(F.count("*").alias("size"))
        .select("k", "piece", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("carried"))
    )
    inside = Window.partitionBy("k", "piece").orderBy("ok")
    return (
        # Without this exchange the window would keep the join's distribution
        # by customer, and with it a long history in one task.
        rows.repartition("k", "piece")
        .withColumn("inside", F.row_number().over(inside))
        .join(carried, ["k", "piece"])
        .withColumn("n", F.col("inside") + F.col("carried"))
    )


def _sv(orders: DataFrame, subjects: DataFrame, piece_keys: int) -> DataFrame:
    return _numbered_orders(orders, subjects, piece_keys).selectExpr(
        "USUBJID",
        "double(n + 2) AS VISITNUM",
        "double(14 * (n - 1) + 1) AS VISITDY",
        """CASE WHEN n = 1 THEN 'BASELINE' WHEN ok % 11 = 0 THEN concat('UNSCHEDULED ', string(n))
                WHEN ok % 13 = 0 THEN concat('Week ', string(2 * (n - 1)))
                ELSE concat('WEEK ', string(2 * (n - 1))) END AS VISIT""",
        """CASE WHEN ok % 97 = 0 THEN NULL
                WHEN ok % 89 = 0 THEN left(string(date_add(d0, int(14 * (n - 1)))), 7)
                ELSE string(date_add(d0, int(14 * (n - 1) + (ok * 7) % 31 - 15))) END AS SVSTDTC""",
    )


def _ae(events: DataFrame, subjects: DataFrame) -> DataFrame:
    happened = events.selectExpr(
        "user_id AS k",
        "event_id AS id",
        "upper(event_type) AS term",
        "value AS v",
        "int((event_id * 13) % 200 - 6) AS off",
    )
    return happened.join(subjects, "k").selectExpr(
        "USUBJID",
        "term AS AETERM",
        "concat(term, '-TYPE DISORDERS ', string(id % 3)) AS AEBODSYS",
        "CASE WHEN v < 20 THEN 'MILD' WHEN v < 80 THEN 'MODERATE' ELSE 'SEVERE' END AS AESEV",
        "CASE WHEN v > 150 THEN 'Y' ELSE 'N' END AS AESER",
        # The standard has no day 0.
        "double(if(off >= 0, off + 1, off)) AS AESTDY",
        """if(id % 43 = 0, left(string(date_add(d0, off)), 7), string(date_add(d0, off)))
             AS AESTDTC""",
        "if(id % 5 <> 0, string(date_add(d0, off + int(id % 23 - 1))), NULL) AS AEENDTC",
        """CASE WHEN id % 7 = 0 THEN 'NOT RECOVERED/NOT RESOLVED'
                WHEN id % 7 < 5 THEN 'RECOVERED/RESOLVED'
                WHEN id % 7 = 5 THEN 'Recovered' ELSE 'FATAL' END AS AEOUT""",
    )


def _ex(lineitem: DataFrame, orders: DataFrame, subjects: DataFrame) -> DataFrame:
    doses = lineitem.selectExpr(
        "l_orderkey AS ok", "l_quantity AS EXDOSE", "string(date(l_shipdate)) AS EXSTDTC"
    )
    return (
        doses.join(orders.selectExpr("o_orderkey AS ok", "o_custkey AS k"), "ok")
        .join(subjects.filter("k % 41 <> 0"), "k")
        .select("USUBJID", "EXDOSE", "EXSTDTC")
    )
