"""Connected components by alternating large and small stars.

Each round hangs every node's larger neighbours, then its smaller ones, on the
smallest node it knows; the edges end up as one star per component after a
number of rounds that grows with the logarithm of the nodes. Minima are
aggregated before they are shuffled, and written tables cut the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewatch.session import result_only, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = saved(edges.union(edges.select("v", "u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return both.filter(F.col("v") > F.col("u")).join(saved(least), "u").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") > F.col("v"))
        .distinct()
    )
    least = saved(down.groupBy("u").agg(F.min("v").alias("m")))
    hung = down.join(least, "u").filter(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], row["h"]


@result_only
def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Rows (u, v): v the smallest node of u's component, for all u other than v.

    ``edges`` has long columns u and v; loops and repeated edges do no harm. No
    edges give no rows.
    """
    now = saved(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _print_of(now)
    if not before[0]:
        return now
    for _ in range(most_rounds):
        now = saved(_small_star(_large_star(now)))
        after = _print_of(now)
        if after == before:
            return now
        before = after
    raise RuntimeError("components did not settle")
