"""Running totals over a long order that no single task has to hold."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    bucket: str,
    order: Sequence[str],
    amount: Column,
    name: str,
) -> DataFrame:
    """Add ``name``: the sum of ``amount`` up to and including each row.

    ``bucket`` cuts the order of every key group into consecutive pieces. The
    pieces are totalled first, which leaves one row each, and those totals
    carry the sum from piece to piece; rows are only ever sorted inside their
    own piece. ``bucket`` must not be NULL and must rise with ``order``.
    """
    pieces = [*keys, bucket]
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(
        Window.unboundedPreceding, -1
    )
    carried = (
        df.groupBy(*pieces)
        .agg(F.sum(amount).alias("_in_piece"))
        .select(*pieces, F.coalesce(F.sum("_in_piece").over(earlier), F.lit(0)).alias("_carried"))
    )
    inside = Window.partitionBy(*pieces).orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        df.withColumn("_inside", F.sum(amount).over(inside))
        .join(carried, pieces)
        .withColumn(name, F.col("_carried") + F.col("_inside"))
        .drop("_carried", "_inside")
    )
