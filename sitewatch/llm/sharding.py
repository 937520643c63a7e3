"""Sharding by jump consistent hashing, with gapless slots.

A key's shard depends on the key and the number of shards alone; one more shard
takes about 1/(n+1) of the keys, all of them into itself. No ring is stored.

Defined cases: a NULL key hashes as the empty text; equal keys share a shard;
repeated rows get slots of their own; an empty table gives an empty table;
other columns pass through, those named like the added ones are replaced (names
starting with ``_`` are reserved).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.functions.ordered import running_total
from sitewatch.llm.common import salted_left_join, table, text_or_empty
from sitewatch.session import result_only, saved

SHARDS = 8
#: Leading hex digits of the key's hash that cut a shard's order into pieces.
PIECE_DIGITS = 3
#: A key with more rows than this is cut by more than its hash.
HOT_ROWS = 50_000
#: Fixed value: the generator's multiplier, as published with the method.
MULTIPLIER = np.uint64(2862933555777941757)


def key_hash(key: Column) -> Column:
    """32 hex digits that depend on the key's text only."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of unsigned 64-bit keys into ``shards`` shards."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    active = np.arange(len(state))
    target = np.zeros(len(state), dtype=np.int64)
    while len(active):
        shard[active] = target[active]
        with np.errstate(over="ignore"):
            state[active] = state[active] * MULTIPLIER + np.uint64(1)
        draw = (state[active] >> np.uint64(33)).astype(np.float64) + 1.0
        target[active] = ((shard[active] + 1) * (2147483648.0 / draw)).astype(np.int64)
        active = active[target[active] < shards]
    return shard


def jump_column(hashed: Column, shards: int) -> Column:
    """The shard of each hash made by ``key_hash``."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    @F.pandas_udf("int")
    def shard_of(digits: pd.Series) -> pd.Series:
        keys = np.array([int(d[:16], 16) for d in digits], dtype=np.uint64)
        return pd.Series(jump(keys, shards).astype(np.int32))

    return shard_of(hashed)


def in_pieces(rows: DataFrame, digits: int, tie: Column) -> DataFrame:
    """Add ``_tie``, from 0 to 99, and ``_piece``, which rises with (``_hash``, ``_tie``).

    A piece is all rows whose hashes begin alike. Where a key owns more than
    ``HOT_ROWS`` rows, its rows are cut by the tie, and its neighbours by their hash.
    """
    rows = rows.withColumn("_tie", F.pmod(tie, F.lit(100)))
    head = F.substring("_hash", 1, digits)
    hot = saved(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS).drop("_n"))
    if hot.isEmpty():
        return rows.withColumn("_piece", head)
    # As many rows as there are heads: 16 ** digits at most.
    heads = F.broadcast(hot.select(head.alias("_head"), F.lit(True).alias("_near")).distinct())
    met = salted_left_join(rows, hot.withColumn("_hot", F.lit(True)), ["_hash"], F.col("_tie"))
    met = met.withColumn("_head", head).join(heads, "_head", "left")
    cut = F.concat("_hash", F.lpad(F.col("_tie").cast("string"), 2, "0"))
    piece = F.when(F.col("_hot"), cut).when(F.col("_near"), F.col("_hash")).otherwise(F.col("_head"))
    return met.withColumn("_piece", piece).drop("_head", "_hot", "_near")


def add_shards(df: DataFrame, key: str, shards: int = SHARDS, row: str | None = None) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one more shard) and ``slot``.

    Slots count from 0 within a shard by (hash, key); pieces of that order are
    totalled first, so no task holds a shard. Rows with equal keys are ordered by
    ``row``, a column that differs in every row; without one, by a hash of all their
    columns, so that reruns agree. Columns that ``df`` has under the added names
    are replaced.
    """
    df = df.drop("shard", "grown_shard", "slot")
    settled = F.col(row) if row else F.xxhash64(*(F.col(f"`{c}`") for c in df.columns))
    hashed = df.withColumns({"_hash": key_hash(F.col(key)), "_row": settled})
    placed = in_pieces(hashed, PIECE_DIGITS, F.xxhash64("_row")).withColumns(
        {"shard": jump_column(F.col("_hash"), shards), "grown_shard": jump_column(F.col("_hash"), shards + 1)}
    )
    numbered = running_total(
        placed, ["shard"], "_piece", ["_hash", "_tie", key, "_row"], F.lit(1).cast("long"), "_place"
    )
    added = {"slot": F.col("_place") - 1}
    return numbered.withColumns(added).select(*(F.col(f"`{c}`") for c in df.columns), "shard", "grown_shard", "slot")


@result_only
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text_or_empty()) + 1).cast("long").alias("size"),
        F.crc32(text_or_empty().cast("binary")).alias("text_crc32"),
    )
    return add_shards(docs, "doc_id").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
