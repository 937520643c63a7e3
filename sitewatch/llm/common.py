"""Small helpers that several operators share."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.session import saved, set_for_scope

#: A word: a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def rows_to_batches(
    rows: Iterator[tuple], schema: pa.Schema, rows_per_batch: int = 2_000
) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded length from plain tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= rows_per_batch:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in shorter batches, so that few texts are Python objects at a time."""
    for batch in batches:
        for begin in range(0, batch.num_rows, rows):
            yield batch.slice(begin, rows)


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; its session hands Python at most 1,000 rows or 8 MB at a time, until the scope ends.

    Spark's own bounds are 10,000 rows and 64 MB, held in the JVM and in Python at
    once by every running task, which texts of many pages fill.
    """
    set_for_scope(
        df.sparkSession,
        {
            "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
            "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
        },
    )
    return df


def give_back() -> None:
    """Return what this Python process holds unused to the machine.

    Spark keeps Python workers for later stages; without this, each keeps the memory
    of the largest task it ever ran.
    """
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass  # not every C library has it


def lean(run: Callable) -> Callable:
    """``run``, of a task's batches, of a group or of two, that gives back memory at its end."""

    @functools.wraps(run)
    def over_batches(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    @functools.wraps(run)
    def over_group(group):
        try:
            return run(group)
        finally:
            give_back()

    @functools.wraps(run)
    def over_two(left, right):
        try:
            return run(left, right)
        finally:
            give_back()

    if "Iterator" in str(run.__annotations__.get("return", "")):
        return over_batches
    return over_group if run.__code__.co_argcount == 1 else over_two


def told_apart(docs: DataFrame, key: str, text: str) -> tuple[DataFrame | None, DataFrame]:
    """Rows (key, row) that their key does not name, None if there are none; each document once.

    ``docs`` is (key, text). The documents get a column ``row``: 0 where the key names
    one row only; where several have it, or it is NULL, a hash of the text. Rows that
    agree in key and text are one document.
    """
    unnamed = F.col(key).isNull()
    several = saved(docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(unnamed | (F.col("_n") > 1)))
    plain = F.lit(0).cast("long")
    if several.isEmpty():
        return None, docs.withColumn("row", plain)
    # A key may own a large share of the rows; NULL joins nothing.
    joined = salted_left_join(docs, several, [key], F.coalesce(text, F.lit("")))
    shown = F.when(F.xxhash64(text) == 0, F.lit(1).cast("long")).otherwise(F.xxhash64(text))
    rows = joined.withColumn("row", F.when(unnamed | F.col("_n").isNotNull(), shown).otherwise(plain))
    rows = rows.select(key, text, "row")
    alike = rows.filter(F.col("row") != 0)
    once = rows.filter(F.col("row") == 0).unionByName(alike.dropDuplicates([key, "row"]))
    return saved(alike.select(key, "row")), saved(once)


def for_every_row(alike: DataFrame | None, done: DataFrame, key: str) -> DataFrame:
    """Results (key, row, ...) of documents once, as one for each row; without ``row``."""
    if alike is None:
        return done.drop("row")
    done = saved(done)
    # NULL keys meet as such.
    names = {"_key": F.coalesce(F.col(key).cast("long"), F.lit(0)), "_named": F.col(key).isNotNull()}
    results = done.filter(F.col("row") != 0).withColumns(names).drop(key)
    rows = alike.withColumns({**names, "_spread": F.monotonically_increasing_id()})
    copies = salted_left_join(rows, results, ["_key", "_named", "row"], F.col("_spread"))
    return done.filter(F.col("row") == 0).unionByName(copies.select(*done.columns)).drop("row")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays(
        [pa.array(values, type=field.type) for values, field in zip(columns, schema)],
        schema=schema,
    )


def add_columns(
    df: DataFrame,
    added: dict[str, tuple[str, pa.DataType]],
    values: Callable[[pa.RecordBatch], list[pa.Array]],
) -> DataFrame:
    """``df`` with columns that ``values`` computes from each Arrow batch.

    ``added`` names their Spark and Arrow types. Columns of these names that
    ``df`` already has are replaced. Nothing is shuffled.
    """
    kept = [name for name in df.columns if name not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *values(batch)], names=[*kept, *added]
            )

    ddl = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
        + [f"`{name}` {kind}" for name, (kind, _) in added.items()]
    )
    return bounded_batches(df).select(*[F.col(f"`{name}`") for name in kept]).mapInArrow(lean(run), ddl)


def salted_left_join(
    rows: DataFrame, groups: DataFrame, keys: list[str], spread: Column, salts: int = 16
) -> DataFrame:
    """``rows`` left join ``groups`` on ``keys``, each group under ``salts`` keys.

    For groups of which one may own a large share of the rows. ``spread`` picks
    a row's salt and must not be NULL; ``groups`` has one row per key and should
    hold only keys that several rows have.
    """
    many = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    return salted.join(many, [*keys, "_salt"], "left").drop("_salt")
