"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, its expected number of copies. Among all rates that
bring each source's words to its target, entropy balancing takes those nearest
to one in relative entropy, each at most ``MOST``: the minimum is an
exponential tilt ``min(MOST, exp(a * size))`` with one multiplier per source,
found by Newton iterations on the convex dual. The sums of an iteration run
over (source, size) cells, which are counted once. Rates are then rounded into
whole copies so that a source's total stays near its target.

Defined cases: a NULL source is a source of its own, last in order; a NULL or
empty text has size 0, rate 1 and takes no words; a source without words has
target 0; repeated rows count as rows; an empty table gives an empty table.
Columns other than those named, and the one given as ``row``, are not read and do
not come back. A source whose target cannot be met raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.functions.ordered import running_total
from sitewatch.llm.common import WORD, table, text_or_empty
from sitewatch.llm.sharding import in_pieces
from sitewatch.session import result_only, saved

WEIGHTS = (5, 2, 1)
MOST = 3
#: Newton stops when every source is within this share of its target.
CLOSE = 1e-7
#: Steps, of which all but a few halve a bracket, after which a search has failed.
MOST_STEPS = 200
#: Rounds that mend the rest left by rounding, the largest fitting size first.
MENDING_ROUNDS = 4


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORD)).cast("long")


def source_key(column: str = "source") -> Column:
    """A source as text that is never NULL."""
    return F.when(F.col(column).isNull(), "n").otherwise(
        F.concat(F.lit("s"), F.col(column).cast("string"))
    )


def source_targets(sources: DataFrame) -> DataFrame:
    """Add ``target`` to rows (_key, source, source_size), one per source.

    Sources above ``MOST`` times their size are capped and the excess is shared
    by weight among the rest. Sorted by cap per weight, the capped ones come
    first, so the level is the first one that the source it is computed at can
    meet. The windows run over one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.lit(0)
    for k, w in enumerate(WEIGHTS):
        weight = F.when(place % len(WEIGHTS) == k, w).otherwise(weight)
    weighted = sources.select("*", weight.cast("double").alias("_w")).withColumn(
        "_cap", F.lit(float(MOST)) * F.col("source_size")
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    levelled = weighted.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        / F.sum("_w").over(after),
    )
    found = F.first(
        F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level")), ignorenulls=True
    ).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        levelled.withColumn("_found", found)
        .withColumn("target", F.least("_cap", F.col("_w") * F.col("_found")))
        .drop("_w", "_cap", "_level", "_found")
    )


def _rate() -> Column:
    """min(MOST, exp(tilt * x)); the exponent is bounded before exp."""
    exponent = F.least(F.col("_tilt") * F.col("size") / F.col("_scale"), F.lit(50.0))
    return F.when(F.col("_full"), float(MOST)).otherwise(
        F.least(F.lit(float(MOST)), F.exp(exponent))
    )


def balance(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source with ``_tilt``, ``_scale`` and ``_full``.

    ``_full``: the target is all that the cap allows. A Newton step that leaves
    the bracket known so far is replaced by a bisection or by a doubling.
    """
    spread = cells.groupBy("_key").agg(
        (F.sum(F.col("size") * F.col("_n")) / F.greatest(F.sum("_n"), F.lit(1)))
        .alias("_scale")
    )
    state = saved(
        targets.join(spread, "_key").select(
            "_key",
            "target",
            F.greatest(F.col("_scale"), F.lit(1.0)).alias("_scale"),
            (F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)).alias("_full"),
            F.lit(0.0).alias("_tilt"),
            F.lit(None).cast("double").alias("_low"),
            F.lit(None).cast("double").alias("_high"),
        ).withColumn("_done", F.col("_full") | (F.col("target") <= 0))
    )
    x = F.col("size") / F.col("_scale")
    for _ in range(MOST_STEPS):
        open_ = state.filter(~F.col("_done"))
        if open_.isEmpty():
            break
        words = F.col("_n") * F.col("size") * _rate()
        sums = (
            cells.join(open_, "_key")
            .groupBy("_key")
            .agg(
                F.sum(words).alias("_sum"),
                F.sum(F.when(_rate() < MOST, words * x).otherwise(0.0)).alias("_slope"),
            )
        )
        gap = F.col("_sum") - F.col("target")
        low = F.when(gap < 0, F.col("_tilt")).otherwise(F.col("_low"))
        high = F.when(gap >= 0, F.col("_tilt")).otherwise(F.col("_high"))
        newton = F.when(F.col("_slope") > 0, F.col("_tilt") - gap / F.col("_slope"))
        far = F.greatest(F.abs(F.col("_tilt")) * 2, F.lit(1.0))
        beyond = (
            F.when(F.col("_l").isNotNull() & F.col("_h").isNotNull(), (F.col("_l") + F.col("_h")) / 2)
            .when(F.col("_l").isNotNull(), F.col("_tilt") + far)
            .otherwise(F.col("_tilt") - far)
        )
        fits = (
            F.col("_newton").isNotNull()
            & (F.col("_l").isNull() | (F.col("_newton") > F.col("_l")))
            & (F.col("_h").isNull() | (F.col("_newton") < F.col("_h")))
            & (F.abs(F.col("_newton") - F.col("_tilt")) <= far * 2)
        )
        state = saved(
            state.join(sums, "_key", "left")
            .withColumns({"_l": low, "_h": high, "_newton": newton})
            .withColumn("_near", F.col("_done") | (F.abs(gap) <= CLOSE * F.col("target")))
            .select(
                "_key",
                "target",
                "_scale",
                "_full",
                F.when(F.col("_near"), F.col("_tilt"))
                .when(fits, F.col("_newton"))
                .otherwise(beyond)
                .alias("_tilt"),
                F.when(F.col("_done"), F.col("_low")).otherwise(F.col("_l")).alias("_low"),
                F.when(F.col("_done"), F.col("_high")).otherwise(F.col("_h")).alias("_high"),
                F.col("_near").alias("_done"),
            )
        )
    else:
        if not state.filter(~F.col("_done")).isEmpty():
            raise RuntimeError(f"a source's rate did not settle in {MOST_STEPS} steps")
    return state


def rounded_cells(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Add ``_m``, the copies that a (source, size) cell gets in all.

    Expected copies are added up from the largest size down and each cell takes
    what the rounded total rises by; so a source is off by less than its largest
    document. Mending rounds then add or drop copies of the largest size that
    fits into what is left.
    """
    expected = F.col("_n") * _rate()
    down = Window.partitionBy("_key").orderBy(F.col("size").desc())
    total = F.sum("_e").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rounded = (
        cells.join(state, "_key")
        .withColumn("_e", expected)
        .withColumn("_t", F.floor(total + F.lit(0.5)))
        .withColumn("_m", F.col("_t") - F.coalesce(F.lag("_t").over(down), F.lit(0)))
        .withColumn("_m", F.least(F.greatest(F.col("_m"), F.lit(0)), MOST * F.col("_n")))
        .select("_key", "size", "_n", "target", "_m")
    )
    now = saved(rounded)
    for _ in range(MENDING_ROUNDS):
        rest = now.groupBy("_key").agg(
            (F.first("target") - F.sum(F.col("_m") * F.col("size"))).alias("_rest")
        )
        room = F.when(F.col("_rest") > 0, MOST * F.col("_n") - F.col("_m")).otherwise(F.col("_m"))
        change = (
            now.join(rest, "_key")
            .withColumn("_room", room)
            .filter((F.col("size") > 0) & (F.col("size") <= F.abs("_rest")) & (F.col("_room") > 0))
            .groupBy("_key")
            .agg(F.max_by(F.struct("size", "_room", "_rest"), "size").alias("_c"))
            .select(
                "_key",
                F.col("_c.size").alias("size"),
                (
                    F.least(F.col("_c._room"), F.floor(F.abs(F.col("_c._rest")) / F.col("_c.size")))
                    * F.signum(F.col("_c._rest")).cast("long")
                ).alias("_change"),
            )
        )
        now = saved(
            now.join(change, ["_key", "size"], "left")
            .withColumn("_m", F.col("_m") + F.coalesce("_change", F.lit(0)))
            .drop("_change")
        )
    return now


def mix(
    docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", row: str | None = None
) -> DataFrame:
    """Rows (key, size, source_size, target, rate, copies, taken) of every row.

    ``row``, a column that differs in every row, goes along and settles the order
    of equal keys. Without it, rows that agree in key, source and size share their
    cell's copies in any order, which gives the same rows.
    """
    rows = [row] if row else []
    sized = saved(
        docs.select(
            F.col(key),
            *rows,
            F.col(source).cast("string").alias("source"),
            source_key(source).alias("_key"),
            word_count(text).alias("size"),
            F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("_hash"),
        )
    )
    cells = saved(sized.groupBy("_key", "size").agg(F.count(F.lit(1)).alias("_n")))
    sizes = sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"))
    targets = saved(source_targets(sizes))
    state = balance(cells, targets)
    copies = rounded_cells(cells, state).select("_key", "size", "_n", "_m")
    settled = F.xxhash64(row) if row else F.monotonically_increasing_id()
    ranked = running_total(
        in_pieces(sized, 2, settled),
        ["_key", "size"],
        "_piece",
        ["_hash", "_tie", key, *rows],
        F.lit(1).cast("long"),
        "_place",
    )
    whole = F.floor(F.col("_m") / F.col("_n"))
    number = whole + F.when(F.col("_place") <= F.col("_m") - whole * F.col("_n"), 1).otherwise(0)
    return (
        ranked.join(copies, ["_key", "size"])
        .join(targets.select("_key", "source_size", "target"), "_key")
        .join(state.select("_key", "_scale", "_full", "_tilt"), "_key")
        .select(
            key,
            *rows,
            "size",
            "source_size",
            "target",
            _rate().alias("rate"),
            number.cast("int").alias("copies"),
            (number * F.col("size")).cast("long").alias("taken"),
        )
    )


@result_only
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
