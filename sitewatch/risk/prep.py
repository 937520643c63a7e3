"""Median imputation, scaling and dummies, learned from one or many training sets.

Only medians, means, deviations, levels and class counts reach the driver.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from sitewatch.functions.text import text_sql
from sitewatch.risk.features import CATEGORICAL, LABEL, NUMERIC, check_no_leaks, check_sources
from sitewatch.session import saved, scratch

# Size of a quantile sketch; its ranks are off by 0.3 % in 99 of 100 cases.
SKETCH = 1024
# Ranks on each side of the middle that the bracket takes in.
MARGIN = 0.01
# The values inside a bracket are ranked in this many pieces.
PIECES = 64


def number_sql(value: float) -> str:
    return f"({float(value)!r}D)"


def present_sql(column: str) -> str:
    """The column as a number; not-a-number counts as missing."""
    return f"nullif(cast(`{column}` AS double), double('NaN'))"


@dataclass(frozen=True)
class NumberStats:
    name: str
    median: float
    mean: float  # after imputation, like the deviation
    deviation: float

    @property
    def imputed_sql(self) -> str:
        return f"coalesce({present_sql(self.name)}, {number_sql(self.median)})"

    @property
    def scaled_sql(self) -> str:
        spread = number_sql(self.deviation or 1.0)
        return f"({self.imputed_sql} - {number_sql(self.mean)}) / {spread}"


@dataclass(frozen=True)
class Preparation:
    """What a training set teaches about its columns."""

    numbers: tuple[NumberStats, ...]
    levels: dict[str, tuple[str | None, ...]]
    class_counts: dict[int, int]

    @property
    def n_rows(self) -> int:
        return sum(self.class_counts.values())

    def imputed(self) -> dict[str, str]:
        return {n.name: n.imputed_sql for n in self.numbers}

    def scaled(self) -> dict[str, str]:
        return {n.name: n.scaled_sql for n in self.numbers}

    def dummies(self) -> dict[str, str]:
        """One column per level but the first; a level never seen gives zeros."""
        out = {}
        for column, levels in self.levels.items():
            for level in levels[1:]:
                is_level = f"`{column}` IS NULL" if level is None else f"`{column}` <=> {text_sql(level)}"
                out[f"{column}_{level}"] = f"CASE WHEN {is_level} THEN 1.0D ELSE 0.0D END"
        return out

    def design(self) -> dict[str, str]:
        return {**self.scaled(), **self.dummies()}

    def class_weight(self, value: int) -> float:
        return self.n_rows / (len(self.class_counts) * self.class_counts[value])

    def weight_sql(self) -> str:
        cases = " ".join(
            f"WHEN {value} THEN {number_sql(self.class_weight(value))}"
            for value in sorted(self.class_counts)
        )
        return f"CASE `{LABEL}` {cases} END"


def add_columns(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in expressions.items()})


def fit_preparations(
    df: DataFrame, cell_column: str, sets: Mapping[int, Sequence[int]] | None = None
) -> dict[int, Preparation]:
    """One preparation per training set, which is a union of cells.

    ``cell_column`` says in which cell a row counts. Every row is counted once, in
    its own cell; what a training set teaches is merged from its cells. Without
    ``sets`` each cell is a training set of its own.
    """
    check_no_leaks((*NUMERIC, *CATEGORICAL))
    check_sources(df)
    learning = df.select(
        F.col(cell_column).cast("bigint").alias("cell"),
        *(F.expr(present_sql(c)).alias(c) for c in NUMERIC),
        *CATEGORICAL,
        LABEL,
    ).persist()
    try:
        return _learn(learning, sets)
    finally:
        learning.unpersist()


def _learn(
    learning: DataFrame, sets: Mapping[int, Sequence[int]] | None
) -> dict[int, Preparation]:
    with scratch():
        told = _cell_statistics(learning)
        cells = {r["cell"]: _moments(r) for r in told.drop(*map(_sketch, NUMERIC)).collect()}
        if sets is None:
            sets = {cell: (cell,) for cell in cells}
        # A set of cells without rows teaches nothing.
        sets = {s: [c for c in parts if c in cells] for s, parts in sets.items()}
        sets = {s: parts for s, parts in sets.items() if parts}
        for c in NUMERIC:
            if any(math.isinf(end) for m in cells.values() if m[c].n for end in (m[c].low, m[c].high)):
                raise ValueError(f"{c} holds an infinite value")
        merged = {
            s: {c: functools.reduce(Moments.merge, (cells[part][c] for part in parts)) for c in NUMERIC}
            for s, parts in sets.items()
        }
        present = {(s, c): m[c].n for s, m in merged.items() for c in NUMERIC if m[c].n}
        medians = _medians(learning, told, sets, present)
    counts = _level_counts(learning)
    out = {}
    for s, parts in sets.items():
        levels = {c: sum((counts[part][c] for part in parts), Counter()) for c in (*CATEGORICAL, LABEL)}
        n_rows = levels[LABEL].total()
        out[s] = Preparation(
            numbers=tuple(
                _with_imputed(c, merged[s][c], n_rows, medians[s, c]) for c in NUMERIC if merged[s][c].n
            ),
            levels={c: _sorted_levels(levels[c]) for c in CATEGORICAL},
            class_counts={int(v): n for v, n in levels[LABEL].items()},
        )
    return out


@dataclass(frozen=True)
class Moments:
    """Mergeable: the values present in one column of some cells."""

    n: int
    low: float | None
    high: float | None
    mean: float | None
    variance: float | None  # of the population

    def merge(self, other: Moments) -> Moments:
        if not (self.n and other.n):
            return self if self.n else other
        n, apart = self.n + other.n, other.mean - self.mean
        mean = self.mean + apart * (other.n / n)
        within = (self.n * self.variance + other.n * other.variance) / n
        between = apart * apart * (self.n / n) * (other.n / n)
        return Moments(n, min(self.low, other.low), max(self.high, other.high), mean, within + between)


def _sketch(column: str) -> str:
    return f"{column} sketch"


def _cell_statistics(learning: DataFrame, columns: Sequence[str] = NUMERIC) -> DataFrame:
    """Moments and a quantile sketch per cell and column, in one pass without a sort."""
    wanted = []
    for c in columns:
        wanted += [
            F.count(c).alias(f"{c} n"),
            F.min(c).alias(f"{c} low"),
            F.max(c).alias(f"{c} high"),
            F.avg(c).alias(f"{c} mean"),
            F.var_pop(c).alias(f"{c} variance"),
            F.kll_sketch_agg_double(c, SKETCH).alias(_sketch(c)),
        ]
    return saved(learning.groupBy("cell").agg(*wanted))


def _moments(row: Row, columns: Sequence[str] = NUMERIC) -> dict[str, Moments]:
    return {
        c: Moments(*(row[f"{c} {part}"] for part in ("n", "low", "high", "mean", "variance")))
        for c in columns
    }


def fit_preparation(df: DataFrame) -> Preparation:
    fitted = fit_preparations(df.withColumn("_cell", F.lit(0)), "_cell")
    if not fitted:
        raise ValueError("no rows to learn from")
    return fitted[0]


def _sorted_levels(counts: dict[str | None, int]) -> tuple[str | None, ...]:
    """In text order, which fixes the first level; a missing one comes last."""
    return tuple(sorted(counts, key=lambda level: (level is None, level or "")))


def _level_counts(learning: DataFrame) -> dict[int, dict[str, Counter]]:
    """Rows per cell and level of each categorical column, and per class."""
    pairs = F.array(
        *(
            F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level"))
            for c in (*CATEGORICAL, LABEL)
        )
    )
    counted = (
        learning.select("cell", F.inline(pairs))
        .groupBy("cell", "name", "level")
        .agg(F.count("*").alias("n"))
    )
    out: dict[int, dict[str, Counter]] = {}
    for row in counted.collect():
        out.setdefault(row["cell"], {}).setdefault(row["name"], Counter())[row["level"]] = row["n"]
    return out


def _with_imputed(column: str, present: Moments, n_rows: int, median: float) -> NumberStats:
    """Mean and population deviation once the missing values hold the median."""
    n, old_mean = present.n, present.mean
    missing = n_rows - n
    mean = (n * old_mean + missing * median) / n_rows
    spread = n * present.variance + n * missing / n_rows * (old_mean - median) ** 2
    return NumberStats(column, median, mean, (spread / n_rows) ** 0.5)


# --- Exact medians in two passes ---


def _medians(
    learning: DataFrame,
    told: DataFrame,
    sets: Mapping[int, Sequence[int]],
    present: Mapping[tuple[int, str], int],
) -> dict[tuple[int, str], float]:
    """Exact medians of every (set, column) in ``present``, which tells their counts.

    The sketches of the first pass, merged per set, bracket the middle. The second
    pass counts, per cell, what lies below the brackets and each value inside them;
    the exact ranks are found among those few values. Sketches are right 99 times in
    100; where a middle is not inside, that column's bracket becomes the whole line.
    """
    columns = sorted({c for _, c in present})
    pairs = pa.table(
        {"s": [s for s, parts in sets.items() for _ in parts], "cell": [c for parts in sets.values() for c in parts]},
        schema=pa.schema([("s", pa.int64()), ("cell", pa.int64())]),
    )
    # One row per set and cell: bounded by folds and repeats, not by rows.
    pairs = F.broadcast(learning.sparkSession.createDataFrame(pairs))
    brackets = _brackets(told, pairs, columns)
    medians: dict[tuple[int, str], float] = {}
    while columns:
        values, below = _around(learning, {c: brackets[c] for c in columns})
        cut = _in_pieces(values)
        targets = _targets(cut, below, sets, {k: n for k, n in present.items() if k[1] in columns}, columns)
        found = _values_at(cut, pairs, targets, columns)
        missed = {c for (_, c), ranks in targets.items() if None in ranks}
        for (s, c), ranks in targets.items():
            if c not in missed:
                lower, upper = (found[s, c, *rank] for rank in ranks)
                total = lower + upper
                medians[s, c] = lower / 2 + upper / 2 if math.isinf(total) else total / 2
        columns = sorted(missed)
        brackets |= {c: (-math.inf, math.inf) for c in columns}
    return medians


def _brackets(told: DataFrame, pairs: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Per column a stretch of values around the middles of all sets."""
    merged = told.join(pairs, "cell").groupBy("s").agg(
        *(F.kll_merge_agg_double(_sketch(c)).alias(_sketch(c)) for c in columns)
    )

    def end(c: str, rank: float) -> Column:
        there = F.kll_sketch_get_n_double(_sketch(c)) > 0
        return F.when(there, F.kll_sketch_get_quantile_double(_sketch(c), F.lit(rank)))

    row = merged.agg(
        *(F.min(end(c, 0.5 - MARGIN)).alias(f"{c} low") for c in columns),
        *(F.max(end(c, 0.5 + MARGIN)).alias(f"{c} high") for c in columns),
    ).first()
    return {c: (row[f"{c} low"], row[f"{c} high"]) for c in columns}


def _around(
    learning: DataFrame, brackets: Mapping[str, tuple[float, float]]
) -> tuple[DataFrame, dict[tuple[int, str], int]]:
    """Counts of each value inside the brackets, and how many lie below, per cell.

    A row gives one entry that says in which columns it lies below, and one for each
    column in which it lies inside, which is rare. Entries are counted before any
    shuffle.
    """
    number = {c: i for i, c in enumerate(brackets)}
    mask = functools.reduce(
        Column.__add__,
        (F.when(F.col(c) < low, F.lit(2**number[c])).otherwise(0) for c, (low, _) in brackets.items()),
    )
    nothing = F.lit(None).cast("double")
    entries = [F.struct(F.lit(-1).alias("column"), nothing.alias("value"), mask.cast("bigint").alias("mask"))]
    for c, (low, high) in brackets.items():
        inside = F.struct(F.lit(number[c]).alias("column"), F.col(c).alias("value"), F.lit(0).cast("bigint").alias("mask"))
        entries.append(F.when(F.col(c).between(low, high), inside))
    counted = saved(
        learning.select("cell", F.inline(F.filter(F.array(*entries), lambda e: e.isNotNull())))
        .groupBy("cell", "column", "value", "mask")
        .agg(F.count("*").alias("n"))
    )
    below: dict[tuple[int, str], int] = Counter()
    for row in counted.filter(F.col("column") < 0).collect():  # a row per cell and mask at most
        for c, i in number.items():
            if row["mask"] >> i & 1:
                below[row["cell"], c] += row["n"]
    return counted.filter(F.col("column") >= 0).drop("mask"), below


def _in_pieces(values: DataFrame) -> DataFrame:
    """Add ``piece``: consecutive stretches of each column with about as many values."""
    shares = [(i + 1) / PIECES for i in range(PIECES - 1)]
    # One row per column.
    cuts = F.broadcast(values.groupBy("column").agg(F.percentile_approx("value", shares).alias("cuts")))
    piece = F.size(F.filter("cuts", lambda cut: cut <= F.col("value")))
    return values.join(cuts, "column").withColumn("piece", piece).drop("cuts")


def _targets(
    cut: DataFrame,
    below: Mapping[tuple[int, str], int],
    sets: Mapping[int, Sequence[int]],
    present: Mapping[tuple[int, str], int],
    columns: Sequence[str],
) -> dict[tuple[int, str], list[tuple[int, int] | None]]:
    """Per set and column its two middle ranks as (piece, rank in it); None if outside."""
    totals: dict[str, dict[int, Counter]] = {c: {} for c in columns}
    for row in cut.groupBy("column", "piece", "cell").agg(F.sum("n").alias("n")).collect():
        totals[columns[row["column"]]].setdefault(row["piece"], Counter())[row["cell"]] = row["n"]
    out: dict[tuple[int, str], list[tuple[int, int] | None]] = {}
    for (s, c), n in present.items():
        skipped = sum(below.get((cell, c), 0) for cell in sets[s])
        out[s, c] = []
        for rank in ((n + 1) // 2, n // 2 + 1):
            left, place = rank - skipped, None
            for piece in sorted(totals[c]) if left > 0 else ():
                here = sum(totals[c][piece][cell] for cell in sets[s])
                if left <= here:
                    place = (piece, left)
                    break
                left -= here
            out[s, c].append(place)
    return out


def _values_at(
    cut: DataFrame,
    pairs: DataFrame,
    targets: Mapping[tuple[int, str], Sequence[tuple[int, int] | None]],
    columns: Sequence[str],
) -> dict[tuple[int, str, int, int], float]:
    """The value at each (set, column, piece, rank)."""
    wanted = sorted({(s, columns.index(c), *place) for (s, c), places in targets.items() for place in places if place})
    if not wanted:
        return {}
    names = ("s", "column", "piece", "rank")
    table = pa.table([pa.array(v, pa.int64()) for v in zip(*wanted)], names=list(names))
    # Two rows per set and column at most.
    asked = F.broadcast(cut.sparkSession.createDataFrame(table))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("value"))
    found = (
        cut.join(asked, ["column", "piece"])
        .join(pairs, ["s", "cell"])
        .withColumn("upto", upto)
        .filter(F.col("upto") >= F.col("rank"))
        .groupBy(*names)
        .agg(F.min("value").alias("value"))
    )
    return {(r["s"], columns[r["column"]], r["piece"], r["rank"]): r["value"] for r in found.collect()}


def class_weights(features: DataFrame) -> DataFrame:
    """Balanced weight per class: rows over classes times rows of the class."""
    classes = features.groupBy(LABEL).agg(F.count("*").alias("subjects"))
    everything = Window.partitionBy()
    total = F.sum("subjects").over(everything)
    n_classes = F.count("*").over(everything)
    weight = total.cast("double") / (n_classes * F.col("subjects"))
    return classes.withColumn("class_weight", F.round(weight, 6))
