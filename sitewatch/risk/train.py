"""Fit, cross-validate and save the dropout models."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.risk import forest, together
from sitewatch.risk.features import CATEGORICAL, LABEL, NUMERIC
from sitewatch.risk.folds import N_SPLITS, cv_folds
from sitewatch.risk.metrics import fold_scores
from sitewatch.risk.prep import (
    NumberStats,
    Preparation,
    add_columns,
    fit_preparation,
    fit_preparations,
    present_sql,
)
from sitewatch.risk.sample import stratified_sample
from sitewatch.session import process_scope, result_only, saved, shared_folder

# Model and metric names.
LOGISTIC = "Logistic regression"
FOREST = "Random forest"
METRICS = ("ROC-AUC", "Balanced accuracy")

# A fit whose mean loss is steeper than this in some coefficient is refused.
FLAT = 1e-4
TINY = 1e-300


@dataclass(frozen=True)
class Settings:
    """Estimator settings. ``penalty`` is the inverse strength of the L2 term.

    The nodes of a forest that is fit by itself are held on the driver and grow with
    the rows it is fit on. ``forest_rows`` bounds these: each forest is then fit on a
    stratified sample of its training set. It is off by default. ``parallelism`` bounds
    such fits, and so the forests, held at a time; the session's cores bound it further.
    """

    penalty: float = 1.0
    max_iter: int = 1000
    n_trees: int = 300
    min_leaf: int = 5
    max_depth: int = 30  # the deepest that Spark grows
    max_bins: int = 64
    seed: int = 42
    parallelism: int = 8
    forest_rows: int | None = None

    @property
    def grower(self) -> forest.Grower:
        return forest.Grower(self.n_trees, self.min_leaf, self.max_depth, self.max_bins, self.seed)


@dataclass(frozen=True)
class RiskModel:
    """Preparation and classifier as one saved pipeline, with its input names."""

    pipeline: PipelineModel
    names: tuple[str, ...]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk``, the probability of discontinuing."""
        scored = self.pipeline.transform(df)
        return scored.withColumn("risk", vector_to_array("probability")[1]).select(
            *df.columns, "risk"
        )

    @property
    def coefficients(self) -> list[float]:
        return [float(c) for c in self.pipeline.stages[-1].coefficients]

    def save(self, folder: str) -> None:
        spark = SparkSession.active()
        self.pipeline.write().overwrite().save(f"{folder}/pipeline")
        _save_names(spark, folder, self.names)

    @staticmethod
    def is_at(spark: SparkSession, folder: str) -> bool:
        try:
            return bool(spark.read.parquet(f"{folder}/names").columns)
        except AnalysisException:
            return False

    @classmethod
    def load(cls, folder: str) -> RiskModel:
        return cls(PipelineModel.load(f"{folder}/pipeline"), _saved_names(SparkSession.active(), folder))


def _save_names(spark: SparkSession, folder: str, names: tuple[str, ...]) -> None:
    """Written last: where names are, the model is whole."""
    table = pa.table({"position": range(len(names)), "name": list(names)})
    spark.createDataFrame(table).write.mode("overwrite").parquet(f"{folder}/names")


def _saved_names(spark: SparkSession, folder: str) -> tuple[str, ...]:
    rows = spark.read.parquet(f"{folder}/names").orderBy("position").collect()
    return tuple(r["name"] for r in rows)


@dataclass(frozen=True)
class ForestModel:
    """Preparation and trees that were grown in tasks, used and saved like a ``RiskModel``."""

    prep: Preparation
    cuts: list[np.ndarray]
    trees: forest.Trees

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(self.prep.design())

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``risk``, the probability of discontinuing."""
        prep, cuts, trees = self.prep, self.cuts, self.trees

        @F.pandas_udf("double")
        def risk(columns: pd.DataFrame) -> pd.Series:
            table = pa.table({c: pa.array(columns[c], from_pandas=True) for c in columns.columns})
            bins = forest.binned(together.Inputs(table).design(prep, scaled=False), cuts)
            return pd.Series(trees.votes(bins) / trees.n)

        inputs = F.struct(
            *(F.expr(present_sql(c)).alias(c) for c in NUMERIC),
            *(F.col(c).cast("string").alias(c) for c in CATEGORICAL),
        )
        return df.select("*", risk(inputs).alias("risk"))

    def save(self, folder: str) -> None:
        spark = SparkSession.active()
        told = {**asdict(self.prep), "class_counts": sorted(self.prep.class_counts.items())}
        column, bin_, left, share = (a.tobytes() for a in self.trees.arrays())
        table = pa.table(
            {
                "prep": [json.dumps(told)],
                "cuts": [[c.tolist() for c in self.cuts]],
                "n": [self.trees.n],
                **{k: pa.array([v], pa.binary()) for k, v in zip("abcd", (column, bin_, left, share))},
            }
        )
        spark.createDataFrame(table).write.mode("overwrite").parquet(f"{folder}/trees")
        _save_names(spark, folder, self.names)

    @classmethod
    def load(cls, folder: str) -> ForestModel:
        row = SparkSession.active().read.parquet(f"{folder}/trees").first()
        told = json.loads(row["prep"])
        prep = Preparation(
            numbers=tuple(NumberStats(**n) for n in told["numbers"]),
            levels={c: tuple(levels) for c, levels in told["levels"].items()},
            class_counts=dict(told["class_counts"]),
        )
        return cls(prep, [np.array(c) for c in row["cuts"]], forest.Trees.of(row["n"], [row[k] for k in "abcd"]))


def load_model(spark: SparkSession, folder: str) -> RiskModel | ForestModel:
    """The model that was saved there, whichever it is."""
    try:
        spark.read.parquet(f"{folder}/trees").columns
    except AnalysisException:
        return RiskModel.load(folder)
    return ForestModel.load(folder)


def _preparing_stages(train: DataFrame, prep: Preparation) -> tuple[list, tuple[str, ...]]:
    """Scaled numbers and one sparse vector per category, whatever its levels."""
    numbers = {f"x{i}": sql for i, sql in enumerate(prep.scaled().values())}
    # The first level has no place of its own: like one never seen, it gives zeros.
    others = {f"c{i}": (c, known[1:]) for i, (c, known) in enumerate(prep.levels.items()) if known[1:]}
    marked = {x: f"coalesce(concat('v', `{c}`), 'missing')" for x, (c, _) in others.items()}
    columns = ", ".join(f"{sql} AS {x}" for x, sql in {**numbers, **marked}.items())
    stages = [SQLTransformer(statement=f"SELECT *, {columns} FROM __THIS__")]
    for x, (_, known) in others.items():
        labels = ["missing" if level is None else f"v{level}" for level in known]
        stages.append(
            StringIndexerModel.from_labels(labels, inputCol=x, outputCol=f"{x}_index", handleInvalid="keep")
        )
    if others:
        # The encoder reads the number of levels from the indexers, not from rows.
        indexed = PipelineModel(stages).transform(train)
        stages.append(
            OneHotEncoder(
                inputCols=[f"{x}_index" for x in others], outputCols=[f"{x}_dummies" for x in others]
            ).fit(indexed)
        )
    inputs = [*numbers, *(f"{x}_dummies" for x in others)]
    return [*stages, VectorAssembler(inputCols=inputs, outputCol="inputs")], tuple(prep.design())


def _check_classes(prep: Preparation) -> None:
    if len(prep.class_counts) < 2:
        raise ValueError("the training rows hold one class only")


def _estimator(kind: str, prep: Preparation, settings: Settings):
    _check_classes(prep)
    common = {"featuresCol": "inputs", "labelCol": LABEL, "weightCol": "weight"}
    if kind == LOGISTIC:
        return LogisticRegression(
            **common,
            # Balanced weights sum to the row count, which turns Spark's mean
            # loss into the summed loss the penalty is stated for.
            regParam=1.0 / (settings.penalty * prep.n_rows),
            elasticNetParam=0.0,
            standardization=False,
            maxIter=settings.max_iter,
            # Tighter, and the line search may find no step that still helps.
            tol=1e-7,
        )
    return RandomForestClassifier(
        **common,
        numTrees=settings.n_trees,
        minInstancesPerNode=settings.min_leaf,
        maxDepth=settings.max_depth,
        maxBins=settings.max_bins,
        featureSubsetStrategy="sqrt",
        # Deep trees: rows remember their nodes, checkpointed as the session says.
        cacheNodeIds=True,
        seed=settings.seed,
    )


def fit_model(
    kind: str, train: DataFrame, prep: Preparation, settings: Settings = Settings()
) -> RiskModel | ForestModel:
    if kind == FOREST:
        n_rows = prep.n_rows
        if settings.forest_rows is not None:
            # What is known of the columns, and the weights, stay those of all rows.
            train = stratified_sample(train, settings.forest_rows, settings.seed)
            n_rows = min(n_rows, settings.forest_rows + len(prep.class_counts))
        if forest.fits(n_rows, together.n_columns(prep), settings.max_bins):
            _check_classes(prep)
            trees, cuts = together.grow_forest(train, prep, settings.grower)
            return ForestModel(prep, cuts, trees)
        _keep_checkpoints(train.sparkSession)
    stages, names = _preparing_stages(train, prep)
    weighted = add_columns(train, {"weight": prep.weight_sql()})
    ready = PipelineModel(stages).transform(weighted).select("inputs", LABEL, "weight")
    fitted = _estimator(kind, prep, settings).fit(ready)
    if kind == LOGISTIC:
        _check_settled(fitted, ready, settings)
    return RiskModel(PipelineModel([*stages, fitted]), names)


def _keep_checkpoints(spark: SparkSession) -> None:
    """A folder for the rows' nodes, without which a forest's lineage grows with its depth."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, process_scope()))


def _check_settled(fitted: LogisticRegressionModel, ready: DataFrame, settings: Settings) -> None:
    """Raise unless the solver stopped by itself where the mean loss is flat."""
    if fitted.summary.totalIterations >= settings.max_iter:
        raise RuntimeError(f"the solver did not settle in {settings.max_iter} steps")
    scored = fitted.transform(ready)
    miss = F.col("weight") * (vector_to_array("probability")[1] - F.col(LABEL))
    # Summed apart, as weights must not be negative, nor all be 0.
    parts = {"over": F.greatest(miss, F.lit(TINY)), "under": F.greatest(-miss, F.lit(TINY))}
    sums = scored.select("inputs", *(part.alias(name) for name, part in parts.items())).agg(
        *(Summarizer.sum(F.col("inputs"), F.col(name)).alias(f"{name} inputs") for name in parts),
        *(F.sum(name).alias(name) for name in parts),
        F.count("*").alias("n"),
    ).first()
    slopes = (sums["over inputs"].toArray() - sums["under inputs"].toArray()) / sums["n"]
    slopes += fitted.getRegParam() * fitted.coefficients.toArray()
    steepest = max(abs(slopes).max(initial=0.0), abs(sums["over"] - sums["under"]) / sums["n"])
    if not steepest <= FLAT:
        raise RuntimeError(f"the solver stopped at a slope of {steepest:.2g}")


def fit_final(features: DataFrame, settings: Settings = Settings()) -> RiskModel:
    """The interpretable model on all rows."""
    return fit_model(LOGISTIC, features, fit_preparation(features), settings)


@result_only
def evaluate(
    features: DataFrame,
    n_repeats: int = 10,
    settings: Settings = Settings(),
    kinds: tuple[str, ...] = (LOGISTIC, FOREST),
    models: str | None = None,
) -> DataFrame:
    """Repeated stratified cross-validation: mean and SD of each score per model.

    Folds and held-out scores are written to the shared folder, so no fit has
    to derive the features again and a lost executor costs only its tasks. All training
    sets are fit at once where that can be, and a fitted model is let go of once its fold
    is scored. With a folder ``models`` each is fit by itself and written there first, and
    a later call on the same features and settings starts from what it finds there.
    """
    spark = features.sparkSession
    folder = shared_folder(spark)
    cv_folds(features, n_repeats, settings.seed).write.partitionBy("repeat").parquet(
        f"{folder}/folds"
    )
    rows = spark.read.parquet(f"{folder}/folds").withColumn(
        "repeat", F.col("repeat").cast("bigint")
    )
    preps = _training_preparations(rows, n_repeats)
    parts = []
    for kind in kinds:
        if models is None and _fit_together(kind, preps, settings):
            scored = _scored_together(kind, rows, preps, n_repeats, settings)
        else:
            scored = _scored_apart(kind, rows, preps, n_repeats, settings, folder, models)
        parts.append(scored.withColumn("model", F.lit(kind)))
    # Written, as both metrics read it.
    scored = saved(reduce(DataFrame.unionByName, parts))
    return cv_summary(fold_scores(scored, "risk", LABEL, ["model", "repeat", "fold"]))


def _fit_together(kind: str, preps: Mapping[int, Preparation], settings: Settings) -> bool:
    """Whether one job can fit all training sets."""
    widths = [together.n_columns(p) for p in preps.values()]
    if kind == LOGISTIC:
        return max(widths, default=0) <= together.MOST_COLUMNS
    # A task has the rows held out, too.
    return settings.forest_rows is None and all(
        forest.fits(p.n_rows * N_SPLITS // (N_SPLITS - 1), width, settings.max_bins)
        for p, width in zip(preps.values(), widths)
    )


def _scored_together(
    kind: str, rows: DataFrame, preps: Mapping[int, Preparation], n_repeats: int, settings: Settings
) -> DataFrame:
    for repeat in range(1, n_repeats + 1):
        for held in range(N_SPLITS):
            _check_classes(preps[repeat * N_SPLITS + held])
    if kind == FOREST:
        return together.forest_scores(rows, preps, n_repeats, N_SPLITS, settings.grower)
    fits = together.logistic_fits(rows, preps, N_SPLITS, settings.penalty, settings.max_iter, FLAT)
    return together.logistic_scores(rows, preps, fits, N_SPLITS)


def _scored_apart(
    kind: str,
    rows: DataFrame,
    preps: Mapping[int, Preparation],
    n_repeats: int,
    settings: Settings,
    folder: str,
    models: str | None,
) -> DataFrame:
    """A fit of its own for each training set, some at a time."""
    spark = rows.sparkSession

    def fitted(train: DataFrame, repeat: int, fold: int) -> RiskModel | ForestModel:
        prep = preps[repeat * N_SPLITS + fold]
        if models is None:
            return fit_model(kind, train, prep, settings)
        place = f"{models}/{kind.split()[0].lower()}/repeat={repeat}/fold={fold}"
        if not RiskModel.is_at(spark, place):
            fit_model(kind, train, prep, settings).save(place)
        return load_model(spark, place)

    def run(task: tuple[int, int]) -> None:
        repeat, fold = task
        mine = rows.filter(F.col("repeat") == repeat)
        train, test = (mine.filter(F.col("fold") != fold), mine.filter(F.col("fold") == fold))
        fitted(train, repeat, fold).score(test).select("USUBJID", LABEL, "risk").write.parquet(
            f"{folder}/scored/model={kind}/repeat={repeat}/fold={fold}"
        )

    tasks = [(repeat, fold) for repeat in range(1, n_repeats + 1) for fold in range(N_SPLITS)]
    at_once = min(settings.parallelism, spark.sparkContext.defaultParallelism)
    with ThreadPool(at_once) as pool:
        pool.map(inheritable_thread_target(spark)(run), tasks, chunksize=1)
    scored = spark.read.parquet(f"{folder}/scored/model={kind}")
    return scored.select(F.col("repeat").cast("bigint"), F.col("fold").cast("bigint"), LABEL, "risk")


def _training_preparations(rows: DataFrame, n_repeats: int) -> dict[int, Preparation]:
    """One preparation per (repeat, held-out fold), merged from the other folds' statistics."""
    cells = rows.withColumn("_cell", F.col("repeat") * N_SPLITS + F.col("fold"))
    sets = {
        repeat * N_SPLITS + held: [repeat * N_SPLITS + fold for fold in range(N_SPLITS) if fold != held]
        for repeat in range(1, n_repeats + 1)
        for held in range(N_SPLITS)
    }
    return fit_preparations(cells, "_cell", sets)


def cv_summary(scores: DataFrame) -> DataFrame:
    """Mean and population SD over folds."""
    return (
        scores.groupBy("model", "metric")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
        .orderBy("model", F.desc("metric"))
    )


def quoted_score(results: DataFrame, model: str = LOGISTIC, metric: str = "ROC-AUC") -> DataFrame:
    """The one row a report quotes."""
    return results.filter((F.col("model") == model) & (F.col("metric") == metric)).limit(1)
