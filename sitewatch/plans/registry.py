"""Every operator as a query over the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.operators import checks as C
from sitewatch.operators import distinct, frames, load, views
from sitewatch.risk import explain, metrics, prep, train
from sitewatch.risk.features import LABEL, NUMERIC, landmark_features
from sitewatch.risk.folds import cv_folds
from sitewatch.session import saved
from sitewatch.sources.binding import bind
from sitewatch.sources.tables import Domains

Query = Callable[[SparkSession, str], DataFrame]


def _bound(build: Callable[[Domains], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(bind(spark, sf_dir))


# --- Loading steps, on columns made untidy on purpose ---


def _tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("c_custkey") % 7
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    untidy = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey",
        F.when(turn == 0, F.concat(F.lit("  "), name, F.lit("   ")))
        .when(turn == 1, F.concat(F.lit("\t"), name, F.lit("\n")))
        .otherwise(name)
        .alias("c_name"),
        F.when(turn == 2, "")
        .when(turn == 3, "    ")
        .when(turn == 4, F.concat(segment, F.lit("  ")))
        .otherwise(segment)
        .alias("c_mktsegment"),
    )
    return load.tidy_blanks(untidy)


def _sas_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1960-01-01").cast("date"))
    numbered = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 9 != 0, days.cast("double")).alias("TRTSDT"),
        (days - 20_000).cast("double").alias("VISIT1DT"),
    )
    return load.convert_sas_dates(numbered, ("TRTSDT", "VISIT1DT", "RFENDT"))


# --- Views and frames ---


def _sites(d: Domains) -> DataFrame:
    return views.site_enrolment(d["dm"])


def _outcomes(d: Domains) -> DataFrame:
    return views.disposition(d["ds"], d["adsl"])


def _windows(days: int) -> Callable[[Domains], DataFrame]:
    return lambda d: views.visit_windows(d["sv"], d["dm"], days)


def _systems(d: Domains) -> DataFrame:
    return views.ae_by_body_system(d["ae"], d["adsl"])


def _kpis(d: Domains) -> DataFrame:
    return frames.kpis(_sites(d), _outcomes(d), C.run_checks(d))


#: What names a row of each ordered view, besides its place.
ORDERED = {
    "site_enrolment": ("site",),
    "enrolment_over_time": ("month",),
    "disposition": ("arm", "disposition"),
    "retention_by_visit": distinct.VISIT_KEYS,
    "visit_windows": ("site",),
    "ae_by_site": ("site",),
    "ae_by_body_system": distinct.SYSTEM_KEYS,
}


def _placed(name: str, df: DataFrame) -> DataFrame:
    """The place of each row as the view delivers it, with a digest of what names the row."""

    def told(column: str) -> Column:
        kind = dict(df.dtypes)[column]
        text = F.col(column).cast("bigint") if kind == "double" else F.col(column)
        return F.coalesce(text.cast("string"), F.lit("?"))

    # Rises with the view's order; a view has few rows, so one window can count them.
    numbered = df.withColumn("_at", F.monotonically_increasing_id())
    return numbered.select(
        F.lit(name).alias("view"),
        F.row_number().over(Window.orderBy("_at")).cast("bigint").alias("place"),
        F.md5(F.concat_ws("|", *map(told, ORDERED[name]))).alias("digest"),
    )


def _orders(d: Domains) -> DataFrame:
    placed = [_placed(name, over_domains()[name](d)) for name in ORDERED]
    return functools.reduce(DataFrame.unionByName, placed)


def _estimated(d: Domains, sketch: Callable, exact: DataFrame, keys: tuple[str, ...], count: str) -> DataFrame:
    """Exact counts, and whether estimates united from two parts of the study are near.

    The parts share subjects: one has the sites of even, the other of all numbers.
    """
    even = d["adsl"].filter(F.substring("SITEID", 2, 9).cast("int") % 2 == 0)
    parts = [saved(sketch(even)), saved(sketch(d["adsl"]))]
    near = distinct.estimated(distinct.united(parts, keys), "estimate")
    off = F.abs(F.col("estimate") - F.col(count))
    # Joined on values that may be missing.
    same = functools.reduce(Column.__and__, (exact[k].eqNullSafe(near[k]) for k in keys))
    return exact.join(near, same).select(
        *(exact[k] for k in keys), count, (off <= F.ceil(F.col(count) * F.lit(0.05))).alias("within_bound")
    )


def _systems_estimated(d: Domains) -> DataFrame:
    exact = _systems(d)
    return _estimated(
        d, lambda adsl: distinct.system_sketches(d["ae"], adsl), exact, distinct.SYSTEM_KEYS, "subjects_with_ae"
    )


def _retention_estimated(d: Domains) -> DataFrame:
    exact = views.retention_by_visit(d["sv"], d["adsl"]).drop("pct_retained")
    return _estimated(
        d, lambda adsl: distinct.visit_sketches(d["sv"], adsl), exact, distinct.VISIT_KEYS, "attended"
    )


# --- Dropout model ---


def _features(d: Domains) -> DataFrame:
    return landmark_features(d["adsl"], d["ae"])


def _written_features(d: Domains) -> DataFrame:
    """The features, derived once for a query that reads them several times."""
    return saved(_features(d))


def _imputed(d: Domains) -> DataFrame:
    features = _written_features(d)
    fitted = prep.fit_preparation(features)
    return prep.add_columns(features, fitted.imputed()).select(
        "USUBJID", "SEX", "TRT01P", *NUMERIC
    )


def _prepared(d: Domains, with_dummies: bool) -> DataFrame:
    features = _written_features(d)
    fitted = prep.fit_preparation(features)
    dummies = fitted.dummies() if with_dummies else {}
    scaled = [
        (F.round(F.expr(sql), 6) + F.lit(0.0)).alias(name) for name, sql in fitted.scaled().items()
    ]
    return features.select(
        "USUBJID", *scaled, *(F.expr(sql).alias(name) for name, sql in dummies.items())
    )


def _folds(d: Domains) -> DataFrame:
    return cv_folds(_features(d)).select("USUBJID", "repeat", "fold", LABEL)


def _auc(d: Domains) -> DataFrame:
    scored = metrics.fixed_score(_features(d))
    return metrics.roc_auc(scored, "score", LABEL).select(F.round("roc_auc", 9).alias("roc_auc"))


def _balanced(d: Domains) -> DataFrame:
    scored = metrics.fixed_score(_features(d))
    return metrics.balanced_accuracy(scored, "score", LABEL).select(
        F.round("balanced_accuracy", 9).alias("balanced_accuracy")
    )


def _cv_of_score(d: Domains) -> DataFrame:
    """The cross-validated scores of a score that no fit is needed for."""
    folds = cv_folds(metrics.fixed_score(_written_features(d))).withColumn("model", F.lit("Fixed score"))
    scores = metrics.fold_scores(folds, "score", LABEL, ["model", "repeat", "fold"])
    return _rounded(train.cv_summary(scores), 9, "mean", "sd")


def _rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


def _fitted_odds(d: Domains) -> DataFrame:
    return explain.odds_ratios(train.fit_final(_written_features(d)))


def _odds(d: Domains) -> DataFrame:
    return _rounded(_fitted_odds(d), 3, "coef", "odds_ratio")


def _odds_direction(d: Domains) -> DataFrame:
    return _rounded(frames.odds_ratio_direction(_fitted_odds(d)), 3, "coef", "odds_ratio")


def _scores(d: Domains) -> DataFrame:
    features = _written_features(d)
    scored = train.fit_final(features).score(features)
    return _rounded(scored.select("USUBJID", "SITEID", "risk"), 3, "risk")


def _cv(d: Domains) -> DataFrame:
    return train.evaluate(_written_features(d))


def over_tables() -> dict[str, Query]:
    """Queries on the driver's own tables."""
    return {"tidy_blanks": _tidy, "sas_dates": _sas_dates}


def over_domains() -> dict[str, Callable[[Domains], DataFrame]]:
    """Queries on the six domains, wherever these come from."""
    return {
        "load_report": load.load_report,
        "site_enrolment": _sites,
        "enrolment_over_time": lambda d: views.enrolment_over_time(d["dm"]),
        "disposition": _outcomes,
        "retention_by_visit": lambda d: views.retention_by_visit(d["sv"], d["adsl"]),
        "visit_windows": _windows(7),
        "visit_windows_3": _windows(3),
        "visit_windows_14": _windows(14),
        "ae_by_site": lambda d: views.ae_by_site(d["ae"], d["adsl"]),
        "ae_by_body_system": _systems,
        "ae_by_body_system_estimated": _systems_estimated,
        "retention_by_visit_estimated": _retention_estimated,
        "view_orders": _orders,
        **{
            f"check_{c.check_id.lower()}": lambda d, c=c: C.run_checks(d, [c]) for c in C.CHECKS
        },
        "run_checks": C.run_checks,
        "run_checks_subset": lambda d: C.run_checks(d, C.select_checks("AE02", "SV02", "EX01")),
        "check_summary": lambda d: C.summarise(C.run_checks(d)),
        "issues_by_site_severity": lambda d: C.issues_by_site_severity(C.run_checks(d)),
        "checks_fired": lambda d: C.checks_fired(C.summarise(C.run_checks(d))),
        "issue_listing": lambda d: C.issue_listing(C.run_checks(d), ["AE05", "SV01"]),
        "systemic_checks": lambda d: C.systemic_checks(C.run_checks(d), d["dm"]),
        "kpis": _kpis,
        "completion_by_arm": lambda d: frames.completion_by_arm(_outcomes(d)),
        "site_view": lambda d: frames.site_view(_sites(d), _windows(7)(d)),
        "discontinuation_reasons": lambda d: frames.discontinuation_reasons(_outcomes(d)),
        "top_body_systems": lambda d: frames.top_body_systems(_systems(d)),
        "landmark_kpis": lambda d: frames.landmark_kpis(_features(d)),
        "landmark_features": _features,
        "imputed_features": _imputed,
        "scaled_features": lambda d: _prepared(d, with_dummies=False),
        "design_matrix": lambda d: _prepared(d, with_dummies=True),
        "class_weights": lambda d: prep.class_weights(_features(d)),
        "cv_folds": _folds,
        "auc_of_score": _auc,
        "balanced_accuracy_of_score": _balanced,
        "cv_of_score": _cv_of_score,
        "odds_ratios": _odds,
        "odds_ratio_direction": _odds_direction,
        "score_subjects": _scores,
        "cv_results": _cv,
    }


def queries() -> dict[str, Query]:
    return over_tables() | {name: _bound(build) for name, build in over_domains().items()}
