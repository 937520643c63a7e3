"""Batch jobs, for spark-submit: load, views, checks, model.

    spark-submit --py-files sitewatch.zip sitewatch/plans/jobs.py load --raw RAW --data DATA
    spark-submit --py-files sitewatch.zip sitewatch/plans/jobs.py views --data DATA --out OUT
    spark-submit --py-files sitewatch.zip sitewatch/plans/jobs.py checks --data DATA --out OUT
    spark-submit --py-files sitewatch.zip sitewatch/plans/jobs.py model --data DATA --out OUT
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.operators import checks, frames, load, views
from sitewatch.risk import explain, train
from sitewatch.risk.features import LABEL, landmark_features
from sitewatch.session import job_session, scratch
from sitewatch.sources import xport
from sitewatch.sources.schema import DOMAIN_NAMES, SAS_DATE_COLUMNS
from sitewatch.sources.tables import Domains, read_domain_tables, read_domains


def read_raw_domain(spark: SparkSession, raw: str, name: str) -> DataFrame:
    """One transport file ``name.xpt``, or a folder ``name`` of many, made tidy."""
    path = f"{raw}/{name}"
    df = xport.read_transport(spark, path if xport.is_folder(path) else f"{path}.xpt")
    return load.convert_sas_dates(load.tidy_blanks(df), SAS_DATE_COLUMNS.get(name, ()))


def load_domains(domains: Domains, data: str) -> Domains:
    """Write every domain as a Parquet folder, replacing what was there."""
    for name in DOMAIN_NAMES:
        domains[name].write.mode("overwrite").parquet(f"{data}/{name}")
    return read_domains(SparkSession.active(), data)


def load_domain_tables(
    domains: Domains, database: str, buckets: int, plain: Sequence[str] = ()
) -> Domains:
    """Write every domain as a catalog table, bucketed by subject unless named in ``plain``.

    Joins and groupings by subject then read their buckets without a shuffle.
    A bucket is read by one task, so name the domains in which a few subjects
    own most rows.
    """
    spark = SparkSession.active()
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name in DOMAIN_NAMES:
        df = domains[name]
        writer = df.write
        if name not in plain:
            writer = (
                df.repartition(buckets, "USUBJID")
                .write.bucketBy(buckets, "USUBJID")
                .sortBy("USUBJID")
            )
        writer.mode("overwrite").saveAsTable(f"{database}.{name}")
    return read_domain_tables(spark, database)


def run_load(
    raw: str, data: str | None, database: str | None = None, buckets: int = 64, plain: Sequence[str] = ()
) -> DataFrame:
    """Load into a folder, or into the tables of a database."""
    spark = SparkSession.active()
    with scratch():
        raw_domains = {name: read_raw_domain(spark, raw, name) for name in DOMAIN_NAMES}
        if database:
            return load.load_report(load_domain_tables(raw_domains, database, buckets, plain))
        return load.load_report(load_domains(raw_domains, data))


def run_views(d: Domains, out: str, window_days: float = 7) -> None:
    """The seven views and the frames of the dashboard, one folder each."""
    sites = views.site_enrolment(d["dm"])
    outcomes = views.disposition(d["ds"], d["adsl"])
    windows = views.visit_windows(d["sv"], d["dm"], window_days)
    systems = views.ae_by_body_system(d["ae"], d["adsl"])
    spark = SparkSession.active()

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    # Frames start from the written views, so no view is computed twice.
    sites = save("site_enrolment", sites)
    outcomes = save("disposition", outcomes)
    windows = save("visit_windows", windows)
    systems = save("ae_by_body_system", systems)
    save("enrolment_over_time", views.enrolment_over_time(d["dm"]))
    save("retention_by_visit", views.retention_by_visit(d["sv"], d["adsl"]))
    save("ae_by_site", views.ae_by_site(d["ae"], d["adsl"]))
    save("completion_by_arm", frames.completion_by_arm(outcomes))
    save("site_view", frames.site_view(sites, windows))
    save("discontinuation_reasons", frames.discontinuation_reasons(outcomes))
    save("top_body_systems", frames.top_body_systems(systems))


def run_edit_checks(
    d: Domains, out: str, chosen: Sequence[str] = (), catalogue: Sequence = checks.CHECKS
) -> DataFrame:
    """Write the listing once; summary, counts and CSV start from what was written."""
    spark = SparkSession.active()
    checks.run_checks(d, catalogue).write.mode("overwrite").parquet(f"{out}/listing")
    listing = spark.read.parquet(f"{out}/listing")
    summary = checks.summarise(listing, catalogue)
    summary.write.mode("overwrite").parquet(f"{out}/summary")
    checks.issues_by_site_severity(listing).write.mode("overwrite").parquet(f"{out}/by_site")
    write_listing_csv(checks.issue_listing(listing, chosen), f"{out}/listing_csv")
    kpis = frames.kpis(
        views.site_enrolment(d["dm"]), views.disposition(d["ds"], d["adsl"]), listing
    )
    kpis.write.mode("overwrite").parquet(f"{out}/kpis")
    return summary


def write_listing_csv(listing: DataFrame, folder: str) -> None:
    listing.write.mode("overwrite").option("header", True).option("escape", '"').csv(folder)


def run_model(
    d: Domains, out: str, n_repeats: int = 10, settings: train.Settings = train.Settings()
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Write features, scores of the cross-validation, odds ratios, model and risks."""
    spark = SparkSession.active()
    landmark_features(d["adsl"], d["ae"]).write.mode("overwrite").parquet(f"{out}/features")
    features = spark.read.parquet(f"{out}/features")
    train.evaluate(features, n_repeats, settings).write.mode("overwrite").parquet(f"{out}/cv")
    model = train.fit_final(features, settings)
    model.save(f"{out}/model")
    ratios = frames.odds_ratio_direction(explain.odds_ratios(model))
    ratios.write.mode("overwrite").parquet(f"{out}/odds_ratios")
    model.score(features).select("USUBJID", "SITEID", LABEL, "risk").write.mode(
        "overwrite"
    ).parquet(f"{out}/risks")
    return frames.landmark_kpis(features), spark.read.parquet(f"{out}/cv"), ratios


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sitewatch")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name in ("load", "views", "checks", "model"):
        job = jobs.add_parser(name)
        loaded = job.add_mutually_exclusive_group(required=True)
        loaded.add_argument("--data", help="folder of the loaded domains")
        loaded.add_argument("--database", help="database of the loaded domains")
        if name == "load":
            job.add_argument("--raw", required=True, help="folder of the transport files")
            job.add_argument("--buckets", type=int, default=64, help="buckets of each table")
            job.add_argument("--plain", nargs="*", default=(), help="domains left without buckets")
        else:
            job.add_argument("--out", required=True, help="folder for the results")
        if name == "views":
            job.add_argument("--window-days", type=float, default=7)
        if name == "checks":
            job.add_argument("--only", nargs="*", default=(), help="check ids for the CSV")
        if name == "model":
            job.add_argument("--repeats", type=int, default=10)
            job.add_argument("--trees", type=int, default=train.Settings.n_trees)
    args = parser.parse_args(arguments)
    spark = job_session(f"sitewatch {args.job}")
    if args.job == "load":
        run_load(args.raw, args.data, args.database, args.buckets, args.plain).show(truncate=False)
        return
    if args.database:
        domains = read_domain_tables(spark, args.database)
    else:
        domains = read_domains(spark, args.data)
    if args.job == "views":
        run_views(domains, args.out, args.window_days)
    elif args.job == "checks":
        summary = run_edit_checks(domains, args.out, args.only)
        summary.show(summary.count(), truncate=False)
    else:
        settings = train.Settings(n_trees=args.trees)
        kpis, scores, ratios = run_model(domains, args.out, args.repeats, settings)
        kpis.show()
        train.quoted_score(scores).show(truncate=False)
        rounded = [F.round(c, 3).alias(c) for c in ("mean", "sd")]
        scores.select("model", "metric", *rounded).show(truncate=False)
        ratios.withColumns({c: F.round(c, 2) for c in ("coef", "odds_ratio")}).show(
            ratios.count(), truncate=False
        )


if __name__ == "__main__":
    main()
