"""Time every query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

As in use, the six domains are loaded once and the queries run on the loaded
tables. The load is timed as a query of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from sitewatch.plans.jobs import load_domains  # noqa: E402
from sitewatch.plans.registry import over_domains, over_tables  # noqa: E402
from sitewatch.risk.features import landmark_features  # noqa: E402
from sitewatch.risk.train import evaluate  # noqa: E402
from sitewatch.session import SETTINGS, saved, scratch, shared_folder  # noqa: E402
from sitewatch.sources.binding import bind  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, action):
        start = time.perf_counter()
        result = action()
        seconds[name] = round(time.perf_counter() - start, 3)
        return result

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    def consumed(build):
        # What a query wrote on its way goes once its rows are read.
        with scratch():
            drain(build())

    # Start the engine before the clock.
    drain(over_tables()["tidy_blanks"](spark, sf_dir))
    with scratch():
        folder = shared_folder(spark)
        domains = timed("load", lambda: load_domains(bind(spark, sf_dir), folder))
        for name, query in over_tables().items():
            timed(name, lambda: consumed(lambda: query(spark, sf_dir)))
        for name, build in over_domains().items():
            if name != "cv_results":
                timed(name, lambda: consumed(lambda: build(domains)))
        # Ten repeats of the full query take ten times this; each has its ten fits, 300 trees a forest.
        features = saved(landmark_features(domains["adsl"], domains["ae"]))
        timed("cv_results_one_repeat_of_ten", lambda: consumed(lambda: evaluate(features, n_repeats=1)))
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries, load included",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
