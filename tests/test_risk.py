import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sitewatch.operators import frames
from sitewatch.plans import jobs
from sitewatch.risk import explain, metrics, prep, train
from sitewatch.risk.features import CATEGORICAL, LABEL, LEAKY, NUMERIC, check_no_leaks, early_counts, landmark_features
from sitewatch.risk.folds import cv_folds
from sitewatch.risk.lineage import sources
from sitewatch.risk.sample import stratified_sample
from sitewatch.sources.binding import bind
from tests.planted import domains

SCHEMA = (
    "USUBJID string, SITEID string, AGE double, SEX string, BMIBL double, EDUCLVL double, "
    "DURDIS double, MMSETOT double, TRT01P string, early_ae_count bigint, "
    "early_ae_mod_sev bigint, discontinued bigint"
)


def subjects(spark, n, seed=0, effect=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        age, aes, arm = rng.gauss(75, 8), rng.randint(0, 6), rng.choice(["Placebo", "High", "Low"])
        logit = effect * (0.1 * (age - 75) + 0.5 * (aes - 3) + (arm == "High"))
        rows.append((f"S{i}", "701", age, rng.choice("FM"),
                     None if rng.random() < 0.1 else rng.gauss(25, 4), float(rng.randint(6, 20)),
                     rng.random() * 100, float(rng.randint(10, 24)), arm, aes, min(aes, 2),
                     int(rng.random() < 1 / (1 + math.exp(-logit)))))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def people(spark):
    df = subjects(spark, 400).persist()
    yield df
    df.unpersist()


def test_landmark_rules(spark):
    adsl = [
        dict(USUBJID="EARLY", RFENDTC="2014-01-14"),  # day 14: already gone
        dict(USUBJID="STAYS", RFENDTC="2014-01-15", DISCONFL="Y"),
        dict(USUBJID="NODATE", RFENDTC=None),
        dict(USUBJID="TIMED", RFENDTC="2014-01-14T12:00"),
    ]
    ae = [dict(USUBJID="STAYS", AESTDY=d, AESEV=s)
          for d, s in [(1.0, "MILD"), (14.0, "SEVERE"), (14.5, "SEVERE"), (15.0, "MODERATE"),
                       (-1.0, "SEVERE"), (7.0, "MODERATE"), (None, "SEVERE"), (3.0, None)]]
    d = domains(spark, clean=False, adsl=adsl, ae=ae)
    got = {r["USUBJID"]: (r["early_ae_count"], r["early_ae_mod_sev"], r[LABEL])
           for r in landmark_features(d["adsl"], d["ae"]).collect()}
    assert got == {"STAYS": (4, 2, 1), "TIMED": (0, 0, 0)}


def test_no_leaky_inputs():
    assert not {*NUMERIC, *CATEGORICAL} & {*LEAKY}
    check_no_leaks((*NUMERIC, *CATEGORICAL))
    with pytest.raises(ValueError, match="CUMDOSE"):
        check_no_leaks(("AGE", "CUMDOSE"))


def test_a_renamed_late_column_is_refused(spark, small):
    d = bind(spark, small)
    features = landmark_features(d["adsl"], d["ae"])
    found = sources(features)
    assert "k" in found["AGE"] and "AESTDY" not in found["AGE"] and "DISCONFL" in found[LABEL]
    # Days on study, under the name of an input, over a rename, a join and a union.
    late = d["adsl"].select("USUBJID", F.length("RFENDTC").cast("double").alias("calm"))
    hidden = d["adsl"].drop("DURDIS").join(late.withColumnRenamed("calm", "DURDIS"), "USUBJID")
    with pytest.raises(ValueError, match="DURDIS comes from .*RFENDTC"):
        landmark_features(hidden, d["ae"])
    with pytest.raises(ValueError, match="DURDIS comes from .*RFENDTC"):
        landmark_features(d["adsl"].unionByName(hidden), d["ae"])
    told = features.withColumn("AGE", F.col(LABEL) * 1.5)
    with pytest.raises(ValueError, match="AGE comes from .*DISCONFL"):
        prep.fit_preparation(told)


def test_an_event_after_the_landmark_is_refused(spark):
    def counts(day):
        events = spark.createDataFrame([("S1", day, "SEVERE"), ("S1", 1.0, None)], "USUBJID string, AESTDY double, AESEV string")
        return [tuple(r) for r in early_counts(events).collect()]

    assert counts(14.0) == [("S1", 2, 1)]
    for day in (15.0, 0.0, None):
        with pytest.raises(Exception, match="event after the landmark.*S1"):
            counts(day)


def test_preparation_equals_numpy(spark, people):
    fitted = prep.fit_preparation(people)
    pdf = people.toPandas()
    for stats in fitted.numbers:
        column = pdf[stats.name].astype(float)
        filled = column.fillna(column.median())
        assert stats.median == column.median()
        assert stats.mean == pytest.approx(filled.mean(), rel=1e-12)
        assert stats.deviation == pytest.approx(filled.std(ddof=0), rel=1e-12)
    assert fitted.levels == {"SEX": ("F", "M"), "TRT01P": ("High", "Low", "Placebo")}
    assert fitted.class_counts == pdf[LABEL].value_counts().to_dict()


MEDIAN_CASES = [
    [5.0], [1.0, 2.0], [1.0, 2.0, 9.0], [1.0] * 900 + [2.0] * 900, [3.0] * 999 + [4.0] * 1000,
    [float(i) for i in range(20_001)], [float(i % 7) for i in range(20_000)],
    [math.exp(i % 1013 / 9) for i in range(700)], [0.0, -0.0, None],
    [1.0, 2.0, 3.0, None, float("nan"), float("nan"), float("nan")],
    [-1e300, 1e-300, 2e-300, 3e-300, 1e300], [0.1 + 1e-17 * i for i in range(99)],
    [math.nextafter(1.0, 2.0), 1.0, 1.0, math.nextafter(1.0, 2.0)],
    [-1.7e308, 1.0, 2.0, 5.0, 1.7e308], [-1.7e308, -1.0, 3.0, 1.7e308], [0.0, 5e-324, 1e-323],
]


def test_infinite_values_are_refused(spark, people):
    endless = people.withColumn("BMIBL", F.when(F.col("SEX") == "F", F.lit(float("inf"))).otherwise(F.col("BMIBL")))
    with pytest.raises(ValueError, match="BMIBL holds an infinite value"):
        prep.fit_preparation(endless)


def test_medians_are_exact(spark):
    rows = [(f"S{i}", "701", v, "F", 1.0, 1.0, 1.0, 1.0, "A", case, 0, i % 2)
            for case, values in enumerate(MEDIAN_CASES) for i, v in enumerate(values)]
    learning = spark.createDataFrame(rows, SCHEMA).select(
        F.col("early_ae_count").alias("cell"), F.expr(prep.present_sql("AGE")).alias("AGE")
    )
    told = prep._cell_statistics(learning, ("AGE",))
    clean = [[v for v in values if v is not None and not math.isnan(v)] for values in MEDIAN_CASES]
    # Every case by itself, and every two neighbours merged.
    sets = {case: [case] for case in range(len(clean))}
    sets |= {100 + case: [case, case + 1] for case in range(len(clean) - 1)}
    values = {s: sum((clean[case] for case in cases), []) for s, cases in sets.items()}
    got = prep._medians(learning, told, sets, {(s, "AGE"): len(v) for s, v in values.items()})
    for s, v in values.items():
        assert got[s, "AGE"] == statistics.median(v)


def test_medians_survive_wrong_brackets(spark, people, monkeypatch):
    want = prep.fit_preparation(people)
    monkeypatch.setattr(prep, "_brackets", lambda told, pairs, columns: {c: (0.0, 0.0) for c in columns})
    assert prep.fit_preparation(people) == want


def test_training_sets_are_merged_from_folds(spark, people):
    rows = cv_folds(people, n_repeats=2).persist()
    fitted = train._training_preparations(rows, 2)
    assert set(fitted) == {5, 6, 7, 8, 9, 10, 11, 12, 13, 14}
    for repeat, held in ((1, 0), (2, 3)):
        got = fitted[repeat * 5 + held]
        want = prep.fit_preparation(rows.filter((F.col("repeat") == repeat) & (F.col("fold") != held)))
        assert (got.levels, got.class_counts) == (want.levels, want.class_counts)
        for a, b in zip(got.numbers, want.numbers, strict=True):
            assert (a.name, a.median) == (b.name, b.median)
            assert (a.mean, a.deviation) == (pytest.approx(b.mean, rel=1e-12), pytest.approx(b.deviation, rel=1e-12))


def test_many_training_sets_at_once(spark, people):
    sets = people.withColumn("_set", F.explode(F.array(
        F.lit(7), F.when(F.col("SEX") == "F", 8).otherwise(9)
    )))
    fitted = prep.fit_preparations(sets, "_set")
    assert set(fitted) == {7, 8, 9}
    for key, part in ((7, people), (8, people.filter("SEX = 'F'")), (9, people.filter("SEX = 'M'"))):
        assert fitted[key] == prep.fit_preparation(part)
    assert fitted[8].levels["SEX"] == ("F",) and "SEX_M" not in fitted[8].design()


def test_constant_missing_and_unseen_values(spark):
    rows = [(f"S{i}", "701", 70.0, sex, None, float(i), 1.0, 1.0, arm, i, 0, i % 2)
            for i, (sex, arm) in enumerate([("F", "A.1"), ("M", "it's"), (None, "A.1"), ("F", "\\x")])]
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = prep.fit_preparation(df)
    # A column without any value has no median and is left out.
    assert [n.name for n in fitted.numbers] == [c for c in NUMERIC if c != "BMIBL"]
    assert fitted.levels["SEX"] == ("F", "M", None)
    new = df.withColumn("SEX", F.lit("X")).withColumn("TRT01P", F.lit("other"))
    design = new.select(*(F.expr(sql).alias(f"c{i}") for i, sql in enumerate(fitted.design().values())))
    first = design.first()
    assert first[0] == 0.0  # constant AGE: centred, not divided by zero
    assert list(first)[6:] == [0.0] * 4
    seen = df.select("SEX", "TRT01P", *(F.expr(s).alias(n.replace(".", "_")) for n, s in fitted.dummies().items()))
    assert sorted(tuple(r)[2:] for r in seen.collect()) == sorted(
        [(0.0, 0.0, 0.0, 0.0), (1.0, 0.0, 0.0, 1.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0)]
    )
    assert train.fit_final(df).score(new).count() == 4


def test_five_thousand_levels(spark, people):
    number = F.pmod(F.xxhash64("USUBJID", "copy"), F.lit(5_000))
    many = people.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(200)))).withColumn(
        "TRT01P", F.when(number > 0, F.format_string("arm %04d", number))
    ).withColumn("USUBJID", F.concat_ws("-", "USUBJID", "copy")).drop("copy")
    levels = many.select("TRT01P").distinct().count()
    assert levels > 4_900
    model = train.fit_final(many)
    assert len(model.names) == len(model.coefficients) == len(NUMERIC) + 1 + levels - 1
    assert model.names[-1] == "TRT01P_None"
    assert model.score(many).filter(F.col("risk").between(0, 1)).count() == many.count()


def newton(design, y, weights, penalty=1.0):
    x = np.column_stack([np.ones(len(y)), design])
    ridge = np.diag([0.0] + [1.0 / penalty] * design.shape[1])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (weights * (p - y)) + ridge @ beta
        hessian = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta


def test_logistic_fit_equals_newton(spark, people):
    fitted = prep.fit_preparation(people)
    model = train.fit_final(people)
    pdf = people.select(
        LABEL, *(F.expr(sql).alias(name) for name, sql in fitted.design().items())
    ).toPandas()
    y = pdf.pop(LABEL).to_numpy(float)
    weights = np.where(y == 1, fitted.class_weight(1), fitted.class_weight(0))
    beta = newton(pdf.to_numpy(), y, weights)
    np.testing.assert_allclose(model.coefficients, beta[1:], atol=1e-5)
    assert model.names == tuple(pdf.columns)
    risks = model.score(people).toPandas()["risk"]
    assert risks.between(0, 1).all() and risks.nunique() > 100


def test_a_fit_that_does_not_settle_is_refused(spark, people, monkeypatch):
    with pytest.raises(RuntimeError, match="did not settle in 2 steps"):
        train.fit_final(people, train.Settings(max_iter=2))
    monkeypatch.setattr(train, "FLAT", 1e-14)
    with pytest.raises(RuntimeError, match="stopped at a slope"):
        train.fit_final(people)


def test_odds_ratios_are_named_and_sorted(spark, people):
    ratios = explain.odds_ratios(train.fit_final(people)).collect()
    assert {r["feature"] for r in ratios} == {
        *explain.LABELS.values(), "Sex: M", "Arm: Low", "Arm: Placebo"
    }
    values = [r["odds_ratio"] for r in ratios]
    assert values == sorted(values, reverse=True)
    assert all(r["odds_ratio"] == pytest.approx(math.exp(r["coef"])) for r in ratios)
    shown = frames.odds_ratio_direction(explain.odds_ratios(train.fit_final(people))).collect()
    assert all((r["direction"] == "Raises risk") == (r["odds_ratio"] > 1) for r in shown)


def test_model_is_saved_with_its_preparation(spark, people, tmp_path):
    model = train.fit_final(people)
    model.save(str(tmp_path / "m"))
    again = train.RiskModel.load(str(tmp_path / "m"))
    assert again.names == model.names and again.coefficients == model.coefficients
    want = {r["USUBJID"]: r["risk"] for r in model.score(people).collect()}
    assert {r["USUBJID"]: r["risk"] for r in again.score(people).collect()} == want


def test_one_class_cannot_be_learned(spark, people):
    with pytest.raises(ValueError, match="one class"):
        train.fit_final(people.filter(f"{LABEL} = 1"))


def test_folds_are_balanced_and_complete(spark, people):
    rows = cv_folds(people, n_repeats=3).select("USUBJID", "repeat", "fold", LABEL).collect()
    assert len(rows) == 3 * 400 == len({(r["USUBJID"], r["repeat"]) for r in rows})
    sizes = {}
    for r in rows:
        key = (r["repeat"], r[LABEL])
        sizes.setdefault(key, [0] * 5)[r["fold"]] += 1
    assert all(max(s) - min(s) <= 1 for s in sizes.values())
    by_repeat = [{r["USUBJID"]: r["fold"] for r in rows if r["repeat"] == k} for k in (1, 2)]
    assert by_repeat[0] != by_repeat[1]
    again = cv_folds(people.repartition(7), n_repeats=3)
    assert {tuple(r) for r in again.select("USUBJID", "repeat", "fold", LABEL).collect()} == {
        tuple(r) for r in rows
    }


def brute_auc(pairs):
    pos, neg = ([s for s, y in pairs if y == v] for v in (1, 0))
    wins = sum((p > n) + (p == n) / 2 for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("digits", [1, 2, 9])
def test_auc_equals_brute_force_and_evaluator(spark, digits):
    rng = random.Random(digits)
    pairs = [(round(rng.random(), digits), rng.randint(0, 1)) for _ in range(3000)]
    df = spark.createDataFrame(pairs, "s double, y int")
    got = metrics.roc_auc(df, "s", "y").first()[0]
    assert got == pytest.approx(brute_auc(pairs), abs=1e-12)
    raw = df.withColumn("raw", array_to_vector(F.array(-F.col("s"), F.col("s"))))
    evaluator = BinaryClassificationEvaluator(rawPredictionCol="raw", labelCol="y", numBins=0)
    assert got == pytest.approx(evaluator.evaluate(raw), abs=1e-9)


def test_auc_on_a_heap_of_close_scores(spark):
    """Most scores in one narrow stretch: pieces follow the scores, not their range."""
    rng = random.Random(1)
    pairs = [(0.5 + rng.random() * 1e-9, rng.randint(0, 1)) for _ in range(2000)]
    pairs += [(rng.random(), rng.randint(0, 1)) for _ in range(50)] + [(0.5, 1)] * 900
    df = spark.createDataFrame(pairs, "s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_scores_by_group(spark):
    rng = random.Random(5)
    groups = {g: [(rng.random(), rng.randint(0, 1)) for _ in range(200)] for g in "abc"}
    groups["one class"] = [(0.1, 1), (0.9, 1)]
    df = spark.createDataFrame(
        [(g, *p) for g, pairs in groups.items() for p in pairs], "g string, s double, y int"
    )
    got = {(r["g"], r["metric"]): r["value"] for r in metrics.fold_scores(df, "s", "y", ["g"]).collect()}
    for g in "abc":
        pairs = groups[g]
        recalls = [sum((s > 0.5) == y for s, y in pairs if y == v) / sum(y == v for _, y in pairs)
                   for v in (0, 1)]
        assert got[g, "ROC-AUC"] == pytest.approx(brute_auc(pairs), abs=1e-12)
        assert got[g, "Balanced accuracy"] == pytest.approx(sum(recalls) / 2)
    assert got["one class", "ROC-AUC"] is None
    assert got["one class", "Balanced accuracy"] == 0.5


def test_cross_validation_finds_a_planted_effect(spark):
    strong = subjects(spark, 300, seed=3, effect=2.0)
    results = train.evaluate(strong, n_repeats=1, settings=train.Settings(n_trees=10))
    by_key = {(r["model"], r["metric"]): r for r in results.collect()}
    assert set(by_key) == {(m, s) for m in (train.LOGISTIC, train.FOREST) for s in train.METRICS}
    assert by_key[train.LOGISTIC, "ROC-AUC"]["mean"] > 0.75
    assert by_key[train.FOREST, "ROC-AUC"]["mean"] > 0.65
    assert all(0 <= r["sd"] < 0.2 for r in by_key.values())
    assert train.quoted_score(results).count() == 1


def test_cross_validation_starts_from_written_models(spark, tmp_path, monkeypatch):
    strong = subjects(spark, 200, seed=4, effect=2.0)
    settings = train.Settings(n_trees=3, forest_rows=90)
    first = train.evaluate(strong, 1, settings, models=str(tmp_path)).collect()

    def refuse(*args):
        raise AssertionError("fitted again")

    monkeypatch.setattr(train, "fit_model", refuse)
    assert train.evaluate(strong, 1, settings, models=str(tmp_path)).collect() == first


def test_samples_do_not_depend_on_partitions(spark, people):
    many = people.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(9)))).withColumn(
        "USUBJID", F.concat_ws("-", "USUBJID", "copy")
    )

    def drawn(df, rows):
        got = stratified_sample(df, rows).select("USUBJID", LABEL).collect()
        return {r["USUBJID"]: r[LABEL] for r in got}

    want = drawn(many, 500)
    assert drawn(many.repartition(7), 500) == drawn(many.coalesce(1), 500) == want
    share = many.agg(F.avg(LABEL)).first()[0]
    assert abs(len(want) - 500) <= 1 and abs(sum(want.values()) - 500 * share) <= 1
    ranked = sorted(
        (hashlib.md5(f"42:{r['USUBJID']}".encode()).hexdigest(), r["USUBJID"])
        for r in many.filter(f"{LABEL} = 1").collect()
    )
    ones = {i for i, y in want.items() if y == 1}
    assert ones == {i for _, i in ranked[: len(ones)]}
    assert drawn(many, 100).items() <= want.items()
    assert drawn(many, 10**6).keys() == {r["USUBJID"] for r in many.collect()}
    assert drawn(many.limit(0), 5) == {}
    # A third of all rows under one id and class.
    hot = many.unionAll(many.limit(1200).withColumn("USUBJID", F.lit("HOT")).withColumn(LABEL, F.lit(1).cast("bigint")))
    assert drawn(hot, 300) == drawn(hot.repartition(5), 300)


def test_a_sample_needs_no_sort_of_all_rows(people, capsys):
    stratified_sample(people, 50).explain()
    text = capsys.readouterr().out
    assert "Broadcast" in text and "RangePartitioning" not in text
    # Rows are shuffled for the last piece only; all others join a row per class.
    assert "SortMergeJoin" not in text


def test_a_forest_is_fit_on_the_rows_it_may_have(spark, people, monkeypatch):
    seen = []
    monkeypatch.setattr(train, "stratified_sample", lambda df, rows, seed: seen.append(rows) or stratified_sample(df, rows, seed))
    fitted = prep.fit_preparation(people)
    model = train.fit_model(train.FOREST, people, fitted, train.Settings(n_trees=2, forest_rows=60))
    assert seen == [60] and model.score(people).filter("risk BETWEEN 0 AND 1").count() == 400
    train.fit_model(train.LOGISTIC, people, fitted, train.Settings(forest_rows=60))
    assert seen == [60]


def test_jobs_write_their_results(spark, small, tmp_path):
    data, out = str(tmp_path / "data"), str(tmp_path / "out")
    loaded = jobs.load_domains(bind(spark, small), data)
    jobs.run_views(loaded, out)
    assert spark.read.parquet(f"{out}/site_view").count() == 25
    summary = jobs.run_edit_checks(loaded, out, ["AE01"]).collect()
    listing = spark.read.parquet(f"{out}/listing")
    assert sum(r["issues"] for r in summary) == listing.count()
    csv = spark.read.option("header", True).option("escape", '"').csv(f"{out}/listing_csv")
    assert csv.columns == listing.columns
    assert csv.exceptAll(listing.filter("check_id = 'AE01'")).count() == 0
    kpis, cv, ratios = jobs.run_model(loaded, out, 1, train.Settings(n_trees=5))
    assert kpis.first()["subjects"] == spark.read.parquet(f"{out}/risks").count()
    assert cv.count() == 4 and ratios.count() == 10


def test_named_domains_stay_unbucketed(spark, small):
    d = {**bind(spark, small)}
    hot = d["ex"].withColumn("USUBJID", F.when(F.rand(1) < 0.33, "HOT").otherwise(F.col("USUBJID")))
    d["ex"] = hot
    tables = jobs.load_domain_tables(d, "sitewatch_test", 8, plain=["ex"])
    described = {
        name: spark.sql(f"DESCRIBE EXTENDED sitewatch_test.{name}")
        .filter("col_name = 'Num Buckets'").count()
        for name in ("dm", "ex")
    }
    assert described == {"dm": 1, "ex": 0}
