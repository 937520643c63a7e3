"""Fits of all training sets at once: the same as one after the other, in few jobs."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewatch.risk import forest, prep, together, train
from sitewatch.risk.features import LABEL
from sitewatch.risk.folds import N_SPLITS, cv_folds
from tests.test_risk import newton, subjects


def test_thresholds_are_midpoints_or_even_shares():
    assert forest.thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 64).tolist() == [1.5, 2.5]
    assert forest.thresholds(np.array([7.0, 7.0]), 64).tolist() == []
    near = np.array([1.0, np.nextafter(1.0, 2.0)])
    assert forest.thresholds(near, 64).tolist() == [1.0]
    values = np.random.default_rng(1).normal(size=10_000)
    cuts = forest.thresholds(values, 64)
    shares = np.diff(np.r_[0, np.searchsorted(np.sort(values), cuts), len(values)])
    assert len(cuts) == 63 and shares.min() >= 155 and shares.max() <= 158
    # Half of all rows have one value, which no threshold can cut.
    heavy = forest.thresholds(np.r_[values, np.zeros(10_000)], 8)
    assert len(heavy) < 8 and (np.diff(heavy) > 0).all()


def gini(counts, weights):
    a, b = counts[0] * weights[0], counts[1] * weights[1]
    return 2 * a * b / (a + b) if a + b else 0.0


def brute_tree(bins, y, times, weights, min_leaf, depth):
    """A tree on all columns, as nested pairs; a leaf is its share of class 1 and its class."""
    counts = np.array([times[y == 0].sum(), times[y == 1].sum()])
    share = counts[1] * weights[1] / (counts[0] * weights[0] + counts[1] * weights[1])
    leaf = (share, counts[1] * weights[1] > counts[0] * weights[0])
    best, least = None, gini(counts, weights) * (1 - 1e-12)
    for f in range(bins.shape[1]) if depth else ():
        for cut in np.unique(bins[:, f])[:-1]:
            left = bins[:, f] <= cut
            if min(times[left].sum(), times[~left].sum()) < min_leaf:
                continue
            sides = [np.array([times[s & (y == v)].sum() for v in (0, 1)]) for s in (left, ~left)]
            mixed = sum(gini(c, weights) for c in sides)
            if mixed < least:
                best, least = (f, cut), mixed
    if best is None:
        return leaf
    left = bins[:, best[0]] <= best[1]
    sides = [brute_tree(bins[s], y[s], times[s], weights, min_leaf, depth - 1) for s in (left, ~left)]
    if all(len(s) == 2 for s in sides) and sides[0][1] == sides[1][1]:
        return leaf
    return (*best, *sides)


def brute_risk(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]


@pytest.mark.parametrize("n, n_values, min_leaf, depth", [(60, 5, 1, 30), (300, 64, 5, 30), (300, 64, 5, 2), (40, 2, 3, 30), (900, 64, 2, 30)])
def test_trees_equal_brute_force(n, n_values, min_leaf, depth):
    rng = np.random.default_rng(n)
    # Two columns: each node draws both.
    bins = rng.integers(0, n_values, (n, 2)).astype(np.uint8)
    y = (rng.random(n) < 0.2 + 0.6 * (bins[:, 0] > n_values / 2)).astype(int)
    weights, by = (0.8, 1.3), forest.Grower(7, min_leaf, depth, 64, 42)
    got = forest.grow(bins, y, weights, by, range(7))
    want = np.zeros(n)
    for tree in range(7):
        times = forest.times_drawn(n, 42, tree)
        drawn = times > 0
        nested = brute_tree(bins[drawn], y[drawn], times[drawn], weights, min_leaf, depth)
        want += [brute_risk(nested, row) for row in bins]
    np.testing.assert_allclose(got.votes(bins), want, rtol=1e-9)


def test_trees_do_not_depend_on_their_company(monkeypatch):
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 30, (500, 9)).astype(np.uint8)
    y = (rng.random(500) < bins[:, 4] / 30).astype(int)
    by = forest.Grower(12, 5, 30, 64, 42)
    together_ = forest.grow(bins, y, (1.0, 1.0), by, range(12)).votes(bins)
    parts = [forest.grow(bins, y, (1.0, 1.0), by, range(a, a + 4)) for a in (0, 4, 8)]
    np.testing.assert_allclose(forest.joined(parts).votes(bins), together_, rtol=1e-12)
    np.testing.assert_allclose(sum(p.votes(bins) for p in parts), together_, rtol=1e-12)
    monkeypatch.setattr(forest, "TOGETHER", 1)
    np.testing.assert_allclose(forest.grow(bins, y, (1.0, 1.0), by, range(12)).votes(bins), together_, rtol=1e-12)
    # The columns drawn differ from node to node and tree to tree.
    roots = [forest.grow(bins, y, (1.0, 1.0), by, range(t, t + 1)).column[0] for t in range(12)]
    assert len(set(roots)) > 2


def test_rows_are_drawn_a_poisson_number_of_times():
    times = np.concatenate([forest.times_drawn(10_000, 42, tree) for tree in range(20)])
    shares = np.bincount(times, minlength=4)[:4] / len(times)
    np.testing.assert_allclose(shares, np.exp(-1) / np.array([1, 1, 2, 6]), atol=0.005)
    assert abs(times.mean() - 1) < 0.01 and abs(times.var() - 1) < 0.02
    # Of two rows a tree may draw none.
    tiny = forest.grow(np.array([[0], [1]], np.uint8), np.array([0, 1]), (1.0, 1.0), forest.Grower(200, 1, 30, 64, 42), range(200))
    assert tiny.n == 200 and ((tiny.share >= 0) & (tiny.share <= 1)).all() and (tiny.share[:200] == 0.5).sum() > 20
    none = forest.grow(np.zeros((1, 1), np.uint8), np.array([1]), (1.0, 1.0), forest.Grower(1, 1, 30, 64, 42), range(1, 2))
    assert none.votes(np.zeros((3, 1), np.uint8)).shape == (3,)


@pytest.fixture(scope="module")
def people(spark):
    df = subjects(spark, 300, seed=8, effect=1.5).persist()
    yield df
    df.unpersist()


def by_key(results):
    return {(r["model"], r["metric"]): (r["mean"], r["sd"]) for r in results.collect()}


def test_all_fits_at_once_equal_single_fits(spark, people, monkeypatch):
    # Missing and repeated ids and values, too.
    odd = people.withColumn("USUBJID", F.when(F.col("USUBJID") > "S2", F.col("USUBJID"))).unionAll(people.limit(40))
    odd = odd.withColumn("SEX", F.when(F.col("AGE") > 66, F.col("SEX")))
    settings = train.Settings(n_trees=9)
    rows = spark.createDataFrame(cv_folds(odd, 1).toArrow())
    monkeypatch.setattr(train, "cv_folds", lambda *_: rows)
    got = by_key(train.evaluate(odd, 1, settings))
    monkeypatch.setattr(train, "cv_folds", lambda *_: rows.repartition(5))
    monkeypatch.setattr(train, "_fit_together", lambda *_: False)
    want = by_key(train.evaluate(odd, 1, settings))
    assert set(got) == set(want) and len(got) == 4
    for key in got:
        assert got[key] == pytest.approx(want[key], abs=1e-9 if key[0] == train.FOREST else 1e-4)


def test_all_logistic_fits_equal_newton(spark, people):
    rows = cv_folds(people, 2).persist()
    preps = train._training_preparations(rows, 2)
    fits = together.logistic_fits(rows, preps, N_SPLITS, 1.0, 1000, train.FLAT)
    assert set(fits) == set(preps) == {*range(5, 15)}
    for s in (5, 13):
        mine = rows.filter((F.col("repeat") == s // 5) & (F.col("fold") != s % 5))
        pdf = mine.select(LABEL, *(F.expr(sql).alias(c) for c, sql in preps[s].design().items())).toPandas()
        y = pdf.pop(LABEL).to_numpy(float)
        weights = np.where(y == 1, preps[s].class_weight(1), preps[s].class_weight(0))
        np.testing.assert_allclose(fits[s], newton(pdf.to_numpy(), y, weights), atol=1e-8)
    with pytest.raises(RuntimeError, match="did not settle in 1 steps"):
        together.logistic_fits(rows, preps, N_SPLITS, 1.0, 1, train.FLAT)


def test_a_penalty_keeps_separable_classes_finite(spark, people):
    told = people.withColumn(LABEL, (F.col("AGE") > 75).cast("bigint"))
    rows = cv_folds(told, 1).persist()
    preps = train._training_preparations(rows, 1)
    fits = together.logistic_fits(rows, preps, N_SPLITS, 1e6, 1000, train.FLAT)
    assert all(np.isfinite(beta).all() for beta in fits.values())
    assert by_key(train.evaluate(told, 1, train.Settings(), (train.LOGISTIC,)))[train.LOGISTIC, "ROC-AUC"][0] > 0.99


def test_a_cross_validation_takes_few_jobs(spark, people):
    """Before, each of the fits took some dozens of jobs, and the whole query its time limit many times over."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "cross-validation")
    try:
        train.evaluate(people, 2, train.Settings(n_trees=6))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    assert 0 < len(jobs) < 120


def test_one_class_and_no_rows_raise(spark, people):
    with pytest.raises(ValueError, match="one class"):
        train.evaluate(people.filter(f"{LABEL} = 1"), 1, train.Settings(n_trees=2))
    with pytest.raises(KeyError):
        train.evaluate(people.limit(1), 1, train.Settings(n_trees=2))


def test_a_forest_is_saved_with_its_preparation(spark, people, tmp_path):
    fitted = prep.fit_preparation(people)
    model = train.fit_model(train.FOREST, people, fitted, train.Settings(n_trees=5))
    other = train.fit_model(train.FOREST, people.repartition(7), fitted, train.Settings(n_trees=5))
    assert all((a == b).all() for a, b in zip(model.trees.arrays(), other.trees.arrays()))
    other.save(str(tmp_path / "m"))
    again = train.load_model(spark, str(tmp_path / "m"))
    assert again.names == model.names == tuple(fitted.design()) and again.prep == model.prep
    new = people.withColumn("AGE", F.when(F.col("AGE") < 80, F.col("AGE"))).withColumn("TRT01P", F.lit("other"))
    for rows in (people, new):
        risks = {r["USUBJID"]: r["risk"] for r in model.score(rows).collect()}
        assert {r["USUBJID"]: r["risk"] for r in again.score(rows).collect()} == risks
        assert len(risks) == 300 and all(0 <= r <= 1 for r in risks.values())


def test_what_no_task_can_hold_is_left_to_spark(spark, people, monkeypatch):
    settings, fitted = train.Settings(n_trees=2), prep.fit_preparation(people)
    assert forest.fits(1000, 10, 64) and not forest.fits(1000, 10, 257) and not forest.fits(10**6, 11, 64)
    assert train._fit_together(train.FOREST, {0: fitted}, settings)
    assert not train._fit_together(train.FOREST, {0: fitted}, train.Settings(forest_rows=5))
    monkeypatch.setattr(forest, "TASK_CELLS", 300 * 9)
    assert not train._fit_together(train.FOREST, {0: fitted}, settings)
    model = train.fit_model(train.FOREST, people, fitted, settings)
    assert isinstance(model, train.RiskModel) and model.score(people).filter("risk BETWEEN 0 AND 1").count() == 300
