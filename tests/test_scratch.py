"""Written intermediates: who owns them, and when they go."""

import os

import pytest

from sitewatch.session import result_only, saved, scratch, set_for_scope, shared_folder


def folders(scope):
    return [folder for _, folder in scope.folders]


def test_a_scope_removes_what_was_written_in_it(spark):
    with scratch() as outer:
        with scratch() as inner:
            df = saved(spark.range(5))
            [folder] = folders(inner)
            assert os.path.isdir(folder) and df.count() == 5
        assert not os.path.exists(folder) and not folders(outer)


def test_settings_are_taken_back(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with scratch():
        set_for_scope(spark, {key: "77"})
        with scratch():
            set_for_scope(spark, {key: "78"})
        assert spark.conf.get(key) == "77"
    assert spark.conf.get(key) == before


def test_a_failed_job_leaves_nothing(spark):
    with pytest.raises(ValueError), scratch() as scope:
        saved(spark.range(5))
        [folder] = folders(scope)
        raise ValueError
    assert not os.path.exists(folder)


def test_only_the_result_outlives_its_steps(spark):
    seen = []

    @result_only
    def build():
        first = shared_folder(spark)
        spark.range(7).write.parquet(first)
        seen.append(first)
        return spark.read.parquet(first).selectExpr("id * 2 AS twice")

    with scratch() as scope:
        got = build()
        assert not os.path.exists(seen[0])
        [kept] = folders(scope)
        assert sorted(r.twice for r in got.collect()) == [0, 2, 4, 6, 8, 10, 12]
    assert not os.path.exists(kept)
