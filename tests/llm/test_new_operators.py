"""Clustering, Merkle manifest and top-k search against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from sitewatch.llm import clustering, merkle, topk
from sitewatch.llm.queries import QUERIES
from sitewatch.session import scratch
from tests.llm import brute

VECTORS = "vec_id long, embedding array<float>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def leave_nothing():
    with scratch():
        yield


def written(df, folder, name):
    df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def random_vectors(n, seed, size=64):
    draw = np.random.default_rng(seed)
    return [(i, [float(x) for x in draw.normal(0, 0.2, size).astype(np.float32)], 0) for i in range(n)]


ODD_VECTORS = [
    *random_vectors(40, 1),
    *random_vectors(3, 1),  # repeated rows
    (0, random_vectors(1, 9)[0][1], 0),  # another row with the id of a query
    (None, random_vectors(1, 2)[0][1], None),
    (None, random_vectors(1, 1)[0][1], None),
    (100, None, 0),
    (200, [], 0),
    (201, [0.5] * 63, 0),
    (300, [None] + [0.5] * 63, 0),
    (400, [math.nan] + [0.5] * 63, 0),
    (500, [math.inf] + [0.5] * 63, 0),
    (600, [0.0] * 64, 0),
    (700, [0.5] * 65, 0),
    *[(800 + k, [0.25] * 64, 0) for k in range(30)],  # ties
]


@pytest.fixture(scope="module")
def vector_folder(spark, tmp_path_factory):
    df = spark.createDataFrame(ODD_VECTORS, VECTORS).repartition(3)
    return written(df, tmp_path_factory.mktemp("vectors"), "embeddings")


@pytest.fixture(scope="module")
def no_vectors(spark, tmp_path_factory):
    return written(spark.createDataFrame([], VECTORS), tmp_path_factory.mktemp("none"), "embeddings")


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


# --- Clustering ---


def test_clusters_of_a_whole_table(spark, medium):
    rows = pairs(spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding").collect())
    assert counted(QUERIES["op11_centroid_clustering"](spark, medium)) == brute.clustered(rows)


def test_clusters_of_odd_rows(spark, vector_folder, no_vectors):
    got = counted(QUERIES["op11_centroid_clustering"](spark, vector_folder))
    assert got == brute.clustered(pairs(ODD_VECTORS))
    assert QUERIES["op11_centroid_clustering"](spark, no_vectors).count() == 0


def test_fewer_vectors_than_centroids_and_clashing_columns(spark):
    rows = random_vectors(3, 4)
    df = spark.createDataFrame(
        [(i, v, "x", 9, b"") for i, v, _ in rows], "vec_id long, embedding array<double>, key string, cluster int, coefs binary"
    )
    found, centroids = clustering.cluster(df)
    assert sorted(r["distance"] for r in found.collect()) == [0, 0, 0] and len(centroids) == 3


def test_large_components_are_exact(spark):
    rows = [*random_vectors(20, 5), (20, [3.0e5] * 64, 0), (21, [1e30] * 64, 0), (22, [-3.4e38] * 64, 0)]
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    found, centroids = clustering.cluster(df)
    got = {r["key"]: (r["cluster"], r["distance"]) for r in found.collect()}
    stored = pairs(spark.createDataFrame(rows, VECTORS).collect())
    want = {i: (c, d if d < 2**63 else None) for i, c, d, *_ in brute.clustered(stored)}
    assert got == want
    assert sum(c["inertia"] for c in centroids) == next(iter(brute.clustered(stored)))[4]


def test_transform_is_exact_and_orders_by_sign_changes():
    draw = np.random.default_rng(3)
    x = draw.integers(-5000, 5000, (50, 64))
    y = clustering.transform(x)
    assert (clustering.untransform(y) == x).all()
    assert ((y**2).sum(axis=1) == 64 * (x**2).sum(axis=1)).all()
    assert (y[:, 0] == x.sum(axis=1)).all() and (y[:, 1] == x[:, :32].sum(axis=1) - x[:, 32:].sum(axis=1)).all()


def test_search_drops_centroids_but_never_the_nearest():
    draw = np.random.default_rng(4)
    x, c = draw.integers(-9, 9, (300, 64)), draw.integers(-9, 9, (12, 64))
    c[7] = c[2]
    best, distance = clustering.nearest(clustering.transform(x), clustering.transform(c))
    every = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert 7 not in best


# --- Top-k search ---


def test_search_of_a_whole_table(spark, medium):
    rows = pairs(spark.read.parquet(f"{medium}/embeddings.parquet").select("vec_id", "embedding").collect())
    assert counted(QUERIES["op13_exact_topk"](spark, medium)) == brute.searched(rows)


def test_search_of_odd_rows(spark, vector_folder, no_vectors):
    got = QUERIES["op13_exact_topk"](spark, vector_folder)
    want = brute.searched(pairs(ODD_VECTORS))
    assert counted(got) == want
    assert QUERIES["op13_exact_topk"](spark, no_vectors).count() == 0


def test_search_in_many_blocks_and_batches(spark):
    rows = random_vectors(2_500, 6, size=7)
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    # Three queries a block.
    got = topk.top_k(df, df["vec_id"] % 100 == 0, block_bytes=3 * 7 * 8)
    assert counted(got.select("query_id", "rank", "vec_id", "score")) == brute.searched(pairs(rows))


def test_search_ranks_scores_beyond_64_bits(spark):
    rows = [(i, [s * 10.0**e, 1.0], 0) for i, (s, e) in enumerate([(1, 30), (1, 9), (-1, 30), (1, 20), (-1, 38), (0, 0)])]
    stored = pairs(spark.createDataFrame(rows, VECTORS).collect())
    df = spark.createDataFrame(rows, VECTORS).repartition(2)
    got = topk.top_k(df, df["vec_id"] % 100 == 0).orderBy("rank").collect()
    want = sorted(brute.searched(stored), key=lambda r: r[1])
    assert [r["vec_id"] for r in got] == [r[2] for r in want]
    assert [r["score"] for r in got] == [s if -(2**63) <= s < 2**63 else None for *_, s in want]


def test_fewer_candidates_than_asked_for(spark):
    df = spark.createDataFrame(random_vectors(2, 7), VECTORS)
    got = topk.top_k(df, df["vec_id"] == 0).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1)]


# --- Merkle manifest ---

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def test_manifest_of_a_whole_table(spark, medium):
    rows = [tuple(r) for r in spark.read.parquet(f"{medium}/documents.parquet").select(*COLUMNS).collect()]
    got = counted(QUERIES["op12_merkle_manifest"](spark, medium))
    assert got == brute.manifest(rows)
    assert any(not r[-1] for r in got)


def odd_docs(copies):
    draw = random.Random(3)
    rows = [(k, f"text {k} é", draw.choice(["en", "de", None, "é", ""]), draw.choice(["a", None]), k) for k in range(150)]
    rows += [(None, None, None, None, None), (None, "x", "en", "a", 3), (None, "x", "en", "a", 3), (7, "other", "en", "a", 1)]
    rows += [(5, "y" * 200_000, "zz", "", 2**63 - 1), (-4, "", "en", "", None)]
    return rows + [(11, "copy", "en", "b", 4)] * copies


def test_manifest_of_odd_rows(spark, tmp_path):
    rows = odd_docs(700)
    draw = random.Random(5)
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS tree", "'x' AS digest", "2 AS size", "3 AS row").repartition(3)
    assert counted(QUERIES["op12_merkle_manifest"](spark, written(df, tmp_path, "documents"))) == brute.manifest(rows)


def test_manifest_of_trees_around_the_size_of_a_record(spark, tmp_path):
    rows = [(k, f"t{k}", f"lang {n}", "a", k) for n in (1, 2, 3, 63, 64, 65, 129) for k in range(n)]
    folder = written(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    assert counted(QUERIES["op12_merkle_manifest"](spark, folder)) == brute.manifest(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_manifest_of_next_to_nothing(spark, tmp_path, n):
    rows = [(k, f"t{k}", "en", "a", k) for k in range(n)]
    folder = written(spark.createDataFrame(rows, DOCS), tmp_path, "documents")
    assert counted(QUERIES["op12_merkle_manifest"](spark, folder)) == brute.manifest(rows)


def test_equal_records_are_stored_once_a_shelf(spark):
    rows = [("t", 2_000, k, "same", k) for k in range(2_000)]
    dag = merkle.build(spark.createDataFrame(rows, "tree string, size long, index long, digest string, payload long"))
    kept = dag.store[0].groupBy("digest", "shelf").count().collect()
    assert {r["count"] for r in kept} == {1} and len({r["digest"] for r in kept}) == 2
