"""Centroid clustering on exact integers, by progressive search in Walsh-Hadamard space.

Vectors become integers, and these their Walsh-Hadamard coefficients: sums and
differences only, so exact, and squared distances grow by the vector's length and
nothing else. Coefficients are ordered by the sign changes of their row, coarse to
fine, and written once. Each round is one pass over them: per batch the coarse
coefficients of all centroids are compared, the distance to the likeliest centroid
is finished, and the others add up squared differences block by block until they
are strictly worse or all coefficients are in. The transform is linear, so the sums
that the next centroids need are sums of coefficients.

A task hands on one row per centroid, with exact sums as decimal text; these are
folded by Spark to a fixed number of rows, whatever the number of tasks, before the
driver divides them. Nothing else reaches the driver.

Defined cases: a vector that is NULL, of another length or with a NULL or non-finite
component is left out. NULL ids take part; they are drawn as starting centroids only
after all others. Repeated rows count each time, and may give equal centroids, of
which the smaller number takes all. With fewer vectors than centroids asked for there
are as many centroids as vectors. Ties of the draw go by the vectors'
stored coefficients. An
empty table gives an empty table. Components too large for 64-bit sums are computed
with Python's integers; a distance or inertia beyond 64 bits is then NULL. Columns
other than the key and the vector are not read; names may clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import bounded_batches, table
from sitewatch.llm.vectors import is_finite, narrow, whole
from sitewatch.session import result_only, saved

CENTROIDS = 8
ROUNDS = 10
SIZE = 64
SCALE = 1024
#: Partial sums of one centroid are folded into this many rows before the driver's.
FOLDS = 64
LARGEST = 2**63 - 1

#: ``coefs`` holds 32-bit coefficients; ``wide`` has them as text where one is larger.
STORED_DDL = "key long, coefs binary, wide string"
STORED = pa.schema([("key", pa.int64()), ("coefs", pa.binary()), ("wide", pa.string())])
PARTIAL_DDL = "fold int, cluster int, n string, sums array<string>, inertia string"
PARTIAL = pa.schema(
    [
        ("fold", pa.int32()),
        ("cluster", pa.int32()),
        ("n", pa.string()),
        ("sums", pa.list_(pa.string())),
        ("inertia", pa.string()),
    ]
)
FOUND_DDL = "key long, cluster int, distance long"
FOUND = pa.schema([("key", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])


@lru_cache(maxsize=8)
def coarse_first(size: int) -> np.ndarray:
    """Places of the transform's rows by their number of sign changes."""
    rows = np.array([[1]])
    while len(rows) < size:
        rows = np.kron(np.array([[1, 1], [1, -1]]), rows)
    if len(rows) != size:
        raise ValueError("the number of components must be a power of two")
    return np.argsort((np.diff(rows, axis=1) != 0).sum(axis=1), kind="stable")


def transform(integers: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of each row, coarse to fine."""
    n, size = integers.shape
    out, half = integers, 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        out = np.stack([a + b, a - b], axis=2).reshape(n, size)
        half *= 2
    return out[:, coarse_first(size)]


def untransform(coefs: np.ndarray) -> np.ndarray:
    """The integers of each row: the transform undoes itself but for a factor."""
    size = coefs.shape[1]
    back = np.empty_like(coefs)
    back[:, coarse_first(size)] = coefs
    natural = transform(back)
    out = np.empty_like(natural)
    out[:, coarse_first(size)] = natural
    return out // size


def levels(size: int) -> list[tuple[int, int]]:
    """Consecutive blocks of coefficients, each as long as all before it."""
    cuts = [0]
    cuts += [2**k for k in range(size.bit_length())]
    return list(zip(cuts, cuts[1:]))


def nearest(coefs: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the nearest centroid (ties: smaller number) and the squared distance."""
    n, size = coefs.shape
    blocks = levels(size)
    coarse = max(1, size // 16)
    seen = ((coefs[:, None, :coarse] - centroids[None, :, :coarse]) ** 2).sum(axis=2)
    likeliest = seen.argmin(axis=1)
    bound = ((coefs - centroids[likeliest]) ** 2).sum(axis=1)
    rows, cols = np.nonzero((seen <= bound[:, None]).astype(bool))
    sums = seen[rows, cols]
    for begin, end in blocks:
        if begin < coarse:
            continue
        sums = sums + ((coefs[rows, begin:end] - centroids[cols, begin:end]) ** 2).sum(axis=1)
        alive = (sums <= bound[rows]).astype(bool)
        rows, cols, sums = rows[alive], cols[alive], sums[alive]
    # Survivors have all coefficients in; the first minimum is the smallest number.
    finished = np.repeat((bound + 1)[:, None], len(centroids), axis=1)
    finished[rows, cols] = sums
    best = finished.argmin(axis=1)
    return best, finished[np.arange(n), best] // size


def _as_text(integers) -> str:
    return ",".join(map(str, integers))


def _from_text(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def store(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """Rows of ``STORED``: the coefficients of every vector that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            integers = whole(flat, scale).reshape(-1, size)
            small = (np.abs(integers) <= 2**24).astype(bool).all(axis=1)
            coefs: list[bytes | None] = [None] * len(integers)
            wide: list[str | None] = [None] * len(integers)
            for place, row in zip(np.flatnonzero(small), transform(integers[small].astype(np.int64)).astype("<i4")):
                coefs[place] = row.tobytes()
            if not small.all():
                for place, row in zip(np.flatnonzero(~small), transform(integers[~small])):
                    wide[place] = _as_text(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(coefs, pa.binary()), pa.array(wide, pa.string())], schema=STORED
            )

    kept = vectors.select(
        F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")
    ).filter((F.size("vector") == size) & is_finite("vector"))
    return bounded_batches(kept).mapInArrow(run, STORED_DDL)


def _parts(batch: pa.RecordBatch, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's coefficients with their places, small ones apart from large ones."""
    wide = batch.column(2).to_pylist()
    large = np.array([w is not None for w in wide], dtype=bool)
    if not large.all():
        places = np.flatnonzero(~large)
        blob = b"".join(b for b in batch.column(1).to_pylist() if b is not None)
        coefs = np.frombuffer(blob, dtype="<i4").reshape(len(places), -1).astype(np.int64)
        # Centroids that one large vector drew away need Python's integers, too.
        yield places, coefs if narrow(centroids) else coefs.astype(object), centroids
    if large.any():
        places = np.flatnonzero(large)
        coefs = np.array([_from_text(wide[p]) for p in places], dtype=object)
        yield places, coefs, centroids.astype(object)


def _totals(stored: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, np.ndarray, int]]:
    """Per non-empty cluster: its vectors, their coefficients' sums, its inertia."""
    count, size = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * count
        sums = np.zeros((count, size), dtype=object)
        inertia = [0] * count
        for batch in batches:
            for _, coefs, known in _parts(batch, centroids):
                best, distance = nearest(coefs, known)
                for c in np.unique(best).tolist():
                    mine = best == c
                    n[c] += int(mine.sum())
                    sums[c] += coefs[mine].sum(axis=0).astype(object)
                    inertia[c] += int(distance[mine].astype(object).sum())
        fold = TaskContext.get().partitionId() % FOLDS
        rows = [(fold, c, str(n[c]), [str(x) for x in sums[c]], str(inertia[c])) for c in range(count) if n[c]]
        if rows:
            yield pa.RecordBatch.from_pylist([dict(zip(PARTIAL.names, row)) for row in rows], schema=PARTIAL)

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, inertia, sums = 0, 0, np.zeros(size, dtype=object)
        for batch in batches:
            for row in batch.to_pylist():
                n += int(row["n"])
                inertia += int(row["inertia"])
                sums = sums + np.array([int(x) for x in row["sums"]], dtype=object)
        folded = {"fold": key[0].as_py(), "cluster": key[1].as_py(), "n": str(n), "inertia": str(inertia)}
        folded["sums"] = [str(x) for x in sums]
        yield pa.RecordBatch.from_pylist([folded], schema=PARTIAL)

    folded = (
        bounded_batches(stored)
        .mapInArrow(partial, PARTIAL_DDL)
        .groupBy("fold", "cluster")
        .applyInArrow(fold, PARTIAL_DDL)
    )
    out: dict[int, tuple[int, np.ndarray, int]] = {}
    for row in folded.collect():  # at most FOLDS rows per centroid
        n, sums, inertia = out.get(row["cluster"], (0, np.zeros(size, dtype=object), 0))
        more = np.array([int(x) for x in row["sums"]], dtype=object)
        out[row["cluster"]] = (n + int(row["n"]), sums + more, inertia + int(row["inertia"]))
    return out


def _narrowed(integers: np.ndarray) -> np.ndarray:
    """64-bit coefficients of the centroids where all their integers are small."""
    small = bool((np.abs(integers) <= 2**24).all()) if len(integers) else True
    return transform(integers.astype(np.int64) if small else integers)


def first_centroids(stored: DataFrame, count: int, salt: str, size: int) -> np.ndarray:
    """The integers of the ``count`` vectors with the smallest hashes of ``salt:key``."""
    text = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("key").cast("string")), 256)
    drawn = (
        stored.select(text.alias("hash"), "coefs", "wide")
        .orderBy(F.asc_nulls_last("hash"), "coefs", "wide")
        .limit(count)
        .collect()
    )
    coefs = [
        _from_text(r["wide"]) if r["wide"] is not None else np.frombuffer(bytes(r["coefs"]), dtype="<i4").tolist()
        for r in drawn
    ]
    return untransform(np.array(coefs, dtype=object).reshape(-1, size))


def cluster(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    count: int = CENTROIDS,
    rounds: int = ROUNDS,
    salt: str = "3",
    size: int = SIZE,
    scale: int = SCALE,
) -> tuple[DataFrame, list[dict]]:
    """Rows (key, cluster, distance) of every kept vector, and the final centroids.

    A centroid is {number, vectors, inertia, components}.
    """
    stored = saved(store(vectors, key, vector, size, scale))
    integers = first_centroids(stored, count, salt, size)
    if not len(integers):
        return stored.sparkSession.createDataFrame([], FOUND_DDL), []
    for _ in range(rounds):
        for c, (n, sums, _) in _totals(stored, _narrowed(integers)).items():
            integers[c] = [x // n for x in untransform(sums.reshape(1, -1))[0]]
    coefs = _narrowed(integers)
    totals = _totals(stored, coefs)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters = np.zeros(batch.num_rows, dtype=np.int32)
            distances: list[int | None] = [None] * batch.num_rows
            for places, mine, known in _parts(batch, coefs):
                best, distance = nearest(mine, known)
                clusters[places] = best
                for place, d in zip(places.tolist(), distance.tolist()):
                    distances[place] = d if d <= LARGEST else None
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(clusters), pa.array(distances, pa.int64())], schema=FOUND
            )

    found = bounded_batches(stored).mapInArrow(assign, FOUND_DDL)
    centroids = [
        {"number": c, "vectors": totals.get(c, (0,))[0], "inertia": totals.get(c, (0, 0, 0))[2], "components": [int(x) for x in row]}
        for c, row in enumerate(integers)
    ]
    return found, centroids


def _or_null(value: int) -> int | None:
    return value if value <= LARGEST else None


@result_only
def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    everything = _or_null(sum(c["inertia"] for c in centroids))
    # One row per centroid.
    told = spark.createDataFrame(
        [
            (c["number"], _or_null(c["inertia"]), everything, hashlib.sha256(_as_text(c["components"]).encode()).hexdigest())
            for c in centroids
        ],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return found.join(F.broadcast(told), "cluster").select(
        F.col("key").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
