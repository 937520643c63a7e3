"""Exact top-k search by inner product, term at a time.

Components are terms. A task turns each batch of candidates into postings: per term
the candidates that have it, with their weights. A query is a sparse row of terms;
one term after the other scatters its weighted postings into the dense scores of a
tile of queries, so every candidate is scored by every term and nothing is skipped.
A partition selection then keeps the k best of the batch and of what came before,
and the lists of all tasks are merged per query.

Queries are a share of the rows, so they grow with the data: they are taken a block
at a time, of ``BLOCK_BYTES`` at most (a single longer vector is a block), and each
block is one pass over all candidates. No task or driver holds more than a block.

Defined cases: a vector that is NULL or has a NULL or non-finite component takes no
part. Vectors may differ in length: a component that one of two lacks counts as 0, so
an empty vector scores 0 with all. A query is a row, and so is its own row: of rows
that repeat a query's id each is a query of its own and a candidate of the others.
A NULL id is no query; as a candidate it loses ties to any id. Rows that tie in score
and id rank by their row number. Scores too large for 64-bit sums are ranked exactly,
with Python's integers, and given as NULL where they do not fit 64 bits. An empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewatch.llm.common import bounded_batches, table
from sitewatch.llm.vectors import is_finite, whole
from sitewatch.session import result_only, saved, shared_folder

BEST = 10
SCALE = 1024
QUERY_STEP = 100
#: A block of queries, as 64-bit integers.
BLOCK_BYTES = 8 * 2**20
#: Scores held at a time: queries of a tile times candidates of a batch.
TILE_SCORES = 2**18
CANDIDATES = 1_000
#: A score and all sums on the way to it are below this.
SAFE = 2**62
#: Beyond any id; stands for NULL.
NO_ID = 2**63 - 1

#: ``band`` and ``wide`` rank scores that do not fit 64 bits; 0 and NULL for others.
FOUND_DDL = "query_row long, band int, score long, wide string, no_id boolean, vec_id long, row long"
FOUND = pa.schema(
    [
        ("query_row", pa.int64()),
        ("band", pa.int32()),
        ("score", pa.int64()),
        ("wide", pa.string()),
        ("no_id", pa.bool_()),
        ("vec_id", pa.int64()),
        ("row", pa.int64()),
    ]
)
RANKED_DDL = "query_id long, rank int, vec_id long, score long, query_row long, row long"


class Sparse:
    """Vectors by term: per term the places that have it, and their weights there."""

    def __init__(self, vectors: pa.ListArray, scale: int):
        lengths = np.diff(vectors.offsets.to_numpy())
        flat = whole(vectors.flatten().to_numpy(zero_copy_only=False), scale)
        self.count = len(lengths)
        self.terms = int(lengths.max(initial=0))
        places = np.repeat(np.arange(self.count), lengths)
        term = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        there = (flat != 0).astype(bool)
        places, term, weights = places[there], term[there], flat[there]
        order = np.argsort(term, kind="stable")
        self.places, self.weights = places[order], weights[order]
        self.cuts = np.searchsorted(term[order], np.arange(self.terms + 1))
        self.largest = int(np.abs(weights).max(initial=0))

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        mine = slice(self.cuts[term], self.cuts[term + 1])
        return self.places[mine], self.weights[mine]


def scores(queries: Sparse, candidates: Sparse, first: int, last: int) -> np.ndarray:
    """Inner products of the queries ``first`` to ``last - 1`` with all candidates."""
    terms = min(queries.terms, candidates.terms)
    safe = queries.largest * candidates.largest * max(1, terms) < SAFE
    kind = np.int64 if safe else object
    out = np.zeros((last - first, candidates.count), dtype=kind)
    for term in range(terms):
        at, weights = queries.postings(term)
        mine = slice(*np.searchsorted(at, (first, last)))
        at, weights = at[mine] - first, weights[mine].astype(kind)
        posted, values = candidates.postings(term)
        if not len(at) or not len(posted):
            continue
        added = weights[:, None] * values.astype(kind)[None, :]
        if len(at) == last - first and len(posted) == candidates.count:
            out += added
        else:
            out[np.ix_(at, posted)] += added
    return out


class Best:
    """The k best candidates of each query so far: ties go to the smaller id, then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = [np.zeros(0, dtype=np.int64)] * queries
        self.ids = [np.zeros(0, dtype=np.int64)] * queries
        self.rows = [np.zeros(0, dtype=np.int64)] * queries

    def take(self, first: int, found: np.ndarray, ids: np.ndarray, rows: np.ndarray, own: np.ndarray) -> None:
        """Scores of some queries with a batch, whose ids and rows these are."""
        k = self.k
        for at in range(len(found)):
            q = first + at
            if found.shape[1] > k + 1:
                # One more than k, since the query's own row may be among them.
                if found.dtype == object:
                    edge = sorted(found[at].tolist())[-k - 1]
                else:
                    edge = np.partition(found[at], -k - 1)[-k - 1]
                near = np.flatnonzero((found[at] >= edge).astype(bool))
            else:
                near = np.arange(found.shape[1])
            near = near[rows[near] != own[q]]
            score = np.concatenate([self.score[q], found[at][near]])
            names = np.concatenate([self.ids[q], ids[near]])
            places = np.concatenate([self.rows[q], rows[near]])
            if score.dtype == object:
                order = np.array(
                    sorted(range(len(score)), key=lambda i: (-score[i], names[i], places[i])), dtype=np.int64
                )[:k]
            else:
                order = np.lexsort((places, names, -score))[:k]
            self.score[q], self.ids[q], self.rows[q] = score[order], names[order], places[order]


def _wide_key(score: int) -> str:
    """Text whose order is that of the numbers, for numbers of one sign."""
    digits = str(abs(score))
    if score >= 0:
        return f"{len(digits):06d}{digits}"
    return f"{10**6 - len(digits):06d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _row(query_row: int, score: int, vec_id: int, row: int) -> tuple:
    fits = -(2**63) <= score < 2**63
    band = 0 if fits else (1 if score > 0 else -1)
    no_id = vec_id == NO_ID
    return (query_row, band, score if fits else None, None if fits else _wide_key(score), no_id, None if no_id else vec_id, row)


def _scored(candidates: DataFrame, sent: Broadcast, k: int, scale: int) -> DataFrame:
    """Per task and query of the block that was sent, the k best candidates of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with pa.ipc.open_stream(pa.py_buffer(sent.value)) as stream:
            block = stream.read_all().combine_chunks()
        query_rows = block.column("row").to_numpy()
        queries = Sparse(block.column("vector").chunk(0), scale)
        best = Best(queries.count, k)
        for whole_batch in batches:
            for begin in range(0, whole_batch.num_rows, CANDIDATES):
                batch = whole_batch.slice(begin, CANDIDATES)
                terms = Sparse(batch.column(2), scale)
                ids = batch.column(1).fill_null(NO_ID).to_numpy(zero_copy_only=False)
                rows = batch.column(0).to_numpy()
                tile = max(1, TILE_SCORES // terms.count)
                for first in range(0, queries.count, tile):
                    last = min(first + tile, queries.count)
                    best.take(first, scores(queries, terms, first, last), ids, rows, query_rows)
        for begin in range(0, queries.count, CANDIDATES):
            found = [
                _row(int(query_rows[q]), int(s), int(i), int(r))
                for q in range(begin, min(begin + CANDIDATES, queries.count))
                for s, i, r in zip(best.score[q], best.ids[q], best.rows[q])
            ]
            if found:
                columns = [pa.array(c, f.type) for c, f in zip(zip(*found), FOUND)]
                yield pa.RecordBatch.from_arrays(columns, schema=FOUND)

    return bounded_batches(candidates.select("row", "vec_id", "vector")).mapInArrow(run, FOUND_DDL)


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = [F.desc("band"), F.desc("score"), F.desc("wide"), "no_id", "vec_id", "row"]
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(*order))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_row", "rank", "vec_id", "score", "row")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = BEST,
    scale: int = SCALE,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score, query_row, row): each query's k best others.

    ``is_query`` names the rows that ask, as a condition on the columns of ``vectors``.
    """
    taken = vectors.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("vec_id"),
        F.col(vector).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).withColumn("vector", F.col("vector").cast("array<double>"))
    stored = saved(taken.filter(is_finite("vector")))
    asking = saved(stored.filter("asks").select("row", "vec_id", "vector"))
    longest = asking.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return stored.sparkSession.createDataFrame([], RANKED_DDL)
    per_block = max(1, block_bytes // (8 * max(1, longest)))
    folder = shared_folder(stored.sparkSession)
    number, last = 0, -1
    while True:
        # One block: bounded by bytes, whatever the number of queries.
        block = asking.filter(F.col("row") > last).orderBy("row").limit(per_block).toArrow()
        if not block.num_rows:
            break
        last = block.column("row")[-1].as_py()
        sent = stored.sparkSession.sparkContext.broadcast(_as_bytes(block.select(["row", "vector"])))
        _merged(_scored(stored, sent, k, scale), k).write.parquet(f"{folder}/block={number}")
        sent.destroy()
        number += 1
    merged = stored.sparkSession.read.parquet(folder).drop("block")
    asked = asking.select(F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"))
    return merged.join(asked, "query_row").select("query_id", "rank", "vec_id", "score", "query_row", "row")


def _as_bytes(block: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, block.schema) as writer:
        writer.write_table(block)
    return sink.getvalue().to_pybytes()


@result_only
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
    return found.select("query_id", "rank", "vec_id", "score")
