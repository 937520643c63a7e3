"""A training corpus from raw documents, stage by stage.

Each stage takes all rows that the one before it kept, and returns the columns
of documents; the last adds where the rows go. Stages are written as Parquet to the
shared folder and read again, so a lost executor costs one stage at most.

Ids may be NULL or repeated: where a stage joins its result back to the texts, it
does so by a number that it gives to each row first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewatch.llm.common import table
from sitewatch.llm.decontam import decontaminate
from sitewatch.llm.mixing import mix
from sitewatch.llm.ngram_join import near_duplicates
from sitewatch.llm.sharding import add_shards
from sitewatch.llm.toxicity import learn, score
from sitewatch.session import saved, scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    scored = score(docs.select(*COLUMNS), learn(docs, table(spark, sf_dir, "labels")))
    return scored.filter(F.col("score") < 0.5).select(*COLUMNS)


def numbered(docs: DataFrame) -> DataFrame:
    """The documents with ``row_id``, another one in every row; written, so that it stays."""
    return saved(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_id")))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, a NULL id last."""
    docs = numbered(docs)
    rows, _ = near_duplicates(docs, key="row_id")
    rows = rows.select(F.col("doc_id").alias("row_id"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")
    kept = (
        rows.join(docs.select("row_id", "doc_id"), "row_id")
        .groupBy("component_id")
        .agg(F.min(order).alias("first"))
        .select("first.row_id")
    )
    return docs.join(kept, "row_id", "left_semi").select(*COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hits") == 0).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as the mix takes it: not at all, once or more."""
    docs = numbered(docs)
    copies = mix(docs, row="row_id").filter(F.col("copies") > 0).select("row_id", "copies")
    return (
        docs.join(copies, "row_id")
        .select(*COLUMNS, F.explode(F.array_repeat(F.lit(True), F.col("copies"))).alias("_copy"))
        .select(*COLUMNS)
    )


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard, its shard if one is added, and its slot."""
    docs = numbered(docs)
    placed = add_shards(docs.select("doc_id", "row_id"), "doc_id", row="row_id")
    return docs.join(placed.drop("doc_id"), "row_id").select(*COLUMNS, "shard", "grown_shard", "slot")


STAGES = [
    ("toxicity", without_toxic),
    ("near duplicates", without_near_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No SQL here: learned scores and linked groups are beyond it; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch() as whole:
        for _, stage in STAGES:
            with scratch() as scope:
                # All that led to the stage's rows goes with the scope.
                last = stage is STAGES[-1][1]
                docs = saved(stage(spark, docs, sf_dir), whole.outer if last else scope.outer)
    return docs
