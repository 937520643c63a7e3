"""The operators of this package as queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sitewatch.llm.chat import op10_chat
from sitewatch.llm.clustering import op11_centroid_clustering
from sitewatch.llm.decontam import op5_decontamination
from sitewatch.llm.merkle import op12_merkle_manifest
from sitewatch.llm.mixing import op6_mixing
from sitewatch.llm.ngram_join import op7_ngram_join
from sitewatch.llm.oracle import ORACLE
from sitewatch.llm.quality import op9_quality
from sitewatch.llm.secrets import op2_secrets
from sitewatch.llm.sharding import op8_sharding
from sitewatch.llm.suffix_dedup import op3_suffix_dedup
from sitewatch.llm.topk import op13_exact_topk
from sitewatch.llm.toxicity import op1_toxicity
from sitewatch.llm.warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_secrets": op2_secrets,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_ngram_join": op7_ngram_join,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_chat": op10_chat,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_topk": op13_exact_topk,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
