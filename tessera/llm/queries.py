"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.fingerprints import op8_consistent_sampling
from tessera.llm.knn import OP4_SQL, op4_voronoi_knn
from tessera.llm.licenses import op9_license_scan
from tessera.llm.mixing import OP5_SQL, op5_weighted_fair_mix
from tessera.llm.ngrams import OP2_SQL, op2_ngram_join
from tessera.llm.packing import op1_pattern_packing
from tessera.llm.pii import op7_skip_chain_crf
from tessera.llm.substrings import op3_longest_previous_factor
from tessera.llm.toxicity import op6_string_kernel_svm
from tessera.llm.urls import OP10_SQL, op10_host_reputation


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_pattern_packing, op2_ngram_join, op3_longest_previous_factor, op4_voronoi_knn, op5_weighted_fair_mix, op6_string_kernel_svm, op7_skip_chain_crf, op8_consistent_sampling, op9_license_scan, op10_host_reputation)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op4_voronoi_knn": OP4_SQL, "op5_weighted_fair_mix": OP5_SQL, "op10_host_reputation": OP10_SQL}
