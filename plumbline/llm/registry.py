"""Queries of the training-data operators, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    alignment,
    bloom_lm,
    chosen_path,
    collocations,
    fingerprints,
    forest,
    interleave,
    latent,
    licenses,
    ordinal,
    records,
    transducer,
    url_lists,
)

_QUERIES = [
    forest.op1_projection_forest,
    records.op2_token_records,
    transducer.op3_piece_transducer,
    chosen_path.op4_near_duplicates,
    url_lists.op5_temporal_url_lists,
    interleave.op6_interleaved_shards,
    bloom_lm.op7_bloom_model_scores,
    ordinal.op8_graded_quality,
    licenses.op9_license_labels,
    latent.op10_latent_leaks,
    alignment.op11_aligned_tokens,
    collocations.op12_phrases,
    fingerprints.op13_fingerprints,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_projection_forest": forest.OP1_SQL,
        "op5_temporal_url_lists": url_lists.OP5_SQL,
        "op12_phrases": collocations.OP12_SQL,
    }
