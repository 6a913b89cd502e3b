"""The queries of this subpackage and the SQL that says the same, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_transducer, fm_quality, near_join, perspectives, quality_rules, scaled_sketch, secret_scan, source_divergence, source_mix, suffix_repeats, superkmer_dedup, token_files

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_source_mix": source_mix.op1,
        "op2_suffix_array_dedup": suffix_repeats.op2,
        "op3_token_files": token_files.op3,
        "op4_bpe_transducer": bpe_transducer.op4,
        "op5_perspective_rotation": perspectives.op5,
        "op6_quality_classifier": fm_quality.op6,
        "op7_scaled_sketch": scaled_sketch.op7,
        "op8_ngram_join": near_join.op8,
        "op9_substring_dedup": superkmer_dedup.op9,
        "op10_quality_rules": quality_rules.op10,
        "op11_source_divergence": source_divergence.op11,
        "op12_secret_scan": secret_scan.op12,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_source_mix": source_mix.OP1_SQL, "op5_perspective_rotation": perspectives.OP5_SQL, "op10_quality_rules": quality_rules.OP10_SQL, "op11_source_divergence": source_divergence.OP11_SQL, "op12_secret_scan": secret_scan.OP12_SQL}
