"""The queries of this subpackage by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm import (
    op1_toxicity,
    op2_jaccard,
    op3_suffix_dedup,
    op4_language,
    op5_quality,
    op6_mpeg,
    op7_packing,
    op8_decontamination,
    op9_sharding,
    op10_surrogates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_noisy_channel_toxicity": op1_toxicity.op1_noisy_channel_toxicity,
        "op2_bayesian_jaccard": op2_jaccard.op2_bayesian_jaccard,
        "op3_suffix_dedup": op3_suffix_dedup.op3_suffix_dedup,
        "op4_hyperdimensional_language": op4_language.op4_hyperdimensional_language,
        "op5_subword_quality": op5_quality.op5_subword_quality,
        "op6_mpeg_frames": op6_mpeg.op6_mpeg_frames,
        "op7_configuration_packing": op7_packing.op7_configuration_packing,
        "op8_winnowing": op8_decontamination.op8_winnowing,
        "op9_rendezvous_shards": op9_sharding.op9_rendezvous_shards,
        "op10_surrogates": op10_surrogates.op10_surrogates,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_winnowing": op8_decontamination.ORACLE, "op9_rendezvous_shards": op9_sharding.ORACLE}
