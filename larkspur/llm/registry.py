"""The queries of this package and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from larkspur.llm import bpe, html, media, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_debruijn_dedup": substring_dedup.op1_debruijn_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_line_quality": quality.op3_line_quality,
    "op4_curriculum_mix": mixing.op4_curriculum_mix,
    "op5_bottom_k_near": near_dedup.op5_bottom_k_near,
    "op6_noisy_channel_toxicity": toxicity.op6_noisy_channel_toxicity,
    "op7_layout_html": html.op7_layout_html,
    "op8_audio_features": media.op8_audio_features,
    "op9_hash_tree_shards": sharding.op9_hash_tree_shards,
    "op10_word_table_bpe": bpe.op10_word_table_bpe,
}

ORACLE_SQL = {
    "op1_debruijn_dedup": substring_dedup.SQL,
    "op2_suffix_dedup": suffix_dedup.SQL,
    "op3_line_quality": quality.SQL,
    "op4_curriculum_mix": mixing.SQL,
    "op5_bottom_k_near": near_dedup.SQL,
}
