"""The corpus queries by name, and their SQL."""

from __future__ import annotations

from plotweave.llm import (
    chat, exact_dedup, hilbert, langid, mixing, packing, quality, simhash, urlfilter, weighted,
)

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_weighted_sampling": weighted.op4_weighted_sampling,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_pivotal_mixing": mixing.op6_pivotal_mixing,
    "op7_language_id": langid.op7_language_id,
    "op8_simhash": simhash.op8_simhash,
    "op9_hilbert_shards": hilbert.op9_hilbert_shards,
    "op10_chat_format": chat.op10_chat_format,
    "mixing_targets": mixing.mixing_targets,
    "shard_counts": hilbert.shard_counts,
}
ORACLE_SQL = {
    "op1_exact_dedup": exact_dedup.ORACLE,
    "op3_url_filter": urlfilter.ORACLE,
    "op10_chat_format": chat.ORACLE,
    "mixing_targets": mixing.TARGETS,
    "shard_counts": hilbert.COUNTS,
}
