"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from vigil.llm import (conversation_repair, exact_dedup, fingerprint, html_extract, lm_score, mixing, near_dedup, packing,
                       periodic_runs, quality, sharding, simhash, suffix_dedup)

QUERIES = {
    "op1_order_minhash": fingerprint.query,
    "op2_karmarkar_karp_shards": sharding.query,
    "op3_weighted_mixing": mixing.query,
    "op4_large_item_packing": packing.query,
    "op5_bagminhash_near_dedup": near_dedup.query,
    "op6_chunk_recipe_dedup": exact_dedup.query,
    "op7_suffix_array_dedup": suffix_dedup.query,
    "op8_context_mixing_score": lm_score.query,
    "op9_site_template_text": html_extract.query,
    "op10_kneser_ney_quality": quality.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_simhash_near_dedup": simhash.query,
    "op13_conversation_repair": conversation_repair.query,
}
ORACLE = {
    "op6_chunk_recipe_dedup": exact_dedup.ORACLE_SQL,
}
