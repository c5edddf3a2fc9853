"""The registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from postweave.llm.language_id import op2_language_id
from postweave.llm.lm_scores import op8_lm_scores
from postweave.llm.merkle import OP13_SQL, op13_merkle_manifest
from postweave.llm.mixing import OP10_SQL, op10_mix_sources
from postweave.llm.near_dedup import OP1_SQL, op1_minhash_near_dedup
from postweave.llm.nearest import op5_nearest_neighbours
from postweave.llm.packing import op4_best_fit_packing
from postweave.llm.periodic import op12_periodic_runs
from postweave.llm.quality_model import op9_quality_model
from postweave.llm.quality_rules import op3_quality_rules
from postweave.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from postweave.llm.suffix_dedup import OP11_SQL, op11_suffix_dedup
from postweave.llm.token_counts import op7_token_counts

QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_lm_scores": op8_lm_scores,
    "op9_quality_model": op9_quality_model,
    "op10_mix_sources": op10_mix_sources,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op10_mix_sources": OP10_SQL,
    "op11_suffix_dedup": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
