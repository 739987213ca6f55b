"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from roadcut.llm import adaptive_quality
from roadcut.llm.adaptive_quality import op9_adaptive_quality
from roadcut.llm.cgk_decontamination import op5_cgk_decontamination
from roadcut.llm.chunk_bpe import op6_chunk_reuse_bpe
from roadcut.llm.dac_store import op8_directly_addressable_codes
from roadcut.llm.order_minhash import op7_order_minhash
from roadcut.llm.secret_cost import op3_guess_cost_secrets
from roadcut.llm.site_templates import op1_site_templates
from roadcut.llm.stratified_shards import op4_stratified_shards
from roadcut.llm.substring_fm import op2_substring_fm_index
from roadcut.llm.suffix_lpf import op10_suffix_array_lpf

QUERIES = {f.__name__: f for f in (op1_site_templates, op2_substring_fm_index, op3_guess_cost_secrets, op4_stratified_shards, op5_cgk_decontamination, op6_chunk_reuse_bpe, op7_order_minhash, op8_directly_addressable_codes, op9_adaptive_quality, op10_suffix_array_lpf)}
SQL: dict[str, str] = {"op9_adaptive_quality": adaptive_quality.SQL}
