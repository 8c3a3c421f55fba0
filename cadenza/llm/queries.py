"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from cadenza.llm.content_sort import OP11_SQL, op11_content_sort
from cadenza.llm.decontamination import op9_benchmark_decontamination
from cadenza.llm.divergence import OP13_SQL, op13_source_divergence
from cadenza.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from cadenza.llm.language import op5_language_id
from cadenza.llm.licenses import op8_license_templates
from cadenza.llm.near_duplicates import op1_ngram_jaccard_join
from cadenza.llm.neighbours import op3_nearest_neighbours
from cadenza.llm.packing import op6_harmonic_packing
from cadenza.llm.sharding import op4_balanced_sharding
from cadenza.llm.substring import op2_substring_dedup
from cadenza.llm.suffix_array import op10_suffix_array_dedup
from cadenza.llm.wavelet import op7_wavelet_token_files

QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_balanced_sharding": op4_balanced_sharding,
    "op5_language_id": op5_language_id,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_wavelet_token_files": op7_wavelet_token_files,
    "op8_license_templates": op8_license_templates,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_suffix_array_dedup": op10_suffix_array_dedup,
    "op11_content_sort": op11_content_sort,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op11_content_sort": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
