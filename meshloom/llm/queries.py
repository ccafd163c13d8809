"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from meshloom.llm import benchmatch, bitplanes, chat, linededup, mixing, neardup, packing, pii, pst, quality, suffixes, topk, transducer

QUERIES = {
    "op1_suffix_tree": pst.op1_suffix_tree,
    "op2_exact_top_k": topk.op2_exact_top_k,
    "op3_chat_format": chat.op3_chat_format,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_quality_rules": quality.op5_quality_rules,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_personal_data": pii.op7_personal_data,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_pack_tokens": packing.op10_pack_tokens,
    "op11_benchmark_overlap": benchmatch.op11_benchmark_overlap,
    "op12_source_audit": transducer.op12_source_audit,
    "op13_centroid_clusters": bitplanes.op13_centroid_clusters,
}
ORACLES = {
    "op2_exact_top_k": topk.ORACLE,
    "op3_chat_format": chat.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op5_quality_rules": quality.ORACLE,
    "op6_near_duplicates": neardup.ORACLE,
    "op8_line_dedup": linededup.ORACLE,
    "op11_benchmark_overlap": benchmatch.ORACLE,
    "op12_source_audit": transducer.ORACLE,
    "op13_centroid_clusters": bitplanes.ORACLE,
}
