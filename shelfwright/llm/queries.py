"""The registered queries of the subpackage and the SQL that some must agree with."""

from __future__ import annotations

from shelfwright.llm import bpe, chat, exact_dedup, language, merkle, mixture, near_dup, quality, secrets, substrings, vector_links, warc, whitening

QUERIES = {
    "op1_chat_prefix_targets": chat.op1,
    "op2_warc_boundary_chain": warc.op2,
    "op3_byte_level_bpe": bpe.op3,
    "op4_capped_water_filling": mixture.op4,
    "op5_bbit_minhash": near_dup.op5,
    "op6_string_kernel_language": language.op6,
    "op7_suffix_merge_sort": substrings.op7,
    "op8_secret_blob_ledger": secrets.op8,
    "op9_quality_decision_list": quality.op9,
    "op10_cover_tree_links": vector_links.op10,
    "op11_postorder_manifest": merkle.op11,
    "op12_refined_whitening": whitening.op12,
    "op13_salted_exact_dedup": exact_dedup.op13,
}
SQL = {
    "op1_chat_prefix_targets": chat.OP1_SQL,
    "op2_warc_boundary_chain": warc.OP2_SQL,
    "op4_capped_water_filling": mixture.OP4_SQL,
    "op5_bbit_minhash": near_dup.OP5_SQL,
    "op8_secret_blob_ledger": secrets.OP8_SQL,
    "op10_cover_tree_links": vector_links.OP10_SQL,
    "op11_postorder_manifest": merkle.OP11_SQL,
    "op13_salted_exact_dedup": exact_dedup.OP13_SQL,
}
