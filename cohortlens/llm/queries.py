"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from cohortlens.llm import (chat_format, hyperminhash, lang_id, line_dedup, mixing, packing, prefix_forest, quality,
                            secrets, spelling, suffix_dedup, topk, whitening)

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_near_dedup": hyperminhash.op2_near_dedup,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_curve_pack": packing.op4_curve_pack,
    "op5_lang_id": lang_id.op5_lang_id,
    "op6_prefix_forest": prefix_forest.op6_prefix_forest,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_topk": topk.op8_topk,
    "op9_source_mix": mixing.op9_source_mix,
    "op10_quality": quality.op10_quality,
    "op11_whitening": whitening.op11_whitening,
    "op12_chat_format": chat_format.op12_chat_format,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE_SQL = {
    "op2_near_dedup": hyperminhash.OP2_SQL,
    "op7_line_dedup": line_dedup.OP7_SQL,
    "op8_topk": topk.OP8_SQL,
    "op9_source_mix": mixing.OP9_SQL,
}
