"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_text, mixing, quality, simhash, substring, suffix_array, topk, toxicity, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_merkle_audit": warc.op5_merkle_audit,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_suffix_array": suffix_array.op7_suffix_array,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_mixing": mixing.op9_mixing,
    "op10_html": html_text.op10_html,
}

SQL = {
    "op1_topk": topk.OP1_SQL,
    "op4_decontaminate": decontaminate.OP4_SQL,
    "op5_merkle_audit": warc.OP5_SQL,
    "op9_mixing": mixing.OP9_SQL,
}
