"""Queries of this subpackage: name -> function of (spark, sf_dir), and their oracles."""

from __future__ import annotations

from . import ann, html_text, line_dedup, mixing, packing, quality_knn, quality_rules, sharding, simhash, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_sharding": sharding.op2_sharding,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality_knn.op5_quality,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_packing": packing.op7_packing,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_html_text": html_text.op10_html_text,
}

ORACLE_SQL = {
    "op3_ann": ann.OP3_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op6_quality_rules": quality_rules.OP6_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
}
