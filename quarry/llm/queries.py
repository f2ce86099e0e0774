"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import chat, html_tree, jaccard_join, mixing, neighbours, packing, quality_classifier, quality_rules, substring_dedup, warc

QUERIES = {
    "op1_neighbours": neighbours.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_chat": chat.op3,
    "op4_jaccard_join": jaccard_join.op4,
    "op5_warc": warc.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_quality_classifier": quality_classifier.op7,
    "op8_packing": packing.op8,
    "op9_mixing": mixing.op9,
    "op10_html": html_tree.op10,
}

SQL: dict[str, str] = {"op3_chat": chat.SQL}
