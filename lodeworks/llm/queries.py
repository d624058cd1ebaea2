"""The queries of this subpackage, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from lodeworks.llm import decontaminate, exact_dedup, fill_middle, html_text, importance, licenses, near_dedup, packing, pieces, quality_model, quality_rules, sharding, warc_store

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_exact_dedup": exact_dedup.op2,
    "op3_warc_store": warc_store.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_packing": packing.op5,
    "op6_html_text": html_text.op6,
    "op7_sharding": sharding.op7,
    "op8_licenses": licenses.op8,
    "op9_pieces": pieces.op9,
    "op10_quality_model": quality_model.op10,
    "op11_fill_middle": fill_middle.op11,
    "op12_importance": importance.op12,
    "op13_decontaminate": decontaminate.op13,
}

ORACLES = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op3_warc_store": warc_store.OP3_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op7_sharding": sharding.OP7_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_decontaminate": decontaminate.OP13_SQL,
}
