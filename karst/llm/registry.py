"""The queries of this subpackage and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, fill_middle, license_scan, line_dedup, ngram_join, quality_model, quality_rules, sale_enrichment, sharding, simhash, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_bpe": bpe.op4_bpe,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_quality_model": quality_model.op8_quality_model,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_simhash": simhash.op11_simhash,
    "op12_sale_enrichment": sale_enrichment.op12_sale_enrichment,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_ngram_join": ngram_join.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op12_sale_enrichment": sale_enrichment.ORACLE_SQL,
    "op13_fill_middle": fill_middle.ORACLE_SQL,
}
