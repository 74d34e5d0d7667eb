"""Queries of the subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from tilewright.llm import alignment, decontaminate, html_text, mixing, multiset_hash, negatives, quality, rules, sharding, simhash, token_counts, token_output, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_mixing": mixing.op2_mixing,
        "op3_token_output": token_output.op3_token_output,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_html_text": html_text.op5_html_text,
        "op6_simhash": simhash.op6_simhash,
        "op7_multiset_hash": multiset_hash.op7_multiset_hash,
        "op8_quality": quality.op8_quality,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_sharding": sharding.op10_sharding,
        "op11_alignment": alignment.op11_alignment,
        "op12_negatives": negatives.op12_negatives,
        "op13_rules": rules.op13_rules,
    }


def oracle_sql() -> dict:
    return {"op1_url_filter": url_filter.OP1_SQL, "op12_negatives": negatives.OP12_SQL, "op13_rules": rules.OP13_SQL}
