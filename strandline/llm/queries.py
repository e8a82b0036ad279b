"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, dialogs, extract, jaccard, lines, middle, pieces, pseudo, repeats, tokens, topk, toxicity, urls


def queries() -> dict:
    return {
        "op1_suffix_dedup": repeats.query,
        "op2_sentencepiece": pieces.query,
        "op3_decontamination": decontaminate.query,
        "op4_toxicity": toxicity.query,
        "op5_url_filter": urls.query,
        "op6_jaccard_join": jaccard.query,
        "op7_line_dedup": lines.query,
        "op8_topk": topk.query,
        "op9_pseudo_likelihood": pseudo.query,
        "op10_html_extraction": extract.query,
        "op11_token_counts": tokens.query,
        "op12_fill_in_middle": middle.query,
        "op13_conversation_repair": dialogs.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": urls.ORACLE, "op7_line_dedup": lines.ORACLE, "op8_topk": topk.ORACLE, "op12_fill_in_middle": middle.ORACLE}
