"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, decontam, hard_negatives, license_scan, line_dedup, mixing, ngram_join, packing, ranked_search, secret_scan, suffix_dedup, topk, toxicity

QUERIES = {
    "op1_source_mix": mixing.op1_source_mix,
    "op2_decontamination": decontam.op2_decontamination,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_chat_format": chat.op6_chat_format,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_packing": packing.op12_packing,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}

ORACLES = {
    "op1_source_mix": mixing.ORACLE,
    "op6_chat_format": chat.ORACLE,
    "op10_exact_topk": topk.ORACLE,
    "op11_hard_negatives": hard_negatives.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
