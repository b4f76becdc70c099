"""The registered queries of this subpackage."""

from __future__ import annotations

from rulelens.llm import bpe, chat, collocations, mixing, periodic, quality, secret_ledger, set_join, site_quality, token_counts, toxicity, url_rules, vector_search

_ALL = {
    "op1_mixing": mixing,
    "op2_site_quality": site_quality,
    "op3_bpe": bpe,
    "op4_vector_search": vector_search,
    "op5_url_rules": url_rules,
    "op6_set_join": set_join,
    "op7_token_counts": token_counts,
    "op8_quality_rules": quality,
    "op9_chat_windows": chat,
    "op10_secret_ledger": secret_ledger,
    "op11_periodic_runs": periodic,
    "op12_toxicity": toxicity,
    "op13_collocations": collocations,
}


def queries() -> dict:
    return {name: module.query for name, module in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _ALL.items() if module.SQL}
