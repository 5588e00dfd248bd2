"""Queries and oracles of the training-data operators, by the names they are registered under."""

from __future__ import annotations

import importlib

_NAMES = {
    "op1_lz_fingerprints": "fingerprints",
    "op2_best_fit_packing": "packing",
    "op3_token_counts": "token_counts",
    "op4_warc_archive": "warc",
    "op5_html_extraction": "html_extraction",
    "op6_quality_classifier": "quality",
    "op7_source_mixing": "mixing",
    "op8_exact_dedup": "exact_dedup",
    "op9_suffix_dedup": "suffix_dedup",
    "op10_simhash_dedup": "simhash",
    "op11_secret_scan": "secret_scan",
    "op12_turn_repair": "turn_repair",
    "op13_hot_key_join": "hot_join",
}
_MODULES = {name: importlib.import_module(f"{__package__}.{module}") for name, module in _NAMES.items()}


def queries() -> dict:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.SQL for name, m in _MODULES.items() if getattr(m, "SQL", None)}
