"""Operators of a training-data pipeline: one module each, with its query and, where it has one, its SQL."""

from __future__ import annotations

from importlib import import_module

#: query name -> module
NAMES = {
    "op1_pii_feistel": "pii",
    "op2_html_blocks": "html",
    "op3_secret_links": "secrets",
    "op4_imatch": "imatch",
    "op5_min_bin_slack": "packing",
    "op6_curriculum": "mixing",
    "op7_suffix_cover": "suffixes",
    "op8_line_quality": "quality",
    "op9_minmax_hash": "minmax",
    "op10_toxicity": "toxicity",
}
MODULES = {name: import_module(f".{module}", __name__) for name, module in NAMES.items()}
QUERIES = {name: module.query for name, module in MODULES.items()}
ORACLES = {name: module.SQL for name, module in MODULES.items() if getattr(module, "SQL", None)}
