"""Queries of the ten training-data operators and of the pipeline, and SQL where SQL can express them."""

from __future__ import annotations

import importlib

MODULES = ["q_secrets", "q_chat", "q_quality", "q_warc", "q_media", "q_lm", "q_bpe", "q_mixing", "q_licenses", "q_jaccard", "q_base", "q_pipeline"]


def _modules():
    return [importlib.import_module(f"{__package__}.{name}") for name in MODULES]


def queries() -> dict:
    found: dict = {}
    for module in _modules():
        found |= module.QUERIES
    return found


def oracle_sql() -> dict:
    found: dict = {}
    for module in _modules():
        found |= module.SQL
    return found
