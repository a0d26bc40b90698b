"""The queries of this subpackage and the SQL for the same rows, where SQL can express them."""
from __future__ import annotations

import importlib

_QUERIES = {
    "op1_quality_rules": "quality_rules",
    "op2_decontaminate": "decontaminate",
    "op3_secret_scan": "secret_scan",
    "op4_near_dedup": "near_dedup",
    "op5_token_counts": "token_counts",
    "op6_lm_scoring": "lm_scoring",
    "op7_mixing": "mixing",
    "op8_license_scan": "license_scan",
    "op9_url_filter": "url_filter",
    "op10_language_id": "language_id",
    "op11_source_divergence": "source_divergence",
    "op12_quality_classifier": "quality_classifier",
    "op13_collocations": "collocations",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f".{module}", __package__), name) for name, module in _QUERIES.items()}
    return found | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, module in _QUERIES.items():
        sql = getattr(importlib.import_module(f".{module}", __package__), "SQL", None)
        if sql:
            found[name] = sql
    if (sql := importlib.import_module("corpus_pipeline").ORACLE_SQL) is not None:
        found["pipeline"] = sql
    return found
