"""Every query of this folder, by name, with its SQL where SQL can express it."""

from __future__ import annotations

import importlib

MODULES = ("substring_dedup", "packing", "pii", "warc", "token_counts", "near_duplicates", "decontaminate", "quality", "language_model", "url_filter")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"codeloom.llm.{name}"), what)
    return found


def queries() -> dict:
    import corpus_pipeline

    return _all("QUERIES") | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    return _all("ORACLE_SQL") | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
