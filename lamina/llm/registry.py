"""All queries of this subpackage and the SQL of those that have one."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mixing", "packing", "embedding", "toxicity", "fingerprint", "quality", "suffix", "secrets", "pii", "simhash"]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"lamina.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f"lamina.llm.{m}").SQL.items()}
