"""Queries of this subpackage by name, with their comparison SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

MODULES = ("mixing", "templates", "repeats", "notices", "quality", "token_files", "url_rules", "sketches", "ngram_join", "archives", "merkle", "pieces", "variants")


def llm_query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return wrap


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    for m in MODULES:
        importlib.import_module(f"{__package__}.{m}")
    import corpus_pipeline

    queries, sql = {**QUERIES, "pipeline": corpus_pipeline.run}, dict(SQL)
    if corpus_pipeline.ORACLE_SQL:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return queries, sql
