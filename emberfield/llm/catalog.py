"""The registered queries of the training-data operators and, where SQL can say them, their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13")
QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def load() -> tuple[dict, dict]:
    for module in MODULES:
        importlib.import_module(f"emberfield.llm.queries.{module}")
    return QUERIES, SQL
