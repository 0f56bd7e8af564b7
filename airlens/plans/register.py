"""Collects a module's queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from airlens.plans.demo import sql


def registrar() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    texts: dict[str, str] = {}

    def query(name: str, frames: str = "", body: str | None = None):
        def keep(f):
            queries[name] = f
            if body is not None:
                texts[name] = sql(frames, body) if frames else body.strip()
            return f

        return keep

    return queries, texts, query
