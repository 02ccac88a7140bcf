"""Every query of the engine with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name; oracle: the same rows in SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle.strip()
        return f

    return add


def _load() -> None:
    from quaylark.plans import composites, contexts, decisions, events, models, outputs, relational, series, statistics, streams, texts  # noqa: F401


_load()
