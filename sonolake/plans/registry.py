"""Names, callables and oracle SQL of every query outside the training-data subpackage."""

from __future__ import annotations

import importlib

FLAGSHIP = "gated_loudness"

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def add(name: str, query, sql: str | None = None) -> None:
    """Register a query; ``sql`` computes the same in DuckDB."""
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql.strip()


def load() -> None:
    """Import the modules that register queries."""
    for module in ("loud_q", "spatial_q", "bits_q", "mux_q", "graph_q", "scalar_q", "stream_q", "alloc_q"):
        importlib.import_module(f"{__package__}.{module}")
