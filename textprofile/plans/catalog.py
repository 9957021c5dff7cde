"""Query registry: every registered query and its DuckDB oracle."""

from __future__ import annotations

from . import q_io, q_model, q_prep, q_text, q_vec

_MODULES = (q_text, q_prep, q_io, q_vec, q_model)


def all_queries() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.QUERIES)
    return out


def all_oracles() -> dict:
    out: dict = {}
    for m in _MODULES:
        out.update(m.ORACLE)
    return out
