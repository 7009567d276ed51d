"""Queries of the library's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from . import code, deps, findings, flows, histories, more, repos, text

_MODULES = (findings, text, deps, code, flows, histories, more, repos)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
