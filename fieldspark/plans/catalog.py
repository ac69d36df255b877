"""Registered queries of the engine, by operator, with their SQL twins."""

from __future__ import annotations

from fieldspark.plans import grids, joins, pairs, regression, scans, stores, tracks

_MODULES = (scans, grids, tracks, joins, pairs, regression, stores)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}

flagship = regression.flagship
