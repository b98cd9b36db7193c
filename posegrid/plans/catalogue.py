"""Registered queries and their SQL twins, gathered from the modules of this folder."""

from __future__ import annotations


def _modules() -> list:
    from . import aggregates, catalogues, geometry, models, more, recordings, series, signals

    return [geometry, series, aggregates, signals, catalogues, models, more, recordings]


def queries() -> dict:
    return {name: run for m in _modules() for name, run in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
