"""Named queries over the given tables."""

from __future__ import annotations


def _load():
    from . import accumulation, base, classification, cleaning, corpus, landing, reports, runs  # noqa: F401
    return base


def all_queries() -> dict:
    return dict(_load().QUERIES)


def all_oracles() -> dict[str, str]:
    b = _load()
    return {name: b.duck_sql(sql) for name, sql in b.ORACLES.items()}
