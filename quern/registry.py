"""The named queries of the engine: name to (builder, SQL that gives the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
_BUILDERS: dict[str, Builder] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a builder (spark, sf_dir) -> DataFrame under its name, with the SQL that checks it."""
    def put(builder: Builder) -> Builder:
        key = name or builder.__name__
        if key in _BUILDERS:
            raise ValueError(f"two queries are named {key}")
        _BUILDERS[key] = builder
        if sql:
            _SQL[key] = sql
        return builder

    return put


def _load() -> None:
    from . import queries  # noqa: F401  registers as it is imported


def all_queries() -> dict[str, Builder]:
    _load()
    return dict(_BUILDERS)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _load()
    return _BUILDERS["filtered_topk_cosine"](spark, sf_dir)
