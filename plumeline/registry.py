"""Every query of the package by name: a builder (spark, sf_dir) -> DataFrame and, where there is one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

_BUILDERS: dict[str, Builder] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        if name in _BUILDERS:
            raise ValueError(f"{name} is registered twice")
        _BUILDERS[name] = build
        if sql is not None:
            _ORACLES[name] = sql
        return build

    return add


def queries() -> dict[str, Builder]:
    return dict(_BUILDERS)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
