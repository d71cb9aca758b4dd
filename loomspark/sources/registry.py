"""Connectors by name."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession


class SourceConnector(Protocol):
    """A way to read a table.  Estimates come from metadata; None says unknown."""

    def read(self, spark: SparkSession) -> DataFrame: ...
    def partitions(self, spark: SparkSession) -> int | None: ...
    def estimate_rows(self, spark: SparkSession) -> int | None: ...
    def estimate_bytes(self, spark: SparkSession) -> int | None: ...


class SinkConnector(Protocol):
    """A way to write a result; returns a summary."""

    def write(self, df: DataFrame, run_key: str | None) -> dict: ...


_sources: dict[str, type] = {}
_sinks: dict[str, type] = {}


def _register(kind: dict[str, type], name: str, cls: type, replace: bool) -> None:
    if name in kind and not replace:
        raise ValueError(f"connector {name!r} is registered already")
    kind[name] = cls


def _get(kind: dict[str, type], name: str) -> type:
    if name not in kind:
        raise KeyError(f"no connector {name!r}; there are {', '.join(sorted(kind))}")
    return kind[name]


def register_source(name: str, cls: type, replace: bool = False) -> None:
    _register(_sources, name, cls, replace)


def register_sink(name: str, cls: type, replace: bool = False) -> None:
    _register(_sinks, name, cls, replace)


def get_source(name: str) -> type:
    return _get(_sources, name)


def get_sink(name: str) -> type:
    return _get(_sinks, name)
