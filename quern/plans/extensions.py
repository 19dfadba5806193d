"""What a caller may plug in: retrievers, model adapters, scoring backends."""

from __future__ import annotations

from typing import Protocol, runtime_checkable

from pyspark.sql import Column, DataFrame


@runtime_checkable
class Retriever(Protocol):
    """Gives contexts (an array of strings) for rows that ask for them."""

    def __call__(self, asked: DataFrame) -> DataFrame: ...


@runtime_checkable
class ModelAdapter(Protocol):
    """Writes prompts for a family of models."""

    name: str

    def prompt(self, system: Column, user: Column) -> Column: ...


@runtime_checkable
class Backend(Protocol):
    """Turns a column of texts into vectors or scores; a pandas UDF, or an expression."""

    name: str

    def embed(self, text: Column) -> Column: ...


class Registry:
    """Adapters and backends by name; the last one put under a name counts."""

    def __init__(self, default: str | None = None):
        self._held: dict[str, object] = {}
        self.default = default

    def put(self, item) -> None:
        self._held[item.name] = item
        self.default = self.default or item.name

    def get(self, name: str | None = None):
        """The item of that name; of an unknown or missing one the default."""
        if not self._held:
            raise KeyError("nothing is registered")
        return self._held.get(name or "", self._held.get(self.default or "", next(iter(self._held.values()))))

    def names(self) -> list[str]:
        return sorted(self._held)
