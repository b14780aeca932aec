"""Registries by name: queries with their DuckDB SQL, readers, writers, reducers, augmenters and rankers."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """A name to a callable; ``register`` also works as a decorator."""

    def __init__(self, kind: str):
        self.kind, self._items = kind, {}

    def register(self, name: str) -> Callable:
        def keep(item: Any) -> Any:
            self.add(name, item)
            return item

        return keep

    def add(self, name: str, item: Any) -> None:
        if name in self._items:
            raise ValueError(f"{self.kind} {name!r} is registered twice")
        self._items[name] = item

    def get(self, name: str) -> Any:
        if name not in self._items:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(sorted(self._items))}")
        return self._items[name]

    def list(self) -> list[str]:
        return sorted(self._items)

    def items(self):
        return self._items.items()


QUERIES = Registry("query")
ORACLES: dict[str, str] = {}
READERS, WRITERS, REDUCERS, AUGMENTERS, RANKERS = (Registry(k) for k in ("reader", "writer", "reducer", "augmenter", "ranker"))


def query(name: str, sql: str | None = None, graphs: bool = True) -> Callable:
    """Register a query (spark, sf_dir) and its oracle; ``graphs`` puts the derived graphs' expressions before it."""
    from twinweave.plans.kg import SQL

    def keep(f: Callable) -> Callable:
        QUERIES.add(name, f)
        if sql:
            text = sql.strip()
            ORACLES[name] = (f"WITH {SQL}, {text[5:]}" if text[:5].upper() == "WITH " else f"WITH {SQL} {text}") if graphs else text
        return f

    return keep


def autoload() -> None:
    """Import every module that registers something."""
    import importlib

    for module in ("operators.splits", "operators.augment", "operators.ranking", "sources.files", "plans.catalog"):
        importlib.import_module(f"twinweave.{module}")
