"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        def keep(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep

    def also(self, names: dict[str, str]) -> None:
        """Register queries under second names."""
        for name, of in names.items():
            self.queries[name] = self.queries[of]
            self.oracles[name] = self.oracles[of]
