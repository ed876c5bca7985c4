"""The named queries of the engine and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from quernstone.plans.bindings import sql

_QUERIES: dict[str, Callable] = {}
_ORACLES: dict[str, str] = {}
_MODULES = ("dataset_queries", "retrieval_queries", "store_queries", "verdict_queries", "report_queries", "pair_queries", "stream_queries", "verify_queries", "training_queries", "browse_queries")


def query(name: str, text: str | None = None, *needs: str) -> Callable[[Callable], Callable]:
    """Registers (spark, sf_dir) -> DataFrame, and its SQL over named row sets."""

    def register(f: Callable) -> Callable:
        _QUERIES[name] = f
        if text is not None:
            _ORACLES[name] = sql(text, *needs)
        return f

    return register


def _load() -> None:
    for module in _MODULES:
        import_module(f"quernstone.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
