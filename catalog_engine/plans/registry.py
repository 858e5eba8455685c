"""Named queries over the driver's tables, each with an optional DuckDB twin.

A query is a callable ``(spark, sf_dir) -> DataFrame``. Its oracle is SQL
that DuckDB runs over the same Parquet tables and that must return the same
rows and column names. Queries whose answer is a model output carry no
oracle (rows-only check).
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from catalog_engine.plans import (  # noqa: F401
        catalog_plans, eval_plans, feature_plans, image_plans, model_plans, text_plans)
