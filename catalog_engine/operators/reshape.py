"""Wide/long reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame


def melt(df: DataFrame, ids: list, values: list, var: str = "metric",
         value: str = "value") -> DataFrame:
    """U4: wide to long (``pd.melt``); value columns must share a type."""
    return df.unpivot(ids, values, var, value)


def transpose_row(df: DataFrame, var: str = "metric", value: str = "value") -> DataFrame:
    """A one-row report as (metric, value) rows."""
    return df.unpivot([], df.columns, var, value)
