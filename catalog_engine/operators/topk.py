"""Sorts, limits, top-k and deterministic samples.

Every ordered limit becomes TakeOrderedAndProject: each task keeps its own
top k and the driver merges k x tasks rows, never the whole table. Ties are
broken by the full row key so results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.sources.catalog import ROW_ORDER


def top_revenue(enriched_lines: DataFrame, part_df: DataFrame, n: int = 10) -> DataFrame:
    """The n products with the highest expected revenue, with their names.

    The top n is taken on the line side; only those n rows meet the part
    table, so the join is tiny.
    """
    top = enriched_lines.orderBy(F.desc_nulls_last(S.REVENUE), *ROW_ORDER).limit(n)
    named = top.join(part_df, F.col("l_partkey") == F.col("p_partkey"), "left")
    return named.select(S.PRODUCT_ID, S.NAME, S.PRICE, S.CUSTOMERS, S.SALES, S.REVENUE)


def hash_sample(df: DataFrame, k: int, cols: list, key: str = S.PRODUCT_ID,
                order: list = ROW_ORDER) -> DataFrame:
    """K rows without replacement, chosen by a seeded hash of the key."""
    return df.orderBy(X.hash_unit(key, X.MULT_SAMPLE), *order).limit(k).select(*cols)


def first_rows(tiered_lines: DataFrame, part_df: DataFrame, n: int = 10) -> DataFrame:
    """Preview of the first n catalog rows by product key."""
    head = tiered_lines.orderBy(*ROW_ORDER).limit(n)
    named = head.join(part_df, F.col("l_partkey") == F.col("p_partkey"), "left")
    return named.select(S.PRODUCT_ID, S.NAME, S.BRAND, S.GENDER, S.COLOR, S.PRICE, S.IMAGES,
                        S.SOURCE, S.TIER)


def arg_max(df: DataFrame, score: str, tie: list) -> DataFrame:
    """T4: the row with the highest score (first by ``tie`` on equal scores)."""
    return df.orderBy(F.desc(score), *tie).limit(1)
