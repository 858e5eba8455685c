"""Rule-based outputs: advice per tier, data-quality advice, wording bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import schema as S

# Data-quality thresholds.
BALANCE_MIN = 0.8
DIVERSITY_MIN = 0.1
ROWS_MIN = 1000


def with_guide(df: DataFrame, guide: DataFrame, key: str = S.TIER) -> DataFrame:
    """Rows enriched from a guide table that the caller supplies, one row for each key. The
    planner broadcasts it if it is small enough."""
    return df.join(guide, key, "left")


def note(col: str, notes: dict) -> Column:
    """The caller's note on a value, as a CASE expression; null for other values."""
    found = None
    for value, text in notes.items():
        found = (F if found is None else found).when(F.col(col) == value, F.lit(text))
    return found


def quality_advice(ind: DataFrame) -> DataFrame:
    """Flags and advice list from balance, diversity and row count."""
    imb = F.col("balance_score") < F.lit(BALANCE_MIN)
    div = F.col("brand_diversity") < F.lit(DIVERSITY_MIN)
    few = F.col("n_rows") < F.lit(ROWS_MIN)
    advice = F.array_compact(F.array(
        F.when(imb, F.lit("class imbalance: reweight or resample")),
        F.when(div, F.lit("low brand diversity: collect more brands")),
        F.when(few, F.lit("few rows: collect more data"))))
    return ind.select(
        "*", imb.alias("imbalance"), div.alias("low_brand_diversity"), few.alias("too_few_rows"),
        (~(imb | div | few)).alias("ok"),
        F.when(F.size(advice) == 0, F.array(F.lit("ok"))).otherwise(advice).alias("advice"))


def accuracy_wording(acc: str = "accuracy_pct"):
    """D3: accuracy above 80 % reads as good."""
    return F.when(F.col(acc) > 80, F.lit("good")).otherwise(F.lit("needs work"))


def accuracy_band(acc: str = "accuracy_pct"):
    """Interpretation band for an accuracy in percent (90 / 80 / 70)."""
    a = F.col(acc)
    return (F.when(a >= 90, F.lit("excellent")).when(a >= 80, F.lit("good"))
            .when(a >= 70, F.lit("fair")).otherwise(F.lit("poor")))


def overfit_band(gap: str = "overfit_gap"):
    """Interpretation band for the train-test accuracy gap (5 / 10 points)."""
    g = F.col(gap)
    return (F.when(g < 5, F.lit("healthy")).when(g < 10, F.lit("mild overfit"))
            .otherwise(F.lit("overfit")))
