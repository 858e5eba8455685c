"""Row-level transforms: filters, renames, harmonisation, unions (P*, U1, J3, X*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X

# Gender labels unified across sources in integrated mode.
GENDER_HARMONISE = {"Male": "Men", "Female": "Women"}
# Stand-in addition: two part types the stand-in treats as one label.
STANDIN_HARMONISE = {"PROMO": "STANDARD"}


def drop_missing(df: DataFrame, cols: list) -> DataFrame:
    """Drop rows with a missing value in any of ``cols``."""
    return df.na.drop(subset=cols)


def with_source(df: DataFrame, name: str) -> DataFrame:
    """Tag every row with its source name."""
    return df.withColumn(S.SOURCE, F.lit(name))


def rename(df: DataFrame, mapping: dict) -> DataFrame:
    """Source-specific column names to the common schema."""
    return df.withColumnsRenamed(mapping)


def harmonise(df: DataFrame, col: str, mapping: dict) -> DataFrame:
    """P5: replace category values (``Series.replace``)."""
    return df.na.replace(mapping, subset=[col])


def default_images(df: DataFrame, value: int = 1) -> DataFrame:
    """A constant image count where a source has none."""
    return df.withColumn(S.IMAGES, F.coalesce(F.col(S.IMAGES), F.lit(value)))


def generated_images(df: DataFrame, key: str = S.PRODUCT_ID, lo: int = 1, hi: int = 10) -> DataFrame:
    """Where a source has no image count, a seeded draw in [lo, hi) per key."""
    draw = X.uniform_int(key, X.MULT_SAMPLE, lo, hi)
    cur = F.col(S.IMAGES) if S.IMAGES in df.columns else F.lit(None).cast("int")
    return df.withColumn(S.IMAGES, F.coalesce(cur, draw))


def update_where(df: DataFrame, col: str, mask, value) -> DataFrame:
    """``df.loc[mask, col] = value``."""
    return df.withColumn(col, F.when(mask, value).otherwise(F.col(col)))


def correct_flag(df: DataFrame, pred: str = "prediction", label: str = "label") -> DataFrame:
    """1 where the prediction equals the label, else 0."""
    return df.withColumn("correct", (F.col(pred) == F.col(label)).cast("int"))


def relabel(df: DataFrame, names: list) -> DataFrame:
    """Positional column relabel."""
    return df.toDF(*names)


def tier_counts(df: DataFrame) -> DataFrame:
    """Rows per tier, all three in one pass."""
    return df.agg(*[F.count_if(F.col(S.TIER) == F.lit(t)).alias(f"n_{t.lower()}")
                    for t in S.TIERS])


def distinct_part_values(line_df: DataFrame, part_df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a part attribute over the catalog.

    Distinct part keys first (partial aggregate), then the attribute.
    """
    keys = line_df.select("l_partkey").distinct()
    joined = keys.join(part_df, F.col("l_partkey") == F.col("p_partkey"), "left")
    return joined.select(col).distinct()


def rows_with_selected(line_df: DataFrame, part_df: DataFrame, selected: DataFrame,
                       key: str) -> DataFrame:
    """Keep catalog rows whose ``key`` is in ``selected`` (a left-semi join).

    The selection is applied to the part dimension first, so the semi join
    against the selection never touches the line side.
    """
    chosen = part_df.join(selected, key, "left_semi")
    return line_df.join(chosen, F.col("l_partkey") == F.col("p_partkey"), "inner").drop("p_partkey")


def union_sources(frames: list) -> DataFrame:
    """Union by column name; a column missing from a source becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unified_sources(tiered_lines: DataFrame, part_df: DataFrame) -> DataFrame:
    """U1 + P4 + P5 + P6 on the stand-in: three sources in one table, told apart
    by the source flag, harmonised. (``union_sources`` unions real files.)

    Source A carries a padded product code; the third source has no image count
    (defaults to 1). The table is read once, and part attributes are attached
    once.
    """
    src = F.col(S.SOURCE)
    is_a, is_n = src == "A", src == "N"
    # one scan: each row takes the columns of its own source under their common names
    rows = tiered_lines.select(
        S.PRODUCT_ID, "l_partkey", S.SOURCE, S.TIER, S.PRICE,
        F.when(is_a, F.format_string("HM%06d", F.col("l_partkey"))).alias("product_code"),
        F.when(is_a | is_n, F.col(S.IMAGES)).alias(S.IMAGES))
    out = default_images(rows, 1)
    out = out.join(part_df, F.col("l_partkey") == F.col("p_partkey"), "left")
    out = harmonise(out, S.GENDER, {**GENDER_HARMONISE, **STANDIN_HARMONISE})
    return out.select(S.PRODUCT_ID, S.NAME, S.BRAND, S.GENDER, S.COLOR, S.PRICE, S.IMAGES,
                      S.SOURCE, S.TIER, "product_code")


def display_formats(line_df: DataFrame) -> DataFrame:
    """Thousands separators, fixed decimals and percent strings per source."""
    s = line_df.groupBy(S.SOURCE).agg(F.count(F.lit(1)).alias("n"),
                                      F.avg(S.PRICE).alias("avg_price"))
    share = X.pct(F.col("n"), F.sum("n").over(Window.partitionBy()), 1)
    return s.select(
        S.SOURCE,
        F.format_number(F.col("n"), 0).alias("n_fmt"),
        F.format_string("%.2f", F.bround("avg_price", 2)).alias("avg_fmt"),
        F.format_string("%.1f%%", share).alias("share_fmt"))
