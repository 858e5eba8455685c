"""Catalog aggregates.

Every aggregate is one declarative ``agg`` so Catalyst plans a partial
(map-side) aggregate before the exchange. Aggregates that need part
attributes go through ``part_rollup`` (pre-aggregate lines per part key,
then join), so the join sees a reduced input and a hot part key cannot
overload one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.sources.catalog import STANDIN_TIERS, part_rollup


def _tier_counts(tiers):
    t = X.price_tier(S.PRICE, *tiers)
    return [F.count_if(t == F.lit(v)).alias(f"n_{v.lower()}") for v in S.TIERS]


def catalog_stats(line_df: DataFrame, part_df: DataFrame, tiers=STANDIN_TIERS,
                  digits: int = 6) -> DataFrame:
    """A1: rows, distinct brand/gender/colour (a missing value counts as one),
    mean/min/max price and the share of each tier, in one pass.

    Distinct values are counted over the (brand, gender, colour) combinations,
    which are few, not over the parts."""
    rolled = part_rollup(line_df, part_df, [], [
        F.count(F.lit(1)).alias("n"), F.sum(S.PRICE).alias("s"), F.count(S.PRICE).alias("c"),
        F.min(S.PRICE).alias("mn"), F.max(S.PRICE).alias("mx"), *_tier_counts(tiers)])
    tier_sums = [f"n_{v.lower()}" for v in S.TIERS]
    small = rolled.groupBy(S.BRAND, S.GENDER, S.COLOR).agg(
        *[F.sum(c).alias(c) for c in ("n", "s", "c", *tier_sums)], F.min("mn").alias("mn"), F.max("mx").alias("mx"))
    n = F.sum("n")
    return small.agg(
        n.alias("n_rows"),
        X.distinct_incl_null(S.BRAND).alias("n_brands"),
        X.distinct_incl_null(S.GENDER).alias("n_genders"),
        X.distinct_incl_null(S.COLOR).alias("n_colors"),
        F.bround(F.try_divide(F.sum("s"), F.sum("c")), digits).alias("avg_price"),
        F.min("mn").alias("min_price"),
        F.max("mx").alias("max_price"),
        *[X.pct(F.sum(c), n, digits).alias(f"pct_{v.lower()}") for c, v in zip(tier_sums, S.TIERS, strict=True)],
    )


def source_descriptor(line_df: DataFrame, part_df: DataFrame, digits: int = 6) -> DataFrame:
    """A2: per source: rows, distinct brands (missing counts as one), mean price."""
    rolled = part_rollup(line_df, part_df, [S.SOURCE], [
        F.count(F.lit(1)).alias("n"), F.sum(S.PRICE).alias("s"), F.count(S.PRICE).alias("c")])
    return rolled.groupBy(S.SOURCE).agg(
        F.sum("n").alias("samples"),
        X.distinct_incl_null(S.BRAND).alias("brands"),
        F.bround(F.try_divide(F.sum("s"), F.sum("c")), digits).alias("avg_price"))


def source_share(line_df: DataFrame, digits: int = 2) -> DataFrame:
    """Each source's share of all rows, in percent.

    The un-partitioned window runs on the per-source aggregate (a handful of
    rows), never on row-level data.
    """
    counts = line_df.groupBy(S.SOURCE).agg(F.count(F.lit(1)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy())
    return counts.select(S.SOURCE, "samples", X.pct(F.col("samples"), total, digits).alias("share_pct"))


def source_stats(line_df: DataFrame, part_df: DataFrame, digits: int = 2) -> DataFrame:
    """A4: per source count(name), mean/min/max price, distinct brand/colour/gender,
    rounded half-to-even like ``DataFrame.round``."""
    rolled = part_rollup(line_df, part_df, [S.SOURCE], [
        F.count(F.lit(1)).alias("n"), F.sum(S.PRICE).alias("s"), F.count(S.PRICE).alias("c"),
        F.min(S.PRICE).alias("mn"), F.max(S.PRICE).alias("mx")])
    return rolled.groupBy(S.SOURCE).agg(
        F.sum(F.when(F.col(S.NAME).isNotNull(), F.col("n")).otherwise(F.lit(0))).alias("n_products"),
        F.bround(F.try_divide(F.sum("s"), F.sum("c")), digits).alias("avg_price"),
        F.bround(F.min("mn"), digits).alias("min_price"),
        F.bround(F.max("mx"), digits).alias("max_price"),
        F.count_distinct(S.BRAND).alias("n_brands"),
        F.count_distinct(S.COLOR).alias("n_colors"),
        F.count_distinct(S.GENDER).alias("n_genders"))


def pivot_counts(df: DataFrame, row: str, col: str, values: list) -> DataFrame:
    """A5: two-key count, one column per listed value, absent cells 0.

    Values are passed explicitly: no extra job to discover them, and the
    column set does not depend on the data.
    """
    return df.groupBy(row).pivot(col, values).count().na.fill(0, subset=values)


def tier_mix_by_source(line_df: DataFrame, tiers=STANDIN_TIERS) -> DataFrame:
    """A5 on the catalog: DataSource x PriceCategory counts."""
    return pivot_counts(line_df.withColumn(S.TIER, X.price_tier(S.PRICE, *tiers)),
                        S.SOURCE, S.TIER, S.TIERS)


def row_percent(pivoted: DataFrame, key: str, values: list, digits: int = 6) -> DataFrame:
    """Each pivot cell as a percentage of its row total."""
    total = sum((F.col(v) for v in values[1:]), F.col(values[0]))
    return pivoted.select(key, *[X.pct(F.col(v), total, digits).alias(f"{v}_pct") for v in values])


def value_counts(df: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Counts per non-missing value (pandas drops missing keys)."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(n.alias("n"))


def part_value_counts(line_df: DataFrame, part_df: DataFrame, key: str) -> DataFrame:
    """A8 for a part attribute: lines pre-counted per part, then summed per value."""
    rolled = part_rollup(line_df, part_df, [], [F.count(F.lit(1)).alias("n_lines")])
    return (rolled.filter(F.col(key).isNotNull()).groupBy(key)
                  .agg(F.sum("n_lines").alias("n")))


def top_values(counts: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values; ties broken by value ascending."""
    return counts.orderBy(F.desc("n"), F.asc(key)).limit(n)


def class_balance(counts: DataFrame, digits: int = 6) -> DataFrame:
    """1 - sd(counts) / mean(counts) (sample deviation, as ``Series.std``)."""
    return counts.agg(F.bround(F.lit(1.0) - F.try_divide(F.stddev_samp("n"), F.avg("n")),
                               digits).alias("balance_score"))


def quality_indicators(line_df: DataFrame, part_df: DataFrame, tiers=STANDIN_TIERS,
                       digits: int = 6) -> DataFrame:
    """A9 + A10 in one row: class balance and brand diversity.

    The tier counts (three values) are folded into the same aggregate instead
    of a second pass over a value_counts table: the sample sd and mean of the
    non-empty tier counts are computed in plain arithmetic.
    """
    rolled = part_rollup(line_df, part_df, [], [
        F.count(F.lit(1)).alias("n"), *_tier_counts(tiers)])
    agg = rolled.agg(
        F.sum("n").alias("n_rows"),
        X.distinct_incl_null(S.BRAND).alias("n_brands"),
        *[F.sum(f"n_{v.lower()}").alias(f"n_{v.lower()}") for v in S.TIERS])
    # class balance over the non-empty tiers (value_counts lists only those)
    cnts = [F.col(f"n_{v.lower()}") for v in S.TIERS]
    present = [F.when(c > 0, 1).otherwise(0) for c in cnts]
    k = present[0] + present[1] + present[2]
    mean = F.try_divide(cnts[0] + cnts[1] + cnts[2], k)
    sq = [F.when(c > 0, (c - mean) * (c - mean)).otherwise(0.0) for c in cnts]
    var = F.try_divide(sq[0] + sq[1] + sq[2], k - 1)
    return agg.select(
        F.bround(F.lit(1.0) - F.try_divide(F.sqrt(var), mean), digits).alias("balance_score"),
        F.bround(X.ratio(F.col("n_brands"), F.col("n_rows")), digits).alias("brand_diversity"),
        "n_rows")


def price_spread(line_df: DataFrame, digits: int = 4) -> DataFrame:
    """Sample standard deviation of price."""
    return line_df.agg(F.bround(F.stddev_samp(S.PRICE), digits).alias("price_std"))


def weighted_share(df: DataFrame, key: str, weight: str, digits: int = 6) -> DataFrame:
    """Per key the summed weight and its share of the total (pie values)."""
    sums = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum(weight).alias("total"))
    grand = F.sum("total").over(Window.partitionBy())
    return sums.select(key, "total", X.pct(F.col("total"), grand, digits).alias("share_pct"))


def histogram(df: DataFrame, x: str, n_bins: int, by: list | None = None,
              digits: int = 6) -> DataFrame:
    """A13/A15/A16 (and A14 with ``by``): equal-width bins over [min, max].

    Without ``by`` the range comes from scalar subqueries (merged into one
    aggregate by Catalyst). With ``by`` each group gets its own range from a
    per-group aggregate, which adaptive execution broadcasts where its size,
    known by then, allows it. Only non-empty bins are returned.
    """
    vals = df.filter(F.col(x).isNotNull() & ~F.isnan(F.col(x)))
    by = list(by or [])
    if by:
        rng = vals.groupBy(*by).agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
        vals = vals.join(rng, by, "inner")
        lo, hi = F.col("_lo"), F.col("_hi")
    else:
        lo = vals.select(F.min(x)).scalar()
        hi = vals.select(F.max(x)).scalar()
        vals = vals.withColumns({"_lo": lo, "_hi": hi})
        lo, hi = F.col("_lo"), F.col("_hi")
    binned = vals.withColumn("bin", X.equal_width_bin(F.col(x), lo, hi, n_bins))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(n_bins))
    out = binned.groupBy(*by, "bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select(
        *by, "bin",
        F.bround(F.col("_lo") + (F.col("bin") - 1) * width, digits).alias("bin_lo"),
        F.bround(F.col("_lo") + F.col("bin") * width, digits).alias("bin_hi"),
        "n")


def split_class_counts(df: DataFrame, label: str, split_col: str = "split") -> DataFrame:
    """Per class, train and test counts side by side, zero-filled."""
    return df.groupBy(label).agg(
        F.count_if(F.col(split_col) == "train").alias("n_train"),
        F.count_if(F.col(split_col) == "test").alias("n_test"))


def first_per_class(df: DataFrame, label: str, order_key: str) -> DataFrame:
    """The first row (smallest key) of every class, via ``min_by``.

    An aggregate, not a window: partial aggregation keeps one candidate per
    class per task, so a class holding a third of all rows costs nothing extra.
    """
    others = [c for c in df.columns if c not in (label, order_key)]
    rec = F.struct(*[F.col(c) for c in [order_key] + others])
    return (df.groupBy(label).agg(F.min_by(rec, F.col(order_key)).alias("r"))
              .select(label, *[F.col(f"r.{c}").alias(c) for c in [order_key] + others]))
