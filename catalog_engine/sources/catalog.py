"""The catalog as a view over the driver's tables, plus its derived columns.

Stand-in mapping (one catalog row per order line):

    product_id   l_orderkey-l_partkey-l_linenumber (text)
    ProductName  p_name            ProductBrand  p_brand
    Gender       p_type            PrimaryColor  first word of p_name
    Price        l_extendedprice   NumImages     int(l_quantity)
    DataSource   l_returnflag

Design for scale: the line side is the big one, the part side a dimension
that still grows with the data (not broadcast by hand). Queries that need
only line columns never join; queries that need part attributes
pre-aggregate the lines by part key first (``part_rollup``) so a hot part key
collapses map-side before any exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q

# Per-source ranges of ExpectedCustomers [lo, hi) and
# ConversionRate [lo, hi). The first three stand for the three retail
# sources (keyed by the stand-in source flag); the last range applies to any
# other source.
SOURCE_RANGES = {
    "A": (50, 5000, 0.01, 0.25),
    "N": (30, 3000, 0.02, 0.20),
    "R": (40, 4000, 0.015, 0.30),
}
DEFAULT_RANGE = (25, 2500, 0.01, 0.35)

# Tier thresholds. The reference uses 500 / 1500 for its base
# catalog (50 / 150 for single sources); on the stand-in prices the
# equivalent cut points are 35000 / 70000.
REFERENCE_TIERS = (500.0, 1500.0)
SINGLE_SOURCE_TIERS = (50.0, 150.0)
STANDIN_TIERS = (35000.0, 70000.0)

LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Sort key that makes ties deterministic: rows may repeat a product_id.
ROW_ORDER = [S.PRODUCT_ID, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.PRICE]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def product_id_expr() -> Column:
    """The three keys as text: no packing that larger keys could overflow."""
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_linenumber")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line-side catalog columns (no join)."""
    li = read_table(spark, sf_dir, "lineitem")
    return li.select(
        product_id_expr().alias(S.PRODUCT_ID),
        *LINE_KEYS,
        X.nan_to_null("l_extendedprice").alias(S.PRICE),
        F.col("l_quantity").cast("int").alias(S.IMAGES),
        F.col("l_returnflag").alias(S.SOURCE),
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part-side catalog attributes, keyed by p_partkey (unique)."""
    p = read_table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        F.col("p_name").alias(S.NAME),
        F.col("p_brand").alias(S.BRAND),
        F.col("p_type").alias(S.GENDER),
        F.split_part(F.col("p_name"), F.lit(" "), F.lit(1)).alias(S.COLOR),
    )


def _by_source(values: dict, default, pick) -> Column:
    expr = None
    for src, rng in values.items():
        cond = F.col(S.SOURCE) == F.lit(src)
        expr = F.when(cond, pick(rng)) if expr is None else expr.when(cond, pick(rng))
    return expr.otherwise(pick(default))


def with_tier(df: DataFrame, tiers=STANDIN_TIERS) -> DataFrame:
    return df.withColumn(S.TIER, X.price_tier(S.PRICE, *tiers))


def with_expected(df: DataFrame, ranges: dict = SOURCE_RANGES,
                  default=DEFAULT_RANGE) -> DataFrame:
    """ExpectedCustomers, ConversionRate, ExpectedSales, ExpectedRevenue.

    Seeded per product key (not per row position) so the values do not
    depend on partitioning or row order.
    """
    pid = F.col(S.PRODUCT_ID)
    cust = _by_source(ranges, default,
                      lambda r: X.uniform_int(pid, X.MULT_CUSTOMERS, r[0], r[1]))
    rate = _by_source(ranges, default,
                      lambda r: X.uniform_double(pid, X.MULT_RATE, r[2], r[3]))
    return (df.withColumns({S.CUSTOMERS: cust, S.RATE: rate})
              .withColumn(S.SALES, (F.col(S.CUSTOMERS) * F.col(S.RATE)).cast("int"))
              .withColumn(S.REVENUE, F.col(S.SALES) * F.col(S.PRICE)))


def enrich(df: DataFrame, tiers=STANDIN_TIERS) -> DataFrame:
    return with_expected(with_tier(df, tiers))


def catalog(spark: SparkSession, sf_dir: str, tiers=STANDIN_TIERS,
            with_part: bool = True) -> DataFrame:
    """The full labelled catalog (one row per product).

    The part join is a left join on the part's primary key, so leaving it
    out (``with_part=False``) never changes the row set.
    """
    li = enrich(lines(spark, sf_dir), tiers)
    if not with_part:
        return li
    return (li.join(parts(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"), "left")
              .drop("p_partkey"))


def part_rollup(line_df: DataFrame, part_df: DataFrame, keys: list, aggs: list) -> DataFrame:
    """Aggregate lines per (part key, *keys) and attach part attributes.

    The partial aggregate runs before the exchange, so a part key holding a
    large share of all lines is reduced map-side, and the join then sees at
    most one row per (part, key) instead of one per line.
    """
    rolled = line_df.groupBy("l_partkey", *keys).agg(*aggs)
    return rolled.join(part_df, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")


def catalog_facts(line_df: DataFrame, part_df: DataFrame, tiers=STANDIN_TIERS,
                  digits: int = 6) -> DataFrame:
    """A23 catalog part: distinct brand/gender/colour (missing counts as one),
    mean price and tier percentages, via one pre-aggregated pass."""
    t = X.price_tier(S.PRICE, *tiers)
    rolled = part_rollup(line_df, part_df, [], [
        F.count(F.lit(1)).alias("n"), F.sum(S.PRICE).alias("s"), F.count(S.PRICE).alias("c"),
        *[F.count_if(t == F.lit(v)).alias(f"n_{v.lower()}") for v in S.TIERS]])
    tier_sums = [f"n_{v.lower()}" for v in S.TIERS]
    # distinct values are counted over the few combinations of attributes, not over the parts
    small = rolled.groupBy(S.BRAND, S.GENDER, S.COLOR).agg(*[F.sum(c).alias(c) for c in ("n", "s", "c", *tier_sums)])
    n = F.sum("n")
    return small.agg(
        X.distinct_incl_null(S.BRAND).alias("n_brands"),
        X.distinct_incl_null(S.GENDER).alias("n_genders"),
        X.distinct_incl_null(S.COLOR).alias("n_colors"),
        F.bround(F.try_divide(F.sum("s"), F.sum("c")), digits).alias("avg_price"),
        *[X.pct(F.sum(c), n, digits).alias(f"pct_{v.lower()}") for c, v in zip(tier_sums, S.TIERS, strict=True)])


# --------------------------------------------------------------------------
# The same view in DuckDB SQL, for oracle queries.

def _sql_by_source(pick) -> str:
    whens = " ".join(f"WHEN l_returnflag = '{s}' THEN {pick(r)}" for s, r in SOURCE_RANGES.items())
    return f"CASE {whens} ELSE {pick(DEFAULT_RANGE)} END"


def catalog_sql(tiers=STANDIN_TIERS) -> str:
    """``WITH`` body defining ``catalog`` with the same columns as ``catalog()``."""
    pid = "concat_ws('-', l_orderkey, l_partkey, l_linenumber)"
    cust = _sql_by_source(lambda r: Q.uniform_int(pid, X.MULT_CUSTOMERS, r[0], r[1]))
    rate = _sql_by_source(lambda r: Q.uniform_double(pid, X.MULT_RATE, r[2], r[3]))
    price = "CASE WHEN isnan(l_extendedprice) THEN NULL ELSE l_extendedprice END"
    return f"""
catalog_base AS (
  SELECT {pid} AS product_id, l_orderkey, l_linenumber, l_partkey, l_suppkey,
         {price} AS Price,
         CAST(trunc(l_quantity) AS INTEGER) AS NumImages,
         l_returnflag AS DataSource,
         {cust} AS ExpectedCustomers,
         {rate} AS ConversionRate,
         p_name AS ProductName, p_brand AS ProductBrand, p_type AS Gender,
         split_part(p_name, ' ', 1) AS PrimaryColor
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
),
catalog AS (
  SELECT *, {Q.price_tier('Price', *tiers)} AS PriceCategory,
         CAST(trunc(ExpectedCustomers * ConversionRate) AS INTEGER) AS ExpectedSales,
         CAST(trunc(ExpectedCustomers * ConversionRate) AS INTEGER) * Price AS ExpectedRevenue
  FROM catalog_base
)"""
