"""Catalog queries: scans, derived columns, aggregates, top-k, reshaping, joins.

Each query reads the whole driver tables; its DuckDB twin defines the same
catalog view (``catalog_sql``) and computes the same columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators import reshape, rules, stats, topk, transforms
from catalog_engine.plans import fixtures
from catalog_engine.plans.registry import register
from catalog_engine.sources import catalog as C
from catalog_engine.sources import generated

W = "WITH " + C.catalog_sql()


def _lp(spark, d):
    return C.lines(spark, d), C.parts(spark, d)


def _nd(c: str) -> str:
    """SQL: distinct values of c, counting a missing value as one."""
    return f"(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END))"


# ---------------------------------------------------------------- aggregates

@register("a1_catalog_stats", f"""{W}
SELECT count(*) AS n_rows, {_nd('ProductBrand')} AS n_brands, {_nd('Gender')} AS n_genders,
       {_nd('PrimaryColor')} AS n_colors, round_even(avg(Price), 6) AS avg_price,
       min(Price) AS min_price, max(Price) AS max_price,
       {Q.pct("count_if(PriceCategory = 'Low')", 'count(*)', 6)} AS pct_low,
       {Q.pct("count_if(PriceCategory = 'Medium')", 'count(*)', 6)} AS pct_medium,
       {Q.pct("count_if(PriceCategory = 'High')", 'count(*)', 6)} AS pct_high
FROM catalog""")
def a1_catalog_stats(spark, d):
    return stats.catalog_stats(*_lp(spark, d))


@register("a2_source_descriptor", f"""{W}
SELECT DataSource, count(*) AS samples, {_nd('ProductBrand')} AS brands,
       round_even(avg(Price), 6) AS avg_price
FROM catalog GROUP BY DataSource""")
def a2_source_descriptor(spark, d):
    return stats.source_descriptor(*_lp(spark, d))


@register("a3_source_share", f"""{W}
SELECT DataSource, samples, {Q.pct('samples', 'sum(samples) OVER ()', 2)} AS share_pct
FROM (SELECT DataSource, count(*) AS samples FROM catalog GROUP BY DataSource)""")
def a3_source_share(spark, d):
    return stats.source_share(C.lines(spark, d))


@register("a4_source_stats", f"""{W}
SELECT DataSource, count(ProductName) AS n_products, round_even(avg(Price), 2) AS avg_price,
       round_even(min(Price), 2) AS min_price, round_even(max(Price), 2) AS max_price,
       count(DISTINCT ProductBrand) AS n_brands, count(DISTINCT PrimaryColor) AS n_colors,
       count(DISTINCT Gender) AS n_genders
FROM catalog GROUP BY DataSource""")
def a4_source_stats(spark, d):
    return stats.source_stats(*_lp(spark, d))


_PIVOT_SQL = f"""{W}
, pv AS (SELECT DataSource, CAST(count_if(PriceCategory = 'Low') AS BIGINT) AS Low,
         CAST(count_if(PriceCategory = 'Medium') AS BIGINT) AS Medium,
         CAST(count_if(PriceCategory = 'High') AS BIGINT) AS High
  FROM catalog GROUP BY DataSource)"""


@register("a5_tier_by_source", _PIVOT_SQL + " SELECT * FROM pv")
def a5_tier_by_source(spark, d):
    return stats.tier_mix_by_source(C.lines(spark, d))


@register("a6_tier_by_source_pct", _PIVOT_SQL + f"""
SELECT DataSource, {Q.pct('Low', 'Low + Medium + High', 6)} AS Low_pct,
       {Q.pct('Medium', 'Low + Medium + High', 6)} AS Medium_pct,
       {Q.pct('High', 'Low + Medium + High', 6)} AS High_pct FROM pv""")
def a6_tier_by_source_pct(spark, d):
    return stats.row_percent(stats.tier_mix_by_source(C.lines(spark, d)), S.SOURCE, S.TIERS)


@register("a8_tier_counts", f"""{W}
SELECT PriceCategory, count(*) AS n FROM catalog WHERE PriceCategory IS NOT NULL
GROUP BY PriceCategory""")
def a8_tier_counts(spark, d):
    return stats.value_counts(C.with_tier(C.lines(spark, d)), S.TIER)


@register("a8_gender_counts", f"""{W}
SELECT Gender, count(*) AS n FROM catalog WHERE Gender IS NOT NULL GROUP BY Gender""")
def a8_gender_counts(spark, d):
    return stats.part_value_counts(*_lp(spark, d), S.GENDER)


@register("a9_class_balance", f"""{W}
SELECT round_even(1 - stddev_samp(n) / avg(n), 6) AS balance_score
FROM (SELECT PriceCategory, count(*) AS n FROM catalog GROUP BY PriceCategory)""")
def a9_class_balance(spark, d):
    return stats.class_balance(stats.value_counts(C.with_tier(C.lines(spark, d)), S.TIER))


@register("a10_quality_indicators", f"""{W}
, t AS (SELECT PriceCategory, count(*) AS n FROM catalog GROUP BY PriceCategory)
SELECT (SELECT round_even(1 - stddev_samp(n) / avg(n), 6) FROM t) AS balance_score,
       round_even({Q.ratio(_nd('ProductBrand'), 'count(*)')}, 6) AS brand_diversity,
       count(*) AS n_rows
FROM catalog""")
def a10_quality_indicators(spark, d):
    return stats.quality_indicators(*_lp(spark, d))


@register("a11_price_spread", f"""{W}
SELECT round_even(stddev_samp(Price), 4) AS price_std FROM catalog""")
def a11_price_spread(spark, d):
    return stats.price_spread(C.lines(spark, d))


@register("a12_sales_share_by_tier", f"""{W}
SELECT PriceCategory, total, {Q.pct('total', 'sum(total) OVER ()', 6)} AS share_pct
FROM (SELECT PriceCategory, CAST(sum(ExpectedSales) AS BIGINT) AS total FROM catalog
      WHERE PriceCategory IS NOT NULL GROUP BY PriceCategory)""")
def a12_sales_share_by_tier(spark, d):
    return stats.weighted_share(C.enrich(C.lines(spark, d)), S.TIER, S.SALES)


def _hist_sql(x: str, n: int, src: str = "catalog") -> str:
    width = f"((hi - lo) / {Q.dbl(n)})"
    return f"""
, v AS (SELECT {x} AS x FROM {src} WHERE {x} IS NOT NULL AND NOT isnan({x})),
r AS (SELECT min(x) AS lo, max(x) AS hi FROM v),
b AS (SELECT {Q.equal_width_bin('x', 'lo', 'hi', n)} AS bin, lo, hi FROM v, r)
SELECT bin, round_even(lo + (bin - 1) * {width}, 6) AS bin_lo,
       round_even(lo + bin * {width}, 6) AS bin_hi, count(*) AS n
FROM b GROUP BY bin, lo, hi"""


@register("a15_price_histogram", W + _hist_sql("Price", 50))
def a15_price_histogram(spark, d):
    return stats.histogram(C.lines(spark, d), S.PRICE, 50)


@register("a16_images_histogram", W + _hist_sql("CAST(NumImages AS DOUBLE)", 20))
def a16_images_histogram(spark, d):
    df = C.lines(spark, d).withColumn("x", F.col(S.IMAGES).cast("double"))
    return stats.histogram(df, "x", 20)


# ---------------------------------------------------------------- top-k

_ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, Price"


@register("t1_top_revenue", f"""{W}
SELECT product_id, ProductName, Price, ExpectedCustomers, ExpectedSales, ExpectedRevenue
FROM catalog ORDER BY ExpectedRevenue DESC NULLS LAST, product_id, {_ORDER_SQL} LIMIT 10""")
def t1_top_revenue(spark, d):
    return topk.top_revenue(C.enrich(C.lines(spark, d)), C.parts(spark, d), 10)


@register("t2_top_brands", f"""{W}
SELECT ProductBrand, count(*) AS n FROM catalog WHERE ProductBrand IS NOT NULL
GROUP BY ProductBrand ORDER BY n DESC, ProductBrand LIMIT 15""")
def t2_top_brands(spark, d):
    return stats.top_values(stats.part_value_counts(*_lp(spark, d), S.BRAND), S.BRAND, 15)


@register("t3_top_colors", f"""{W}
SELECT PrimaryColor, count(*) AS n FROM catalog WHERE PrimaryColor IS NOT NULL
GROUP BY PrimaryColor ORDER BY n DESC, PrimaryColor LIMIT 10""")
def t3_top_colors(spark, d):
    return stats.top_values(stats.part_value_counts(*_lp(spark, d), S.COLOR), S.COLOR, 10)


@register("t6_hash_sample", f"""{W}
SELECT product_id, Price, PriceCategory FROM catalog
ORDER BY {Q.hash_unit('product_id', 2869860233)}, product_id, {_ORDER_SQL} LIMIT 25""")
def t6_hash_sample(spark, d):
    return topk.hash_sample(C.with_tier(C.lines(spark, d)), 25,
                            [S.PRODUCT_ID, S.PRICE, S.TIER])


@register("t7_first_rows", f"""{W}
SELECT product_id, ProductName, ProductBrand, Gender, PrimaryColor, Price, NumImages,
       DataSource, PriceCategory
FROM catalog ORDER BY product_id, {_ORDER_SQL} LIMIT 10""")
def t7_first_rows(spark, d):
    return topk.first_rows(C.with_tier(C.lines(spark, d)), C.parts(spark, d), 10)


# ---------------------------------------------------------------- row-level

@register("p1_p3_labelled_catalog", f"""{W}
SELECT product_id, l_orderkey, l_linenumber, Price, PrimaryColor, PriceCategory
FROM catalog WHERE PrimaryColor IS NOT NULL""")
def p1_p3_labelled_catalog(spark, d):
    cat = C.catalog(spark, d)
    return transforms.drop_missing(cat, [S.COLOR]).select(
        S.PRODUCT_ID, "l_orderkey", "l_linenumber", S.PRICE, S.COLOR, S.TIER)


@register("p8_p10_expected_sales", f"""{W}
SELECT product_id, l_orderkey, l_linenumber, DataSource, ExpectedCustomers, ConversionRate,
       ExpectedSales, ExpectedRevenue FROM catalog""")
def p8_p10_expected_sales(spark, d):
    return C.with_expected(C.lines(spark, d)).select(
        S.PRODUCT_ID, "l_orderkey", "l_linenumber", S.SOURCE, S.CUSTOMERS, S.RATE,
        S.SALES, S.REVENUE)


@register("p11_tier_counts_one_pass", f"""{W}
SELECT CAST(count_if(PriceCategory = 'Low') AS BIGINT) AS n_low,
       CAST(count_if(PriceCategory = 'Medium') AS BIGINT) AS n_medium,
       CAST(count_if(PriceCategory = 'High') AS BIGINT) AS n_high FROM catalog""")
def p11_tier_counts_one_pass(spark, d):
    return transforms.tier_counts(C.with_tier(C.lines(spark, d)))


@register("p17_distinct_colors", f"""{W}
SELECT DISTINCT PrimaryColor FROM catalog""")
def p17_distinct_colors(spark, d):
    return transforms.distinct_part_values(*_lp(spark, d), S.COLOR)


@register("p20_plot_projection", f"""{W}
SELECT product_id, ProductBrand, NumImages, Price, PriceCategory FROM catalog""")
def p20_plot_projection(spark, d):
    return C.catalog(spark, d).select(S.PRODUCT_ID, S.BRAND, S.IMAGES, S.PRICE, S.TIER)


@register("x1_display_formats", f"""{W}
, s AS (SELECT DataSource, count(*) AS n, avg(Price) AS avg_price FROM catalog GROUP BY DataSource)
SELECT DataSource, format('{{:,}}', n) AS n_fmt, printf('%.2f', round_even(avg_price, 2)) AS avg_fmt,
       printf('%.1f%%', {Q.pct('n', 'sum(n) OVER ()', 1)}) AS share_fmt FROM s""")
def x1_display_formats(spark, d):
    return transforms.display_formats(C.lines(spark, d))


# ---------------------------------------------------------------- union, reshape, joins

def _pick_sql(key: str, mult: int, choices: list) -> str:
    return (f"[{Q.sql_list(choices)}][CAST(floor({Q.hash_unit(key, mult)} * "
            f"{Q.dbl(len(choices))}) AS INTEGER) + 1]")


@register("s4_generated_source", f"""
SELECT p_partkey AS product_id, printf('HM%06d', p_partkey) AS product_code,
       'Fashion Item ' || CAST(p_partkey AS VARCHAR) AS product_name,
       {_pick_sql('p_partkey', 2654435761, generated.BRANDS)} AS brand,
       {_pick_sql('p_partkey', generated.MULT_GENDER, generated.GENDERS)} AS gender,
       {_pick_sql('p_partkey', generated.MULT_COLOR, generated.COLORS)} AS color,
       {Q.uniform_double('p_partkey', 2246822519, *generated.PRICE_RANGE)} AS price,
       {Q.uniform_int('p_partkey', 3266489917, *generated.IMAGE_RANGE)} AS NumImages
FROM part""")
def s4_generated_source(spark, d):
    return generated.generated_source(C.read_table(spark, d, "part"))


@register("u1_unified_sources", f"""{W}
SELECT product_id, ProductName, ProductBrand,
       CASE WHEN Gender = 'PROMO' THEN 'STANDARD' WHEN Gender = 'Male' THEN 'Men'
            WHEN Gender = 'Female' THEN 'Women' ELSE Gender END AS Gender,
       PrimaryColor, Price,
       coalesce(CASE WHEN DataSource IN ('A', 'N') THEN NumImages END, 1) AS NumImages,
       DataSource, PriceCategory,
       CASE WHEN DataSource = 'A' THEN printf('HM%06d', l_partkey) END AS product_code
FROM catalog""")
def u1_unified_sources(spark, d):
    return transforms.unified_sources(C.with_tier(C.lines(spark, d)), C.parts(spark, d))


@register("u4_source_stats_long", f"""{W}
, s AS (SELECT DataSource, CAST(count(ProductName) AS DOUBLE) AS n_products,
        round_even(avg(Price), 2) AS avg_price, round_even(min(Price), 2) AS min_price,
        round_even(max(Price), 2) AS max_price FROM catalog GROUP BY DataSource)
UNPIVOT s ON n_products, avg_price, min_price, max_price INTO NAME metric VALUE value""")
def u4_source_stats_long(spark, d):
    wide = stats.source_stats(*_lp(spark, d)).select(
        S.SOURCE, F.col("n_products").cast("double").alias("n_products"),
        "avg_price", "min_price", "max_price")
    return reshape.melt(wide, [S.SOURCE], ["n_products", "avg_price", "min_price", "max_price"])


@register("u6_stats_transposed", f"""{W}
, s AS (SELECT CAST(count(*) AS DOUBLE) AS n_rows, round_even(avg(Price), 6) AS avg_price,
        min(Price) AS min_price, max(Price) AS max_price FROM catalog)
UNPIVOT s ON n_rows, avg_price, min_price, max_price INTO NAME metric VALUE value""")
def u6_stats_transposed(spark, d):
    one = stats.catalog_stats(*_lp(spark, d)).select(
        F.col("n_rows").cast("double").alias("n_rows"), "avg_price", "min_price", "max_price")
    return reshape.transpose_row(one)


@register("j1_tier_guide", f"""{W}
, c AS (SELECT PriceCategory, count(*) AS n FROM catalog GROUP BY PriceCategory),
g(PriceCategory, shelf, review_days, margin_floor) AS (VALUES {fixtures.values_sql(fixtures.TIER_GUIDE)})
SELECT c.PriceCategory, c.n, g.shelf, g.review_days, CAST(g.margin_floor AS DOUBLE) AS margin_floor FROM c LEFT JOIN g USING (PriceCategory)""")
def j1_tier_guide(spark, d):
    counts = stats.value_counts(C.with_tier(C.lines(spark, d)), S.TIER)
    return rules.with_guide(counts, spark.createDataFrame(fixtures.TIER_GUIDE, fixtures.TIER_GUIDE_SCHEMA))


@register("j3_top_brand_rows", f"""{W}
, tb AS (SELECT ProductBrand FROM catalog WHERE ProductBrand IS NOT NULL GROUP BY ProductBrand
         ORDER BY count(*) DESC, ProductBrand LIMIT 5)
SELECT product_id, l_orderkey, l_linenumber, ProductBrand, Price FROM catalog
WHERE ProductBrand IN (SELECT ProductBrand FROM tb)""")
def j3_top_brand_rows(spark, d):
    lines, parts = _lp(spark, d)
    top = stats.top_values(stats.part_value_counts(lines, parts, S.BRAND), S.BRAND, 5)
    return transforms.rows_with_selected(lines, parts, top.select(S.BRAND), S.BRAND).select(
        S.PRODUCT_ID, "l_orderkey", "l_linenumber", S.BRAND, S.PRICE)


@register("d2_quality_advice", f"""{W}
, t AS (SELECT PriceCategory, count(*) AS n FROM catalog GROUP BY PriceCategory),
q AS (SELECT (SELECT 1 - stddev_samp(n) / avg(n) FROM t) AS balance,
      {Q.ratio(_nd('ProductBrand'), 'count(*)')} AS diversity, count(*) AS n_rows FROM catalog)
SELECT balance < 0.8 AS imbalance,
       diversity < 0.1 AS low_brand_diversity, n_rows < 1000 AS too_few_rows,
       NOT (balance < 0.8 OR diversity < 0.1 OR n_rows < 1000) AS ok
FROM q""")
def d2_quality_advice(spark, d):
    return rules.quality_advice(stats.quality_indicators(*_lp(spark, d), digits=15)).select(
        "imbalance", "low_brand_diversity", "too_few_rows", "ok")


@register("p12_update_where", f"""{W}
SELECT product_id, PriceCategory, CASE WHEN PriceCategory = 'High' THEN 1 ELSE NumImages END AS NumImages
FROM catalog""")
def p12_update_where(spark, d):
    tiered = C.with_tier(C.lines(spark, d))
    out = transforms.update_where(tiered, S.IMAGES, F.col(S.TIER) == "High", F.lit(1))
    return out.select(S.PRODUCT_ID, S.TIER, S.IMAGES)


@register("p16_relabel", f"""{W}
SELECT DataSource AS shop, count(*) AS products, max(Price) AS top_price FROM catalog GROUP BY DataSource""")
def p16_relabel(spark, d):
    per = C.lines(spark, d).groupBy(S.SOURCE).agg(F.count(F.lit(1)), F.max(S.PRICE))
    return transforms.relabel(per, ["shop", "products", "top_price"])
