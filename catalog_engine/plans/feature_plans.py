"""Feature-encoding queries over the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators import features as FE
from catalog_engine.plans.registry import register
from catalog_engine.sources import catalog as C

W = "WITH " + C.catalog_sql()
SPLIT_SQL = f"CASE WHEN {Q.is_test_row('product_id', 0.2, X.MULT_SPLIT)} THEN 'test' ELSE 'train' END"


@register("f9_brand_codes", f"""{W}
SELECT ProductBrand, CAST(dense_rank() OVER (ORDER BY ProductBrand) - 1 AS INTEGER) AS ProductBrand_ix
FROM (SELECT DISTINCT ProductBrand FROM catalog WHERE ProductBrand IS NOT NULL)""")
def f9_brand_codes(spark, d):
    """Codes over the brands that occur in the catalog (distinct part keys first)."""
    keys = C.lines(spark, d).select("l_partkey").distinct()
    brands = keys.join(C.parts(spark, d), F.col("l_partkey") == F.col("p_partkey")).select(S.BRAND)
    return FE.label_codes(brands, S.BRAND)


@register("f15_tier_codes", f"""{W}
, codes AS (SELECT PriceCategory, CAST(dense_rank() OVER (ORDER BY PriceCategory) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT PriceCategory FROM catalog))
SELECT c.PriceCategory, codes.code, count(*) AS n
FROM catalog c JOIN codes USING (PriceCategory) GROUP BY c.PriceCategory, codes.code""")
def f15_tier_codes(spark, d):
    tiered = C.with_tier(C.lines(spark, d))
    counts = tiered.groupBy(S.TIER).agg(F.count(F.lit(1)).alias("n"))
    codes = FE.label_codes(counts, S.TIER, "code")
    return counts.join(F.broadcast(codes), S.TIER).select(S.TIER, "code", "n")


@register("f11_standardized", f"""{W}
, tr AS (SELECT avg(Price) AS mp, stddev_pop(Price) AS sp, avg(NumImages) AS mi,
                stddev_pop(NumImages) AS si FROM catalog WHERE {SPLIT_SQL} = 'train')
SELECT product_id, l_orderkey, l_linenumber,
       round_even(CASE WHEN sp = 0 THEN 0.0 ELSE (Price - mp) / sp END, 6) AS Price_z,
       round_even(CASE WHEN si = 0 THEN 0.0 ELSE (NumImages - mi) / si END, 6) AS NumImages_z
FROM catalog, tr""")
def f11_standardized(spark, d):
    lines = C.lines(spark, d)
    train = lines.filter(~X.is_test_row(S.PRODUCT_ID, 0.2))
    z = FE.standardize(lines, [S.PRICE, S.IMAGES], fit_on=train, digits=6)
    return z.select(S.PRODUCT_ID, "l_orderkey", "l_linenumber", "Price_z", "NumImages_z")


@register("f17_split_by_source", f"""{W}
SELECT DataSource, CAST(count_if({SPLIT_SQL} = 'train') AS BIGINT) AS n_train,
       CAST(count_if({SPLIT_SQL} = 'test') AS BIGINT) AS n_test FROM catalog GROUP BY DataSource""")
def f17_split_by_source(spark, d):
    df = C.lines(spark, d).select(S.SOURCE, FE.split_column(S.PRODUCT_ID, 0.2))
    return df.groupBy(S.SOURCE).agg(F.count_if(F.col("split") == "train").alias("n_train"),
                                    F.count_if(F.col("split") == "test").alias("n_test"))


@register("f10_encode_unseen", f"""{W}
, tr AS (SELECT DISTINCT l_suppkey AS k FROM catalog WHERE {SPLIT_SQL} = 'train' AND DataSource = 'A'),
codes AS (SELECT k, CAST(dense_rank() OVER (ORDER BY k) - 1 AS INTEGER) AS code FROM tr)
SELECT product_id, l_suppkey, coalesce(code, (SELECT CAST(count(*) AS INTEGER) FROM codes)) AS code
FROM catalog LEFT JOIN codes ON l_suppkey = k WHERE {SPLIT_SQL} = 'test'""")
def f10_encode_unseen(spark, d):
    """Supplier codes fitted on one source's training rows, applied to all test rows;
    suppliers that it never saw share the code after the last."""
    df = C.lines(spark, d)
    test = X.is_test_row(S.PRODUCT_ID, 0.2)
    codes = FE.label_codes(df.filter(~test & (F.col(S.SOURCE) == "A")).select("l_suppkey").distinct(), "l_suppkey", "code")
    out = FE.encode(df.filter(test), codes, "l_suppkey", handle_unknown="keep")
    return out.select(S.PRODUCT_ID, "l_suppkey", F.col("code").cast("int").alias("code"))


@register("f9_product_codes", f"""{W}
SELECT product_id, CAST(row_number() OVER (ORDER BY product_id) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT product_id FROM catalog)""")
def f9_product_codes(spark, d):
    """Codes of a column with nearly as many categories as rows."""
    return FE.label_codes(C.lines(spark, d), S.PRODUCT_ID, "code")


SPLIT_KEYS = [S.PRODUCT_ID, "l_suppkey", "cents"]


@register("f17_exact_split", f"""{W}
, keyed AS (SELECT product_id, l_orderkey, l_linenumber, l_suppkey, CAST(round(Price * 100) AS BIGINT) AS cents FROM catalog),
placed AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('-', product_id, CAST(l_suppkey AS VARCHAR), CAST(cents AS VARCHAR))
                                                     || '|{X.MULT_SPLIT}')) AS place, count(*) OVER () AS n FROM keyed)
SELECT product_id, l_orderkey, l_linenumber, l_suppkey, cents, CASE WHEN place <= ceil({Q.dbl(0.2)} * n) THEN 'test' ELSE 'train' END AS split
FROM placed""")
def f17_exact_split(spark, d):
    """Hold-out of exactly ceil(0.2 n) rows."""
    rows = C.lines(spark, d).select(S.PRODUCT_ID, "l_orderkey", "l_linenumber", "l_suppkey",
                                    F.round(F.col(S.PRICE) * 100).cast("long").alias("cents"))
    return FE.exact_split(rows, SPLIT_KEYS, 0.2)


COVARIANCE_COLUMNS = [S.IMAGES, "l_suppkey", "l_linenumber"]


def _covariance_sql(cols) -> str:
    pairs = [(a, b) for k, a in enumerate(cols) for b in cols[k:]]
    return " UNION ALL ".join(
        f"""SELECT '{a}' AS i, '{b}' AS j, (CAST(sum(CAST({a} AS HUGEINT) * {b}) AS DOUBLE) - CAST(sum({a}) AS DOUBLE) * CAST(sum({b}) AS DOUBLE)
            / CAST(count(*) AS DOUBLE)) / (CAST(count(*) AS DOUBLE) - 1) AS covariance FROM catalog""" for a, b in pairs)


@register("f14_covariance", f"{W} {_covariance_sql(COVARIANCE_COLUMNS)}")
def f14_covariance(spark, d):
    return FE.covariance(C.lines(spark, d), COVARIANCE_COLUMNS)


@register("f14_principal_components")
def f14_principal_components(spark, d):
    """Two principal components of every catalog row."""
    rows = C.lines(spark, d)
    axes = FE.principal_axes(FE.covariance(rows, COVARIANCE_COLUMNS), COVARIANCE_COLUMNS)
    return FE.project(rows, COVARIANCE_COLUMNS, axes).select(S.PRODUCT_ID, "pc1", "pc2")
