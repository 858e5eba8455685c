"""Declared schemas and column names of the catalog data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Catalog column names. The reference calls the price column "Price (INR)";
# Parquet and SQL handle a plain name better, so it is ``Price`` here and the
# CSV reader renames it on the way in.
PRODUCT_ID = "product_id"
NAME = "ProductName"
BRAND = "ProductBrand"
GENDER = "Gender"
COLOR = "PrimaryColor"
PRICE = "Price"
IMAGES = "NumImages"
SOURCE = "DataSource"
TIER = "PriceCategory"
CUSTOMERS = "ExpectedCustomers"
RATE = "ConversionRate"
SALES = "ExpectedSales"
REVENUE = "ExpectedRevenue"

# Price tiers, in the order every report uses (never alphabetical).
TIERS = ["Low", "Medium", "High"]

CATALOG_SCHEMA = T.StructType([
    T.StructField(PRODUCT_ID, T.StringType(), False),
    T.StructField(NAME, T.StringType()),
    T.StructField(BRAND, T.StringType()),
    T.StructField(GENDER, T.StringType()),
    T.StructField(COLOR, T.StringType()),
    T.StructField(PRICE, T.DoubleType()),
    T.StructField(IMAGES, T.IntegerType()),
    T.StructField(SOURCE, T.StringType()),
    T.StructField(TIER, T.StringType()),
    T.StructField(CUSTOMERS, T.IntegerType()),
    T.StructField(RATE, T.DoubleType()),
    T.StructField(SALES, T.IntegerType()),
    T.StructField(REVENUE, T.DoubleType()),
])

# Schema of a raw catalog CSV as the reference reads it (header row).
RAW_CATALOG_CSV_SCHEMA = T.StructType([
    T.StructField("ProductID", T.LongType()),
    T.StructField("ProductName", T.StringType()),
    T.StructField("ProductBrand", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Price (INR)", T.DoubleType()),
    T.StructField("NumImages", T.IntegerType()),
    T.StructField("Description", T.StringType()),
    T.StructField("PrimaryColor", T.StringType()),
])

# Images: one row per picture, pixels row-major and already flat.
IMAGE_SCHEMA = T.StructType([
    T.StructField("image_id", T.StringType(), False),
    T.StructField("label", T.IntegerType()),
    T.StructField("pixels", T.ArrayType(T.DoubleType())),
])

PREDICTION_SCHEMA = T.StructType([
    T.StructField(PRODUCT_ID, T.StringType(), False),
    T.StructField("label", T.StringType()),
    T.StructField("prediction", T.StringType()),
    T.StructField("probability", T.ArrayType(T.DoubleType())),
])
