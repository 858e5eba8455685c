"""A generated retail source keyed by an existing key column.

The reference simulates retailer catalogs with seeded random choices. Here a
generated source is a projection over a key column of a real table (so it
grows with that table): each choice is an element of a fixed list picked by
a multiplicative hash of the key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import exprs as X

# The first simulated retailer (brands, genders, colours,
# price range [lo, hi), image count range [lo, hi)).
BRANDS = ["H&M", "H&M Premium", "H&M Basic", "H&M Trend"]
GENDERS = ["Men", "Women", "Unisex"]
COLORS = ["Black", "White", "Red", "Blue", "Green", "Gray", "Pink"]
PRICE_RANGE = (200.0, 4000.0)
IMAGE_RANGE = (1, 8)
NAME_PREFIX = "Fashion Item"
CODE_FORMAT = "HM%06d"

MULT_GENDER = 3432918353
MULT_COLOR = 461845907


def pick(key, multiplier: int, choices: list):
    """One of ``choices`` chosen by a hash of ``key``."""
    idx = F.floor(X.hash_unit(key, multiplier) * F.lit(float(len(choices)))).cast("int") + 1
    return F.element_at(F.array(*[F.lit(c) for c in choices]), idx)


def generated_source(table: DataFrame, key: str = "p_partkey") -> DataFrame:
    k = F.col(key)
    return table.select(
        k.alias("product_id"),
        F.format_string(CODE_FORMAT, k).alias("product_code"),
        F.concat(F.lit(NAME_PREFIX + " "), k.cast("string")).alias("product_name"),
        pick(k, X.MULT_CUSTOMERS, BRANDS).alias("brand"),
        pick(k, MULT_GENDER, GENDERS).alias("gender"),
        pick(k, MULT_COLOR, COLORS).alias("color"),
        X.uniform_double(k, X.MULT_RATE, *PRICE_RANGE).alias("price"),
        X.uniform_int(k, X.MULT_SPLIT, *IMAGE_RANGE).alias("NumImages"),
    )
