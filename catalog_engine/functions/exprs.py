"""Column expressions shared by the operators.

Everything here is a built-in Spark expression, so it stays inside
whole-stage codegen. Each helper that an oracle query needs has a twin in
``catalog_engine.functions.sqltext`` producing the same value in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seeds of the hash draws, one for each derived column so that draws do not
# correlate.
MULT_CUSTOMERS = 2654435761
MULT_RATE = 2246822519
MULT_SPLIT = 3266489917
MULT_SAMPLE = 2869860233
#: Hexadecimal digits of a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c) -> Column:
    """pandas skips NaN in count/mean/min/max; Spark does not, so NaN -> NULL."""
    c = col(c)
    return F.when(~F.isnan(c), c)


def price_tier(price, lo: float, hi: float) -> Column:
    """Low if x <= lo, Medium if x <= hi, else High. NULL and NaN fall to High."""
    p = col(price)
    return (F.when(p <= F.lit(lo), F.lit("Low"))
            .when(p <= F.lit(hi), F.lit("Medium"))
            .otherwise(F.lit("High")))


def hash_unit(key, seed: int) -> Column:
    """A deterministic draw in [0, 1) from a key of any simple type: the first 52 bits of
    md5(key|seed). Every key has its own draw, however many keys there are."""
    digest = F.md5(F.concat(col(key).cast("string"), F.lit(f"|{seed}")).cast("binary"))
    return F.conv(F.left(digest, F.lit(DRAW_DIGITS)), 16, 10).cast("double") / F.lit(float(16 ** DRAW_DIGITS))


def uniform_int(key, seed: int, lo: int, hi: int) -> Column:
    """Integer draw in [lo, hi), like ``randint(lo, hi)``."""
    return (F.lit(lo) + F.floor(hash_unit(key, seed) * F.lit(float(hi - lo)))).cast("int")


def uniform_double(key, seed: int, lo: float, hi: float) -> Column:
    """Real draw in [lo, hi), like ``uniform(lo, hi)``."""
    return F.lit(lo) + hash_unit(key, seed) * F.lit(hi - lo)


def is_test_row(key, test_share: float, seed: int = MULT_SPLIT) -> Column:
    """Shuffled, unstratified hold-out membership that survives repartitioning."""
    return hash_unit(key, seed) < F.lit(float(test_share))


def distinct_incl_null(c) -> Column:
    """``len(s.unique())``: distinct values, counting a missing value as one."""
    c = col(c)
    return F.count_distinct(c) + F.max(F.when(c.isNull(), 1).otherwise(0))


def ratio(num, den) -> Column:
    """num / den, 0 when den is 0 or NULL (scikit-learn's zero_division=0)."""
    return F.coalesce(F.try_divide(col(num), col(den)), F.lit(0.0))


def pct(num, den, digits: int = 2) -> Column:
    """Percentage rounded half-to-even, as pandas/NumPy ``round`` does."""
    return F.bround(F.lit(100.0) * ratio(num, den), digits)


def equal_width_bin(x, lo, hi, n: int) -> Column:
    """1-based bin of x among n equal bins over [lo, hi]; hi falls in bin n.

    When lo == hi every value lands in bin 1 (no division by zero).
    """
    x, lo, hi = col(x), col(lo), col(hi)
    raw = F.floor((x - lo) / (hi - lo) * F.lit(float(n))).cast("long") + F.lit(1)
    return F.when(hi == lo, F.lit(1).cast("long")).otherwise(F.least(raw, F.lit(n).cast("long")))


def argmax(arr) -> Column:
    """0-based index of the first maximum of an array."""
    a = col(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def softmax(arr) -> Column:
    """Numerically stable soft-max over an array column."""
    a = col(arr)
    m = F.array_max(a)
    e = F.transform(a, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(e, lambda v: v / s)


def array_mean(arrays: list) -> Column:
    """Element-wise mean of equally long array columns (soft vote)."""
    arrays = [col(a) for a in arrays]
    acc = arrays[0]
    for a in arrays[1:]:
        acc = F.zip_with(acc, a, lambda x, y: x + y)
    k = float(len(arrays))
    return F.transform(acc, lambda v: v / F.lit(k))
