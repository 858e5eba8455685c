"""Randomised properties: histogram bins against NumPy, tiers against plain Python."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from catalog_engine.functions import exprs as X
from catalog_engine.operators import stats

floats = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(floats, min_size=1, max_size=60), st.integers(min_value=1, max_value=12))
def test_histogram_matches_numpy(spark, xs, n):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    got = {r.bin: r.n for r in stats.histogram(df, "x", n).collect()}
    lo, hi = min(xs), max(xs)
    if lo == hi:
        assert got == {1: len(xs)}
        return
    a = np.array(xs, dtype=np.float64)
    bins = np.minimum(np.floor((a - lo) / (hi - lo) * float(n)).astype(np.int64) + 1, n)
    want = {int(b): int(c) for b, c in zip(*np.unique(bins, return_counts=True))}
    assert got == want
    # and against NumPy's own histogram away from inner edges: same totals, closed last bin
    counts, _ = np.histogram(a, bins=n, range=(lo, hi))
    assert sum(got.values()) == int(counts.sum()) == len(xs)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), floats), min_size=1, max_size=40))
def test_tier_matches_python(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "p double")
    got = [r[0] for r in df.select(X.price_tier("p", 500.0, 1500.0)).collect()]
    want = ["Low" if x is not None and x <= 500 else
            "Medium" if x is not None and x <= 1500 else "High" for x in xs]
    assert got == want
