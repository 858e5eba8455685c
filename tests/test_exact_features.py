"""Exact split, distributed codes, covariance and axes against plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog_engine.operators import features as FE
from catalog_engine.operators import stats


@pytest.mark.parametrize("n,share", [(0, 0.2), (1, 0.2), (10, 0.0), (10, 1.0), (997, 0.2), (997, 0.333)])
def test_exact_split_size(spark, monkeypatch, n, share):
    monkeypatch.setattr(FE, "LAST_ROWS", 2)  # refine to the end
    df = spark.range(n, numPartitions=3)
    out = FE.exact_split(df, ["id"], share)
    digests = sorted((r.d, r.id) for r in df.select("id", FE.split_digest(["id"]).alias("d")).collect())
    wanted = {i for _, i in digests[:math.ceil(share * n)]}
    assert {r.id for r in out.where("split = 'test'").collect()} == wanted and out.count() == n
    assert {r.id for r in FE.exact_split(df.repartition(7), ["id"], share).where("split = 'test'").collect()} == wanted


def test_rows_that_repeat_the_cut_go_with_it(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 50, "k long")
    assert FE.exact_split(df, ["k"], 0.2).where("split = 'test'").count() == 50


def test_positions_over_many_ranges(spark):
    values = [f"v{i * 7919 % 10007:05d}" for i in range(5000)] + [None, "v00000", "Ünï", ""]
    df = spark.createDataFrame([(v,) for v in values], "c string").repartition(6)
    got = {r.c: r.c_ix for r in FE.label_codes(df, "c").collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}, key=lambda v: v.encode()))}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {r.c: r.c_ix for r in FE.label_codes(df, "c").collect()} == got
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert FE.label_codes(df.limit(0), "c").collect() == []


def test_covariance_and_axes(spark):
    rng = np.random.default_rng(1)
    whole = rng.integers(-50, 50, (200, 3))
    whole[:, 2] = whole[:, 0] * 3 - whole[:, 1]
    rows = [tuple(int(v) for v in r) for r in whole]
    df = spark.createDataFrame([*rows, (1, None, 2)], "a int, b int, c int").repartition(3)
    for frame in (df, df.select(*[F.col(c).cast("double") for c in "abc"])):
        entries = FE.covariance(frame, ["a", "b", "c"])
        expected = np.cov(whole.T)
        assert {(r.i, r.j): r.covariance for r in entries.collect()} == pytest.approx(
            {("abc"[i], "abc"[j]): expected[i, j] for i in range(3) for j in range(i, 3)})
        axes = FE.principal_axes(entries, ["a", "b", "c"])
        assert axes @ axes.T == pytest.approx(np.eye(2), abs=1e-9) and all(a[np.abs(a).argmax()] > 0 for a in axes)
        out = FE.project(frame, ["a", "b", "c"], axes).na.drop().select("pc1", "pc2").toPandas().to_numpy()
        assert sorted(out[:, 0]) == pytest.approx(sorted((whole - whole.mean(axis=0)) @ axes[0]))
        assert np.cov(out.T) == pytest.approx(np.diag(np.linalg.eigvalsh(expected)[::-1][:2]), abs=1e-6)
    assert all(r.covariance is None for r in FE.covariance(df.limit(0), ["a", "b"]).collect())


def test_histogram_by_many_groups(spark):
    df = spark.range(1000).select((F.col("id") % 200).alias("g"), F.col("id").cast("double").alias("x"))
    out = stats.histogram(df, "x", 4, by=["g"])
    assert out.agg(F.sum("n")).first()[0] == 1000 and out.select("g").distinct().count() == 200
