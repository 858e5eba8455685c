"""Edge fixtures for the carried-over semantics."""

import math

import pytest
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.operators import evaluate as E
from catalog_engine.operators import features as FE
from catalog_engine.operators import stats, transforms


def test_tier_edges_r1_r3(spark):
    rows = [(500.0,), (500.01,), (1500.0,), (1500.01,), (None,), (float("nan"),)]
    df = spark.createDataFrame(rows, "Price double")
    got = [r[0] for r in df.select(X.price_tier("Price", 500.0, 1500.0)).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "High", "High"]


def test_nan_becomes_null_for_stats_r5(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "x double")
    r = df.select(X.nan_to_null("x").alias("x")).agg(F.avg("x"), F.count("x")).first()
    assert r[0] == 2.0 and r[1] == 2


def test_distinct_counts_null_as_value_r4(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "b string")
    r = df.agg(X.distinct_incl_null("b").alias("u"), F.count_distinct("b").alias("nu")).first()
    assert (r.u, r.nu) == (3, 2)


def test_value_counts_drop_missing_keys_r6(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert sorted(tuple(r) for r in stats.value_counts(df, "k").collect()) == [("a", 2)]


def test_half_even_rounding_r8(spark):
    df = spark.createDataFrame([(0.125,), (0.375,)], "x double")
    assert [r[0] for r in df.select(F.bround("x", 2)).collect()] == [0.12, 0.38]


def test_truncation_r9(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,)], "x double")
    assert [r[0] for r in df.select(F.col("x").cast("int")).collect()] == [2, -2]


def test_ties_are_deterministic_r10(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 7)], "k string, n long")
    assert [r.k for r in stats.top_values(df, "k", 2).collect()] == ["c", "a"]


def test_confusion_missing_class_r11(spark):
    df = spark.createDataFrame([("Low", "Low"), ("Medium", "Low"), ("Medium", "Medium")],
                               "label string, prediction string")
    cm = {r.label: (r.Low, r.Medium, r.High) for r in E.confusion_matrix(df, S.TIERS).collect()}
    assert cm == {"Low": (1, 0, 0), "Medium": (1, 1, 0), "High": (0, 0, 0)}
    prf = {r.label: (r.precision, r.recall, r.f1)
           for r in E.per_class_prf(df, S.TIERS).collect()}
    assert prf["High"] == (0.0, 0.0, 0.0)          # zero division -> 0
    assert prf["Low"] == (0.5, 1.0, round(2 * 0.5 / 1.5, 6))


def test_union_missing_columns_and_harmonise_r15_r16(spark):
    a = spark.createDataFrame([(1, "Male", 3)], "id int, Gender string, NumImages int")
    b = spark.createDataFrame([(2, "Female")], "id int, Gender string")
    u = transforms.union_sources([a, b])
    u = transforms.harmonise(u, "Gender", transforms.GENDER_HARMONISE)
    got = sorted((r.id, r.Gender, r.NumImages) for r in u.collect())
    assert got == [(1, "Men", 3), (2, "Women", None)]


def test_histogram_edges_a13(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,), (1.0,)], "x double")
    h = {r.bin: r.n for r in stats.histogram(df, "x", 4).collect()}
    assert h == {1: 1, 3: 1, 4: 2}                 # the maximum falls in the last bin
    same = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert [(r.bin, r.n) for r in stats.histogram(same, "x", 5).collect()] == [(1, 2)]


def test_unseen_category_raises_f10(spark):
    train = spark.createDataFrame([("a",), ("b",)], "c string")
    codes = FE.label_codes(train, "c")
    new = spark.createDataFrame([("a",), ("z",)], "c string")
    with pytest.raises(Exception):
        FE.encode(new, codes, "c").collect()
    kept = {r.c: r.c_ix for r in FE.encode(new, codes, "c", "keep").collect()}
    assert kept == {"a": 0, "z": 2}


def test_hash_split_is_stable_and_disjoint_r14(spark):
    df = spark.range(5000).withColumnRenamed("id", "product_id")
    a = {r[0] for r in df.filter(X.is_test_row("product_id", 0.2)).collect()}
    b = {r[0] for r in df.repartition(7).filter(X.is_test_row("product_id", 0.2)).collect()}
    assert a == b and 800 < len(a) < 1200


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([5.0, 5.0, 1.0],)], "z array<double>")
    rows = df.select(X.softmax("z").alias("p"), X.argmax("z").alias("i")).collect()
    e = [math.exp(v - 3) for v in (1, 2, 3)]
    assert rows[0].p == pytest.approx([v / sum(e) for v in e])
    assert [r.i for r in rows] == [2, 0]            # first maximum wins


def test_quality_advice_d2(spark):
    from catalog_engine.operators.rules import quality_advice
    ind = spark.createDataFrame([(0.5, 0.2, 5000), (0.9, 0.5, 5000)],
                                "balance_score double, brand_diversity double, n_rows long")
    rows = quality_advice(ind).collect()
    assert rows[0].imbalance and not rows[0].ok and len(rows[0].advice) == 1
    assert rows[1].ok and rows[1].advice == ["ok"]


def test_relabel_update_and_cached(spark):
    from catalog_engine.sources.files import Cached
    df = spark.createDataFrame([(1, 10.0), (2, 20.0)], "a int, b double")
    r = transforms.relabel(df, ["id", "price"])
    assert r.columns == ["id", "price"]
    u = transforms.update_where(r, "price", F.col("id") == 2, F.lit(0.0))
    assert [x.price for x in u.orderBy("id").collect()] == [10.0, 0.0]
    with Cached(u) as c:
        assert c.is_cached and c.count() == 2
    assert not u.is_cached


def test_generated_images_p6(spark):
    df = spark.range(200).withColumnRenamed("id", "product_id")
    out = transforms.generated_images(df)
    lo, hi = out.agg(F.min("NumImages"), F.max("NumImages")).first()
    assert 1 <= lo and hi <= 9
    again = {r.product_id: r.NumImages for r in transforms.generated_images(df.repartition(3)).collect()}
    assert again == {r.product_id: r.NumImages for r in out.collect()}
