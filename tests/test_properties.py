"""Property tests over the driver tables (sf0.001)."""

import pytest
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.operators import evaluate as E
from catalog_engine.operators import stats
from catalog_engine.sources import catalog as C
from catalog_engine.sources import scored as SC


def test_tier_partition_is_complete(spark, sf_small):
    lines = C.with_tier(C.lines(spark, sf_small))
    n = lines.count()
    counts = {r[S.TIER]: r.n for r in stats.value_counts(lines, S.TIER).collect()}
    assert set(counts) <= set(S.TIERS) and sum(counts.values()) == n


def test_shares_sum_to_100(spark, sf_small):
    total = stats.source_share(C.lines(spark, sf_small)).agg(F.sum("share_pct")).first()[0]
    assert total == pytest.approx(100.0, abs=0.02)


def test_vote_probabilities_sum_to_one_and_confusion_total(spark, sf_small):
    df = SC.scored(C.with_tier(C.lines(spark, sf_small)), C.parts(spark, sf_small))
    voted = E.soft_vote(df, [f"p_{m}" for m in SC.VOTERS], S.TIERS)
    sums = voted.select(F.aggregate("vote_probability", F.lit(0.0), lambda a, v: a + v).alias("s"))
    lo, hi = sums.agg(F.min("s"), F.max("s")).first()
    assert lo == pytest.approx(1.0) and hi == pytest.approx(1.0)
    cm = E.confusion_matrix(E.with_confidence(df, f"p_{SC.FIRST}", S.TIERS), S.TIERS)
    assert cm.agg(F.sum(F.col("Low") + F.col("Medium") + F.col("High"))).first()[0] == df.count()


def test_part_rollup_equals_row_level_join(spark, sf_small):
    """The pre-aggregated plan gives the same answer as the naive row-level join."""
    lines, parts = C.lines(spark, sf_small), C.parts(spark, sf_small)
    fast = {r[S.SOURCE]: tuple(r)[1:] for r in stats.source_stats(lines, parts).collect()}
    cat = C.catalog(spark, sf_small)
    naive = cat.groupBy(S.SOURCE).agg(
        F.count(S.NAME), F.bround(F.avg(S.PRICE), 2), F.bround(F.min(S.PRICE), 2),
        F.bround(F.max(S.PRICE), 2), F.count_distinct(S.BRAND), F.count_distinct(S.COLOR),
        F.count_distinct(S.GENDER))
    assert fast == {r[S.SOURCE]: tuple(r)[1:] for r in naive.collect()}


def test_report_accuracy_matches_mean_of_flags(spark, sf_small):
    df = E.with_confidence(SC.scored(C.with_tier(C.lines(spark, sf_small)), C.parts(spark, sf_small)), f"p_{SC.FIRST}",
                           S.TIERS)
    rep = {r.row: r for r in E.classification_report(df, S.TIERS).collect()}
    acc = df.agg(E.accuracy_pct()).first()[0] / 100.0
    assert rep["accuracy"].precision == pytest.approx(acc, abs=1e-6)


def test_hot_part_key_gives_the_same_answer(spark):
    """One part key holds a third of all lines; the pre-aggregated plan equals the
    naive row-level join."""
    from pyspark.sql import functions as F
    n = 3000
    lines = spark.range(n).select(
        F.col("id").alias(S.PRODUCT_ID), F.col("id").alias("l_orderkey"),
        F.lit(1).alias("l_linenumber"),
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 50).cast("long").alias("l_partkey"),
        F.lit(1).cast("long").alias("l_suppkey"),
        (F.col("id") * 37 % 1000).cast("double").alias(S.PRICE),
        (F.col("id") % 9).cast("int").alias(S.IMAGES),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias(S.SOURCE))
    parts = spark.range(50).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("p"), F.col("id").cast("string")).alias(S.NAME),
        F.concat(F.lit("b"), (F.col("id") % 5).cast("string")).alias(S.BRAND),
        F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias(S.GENDER),
        F.concat(F.lit("c"), (F.col("id") % 4).cast("string")).alias(S.COLOR))
    assert lines.filter(F.col("l_partkey") == 7).count() >= n // 3
    fast = {r[S.SOURCE]: tuple(r)[1:] for r in stats.source_stats(lines, parts).collect()}
    cat = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    naive = cat.groupBy(S.SOURCE).agg(
        F.count(S.NAME), F.bround(F.avg(S.PRICE), 2), F.bround(F.min(S.PRICE), 2),
        F.bround(F.max(S.PRICE), 2), F.count_distinct(S.BRAND), F.count_distinct(S.COLOR),
        F.count_distinct(S.GENDER))
    assert fast == {r[S.SOURCE]: tuple(r)[1:] for r in naive.collect()}


def test_voters_differ_and_split_is_independent_of_class(spark, sf_small):
    df = SC.scored(C.with_tier(C.lines(spark, sf_small)), C.parts(spark, sf_small), SC.VOTERS).persist()
    assert len(SC.VOTERS) > SC.MAX_VOTERS
    base = X.argmax(f"p_{SC.FIRST}")
    for m in SC.VOTERS[1:]:
        p = F.col(f"p_{m}")
        same = df.agg(F.avg((X.argmax(f"p_{m}") == base).cast("double")),
                      F.corr(p[0], F.col(f"p_{SC.FIRST}")[0])).first()
        assert same[1] is None or abs(same[1]) < 0.9, m
    shares = {r.label: r.t for r in df.groupBy("label").agg(F.avg((F.col("split") == "test").cast("double")).alias("t")).collect()}
    assert all(abs(t - 0.2) < 0.05 for t in shares.values())
    df.unpersist()


def test_draws_are_uniform_beyond_a_million_keys(spark):
    n = 2_500_000
    keys = spark.range(0, n * 7, 7)
    draw = X.hash_unit("id", X.MULT_SAMPLE)
    buckets = keys.groupBy(F.floor(draw * 50).alias("b")).count().collect()
    assert len(buckets) == 50 and all(abs(r["count"] - n / 50) < 5 * (n / 50) ** 0.5 for r in buckets)
    assert keys.select(draw.alias("d")).distinct().count() > n - 10
    sample = [r.id for r in keys.orderBy(draw).limit(400).collect()]
    assert abs(sum(sample) / 400 - 3.5 * n) < 3.5 * n * 0.15  # not the smallest keys
    both = keys.agg(F.corr(draw, X.hash_unit("id", X.MULT_SPLIT))).first()[0]
    assert abs(both) < 0.01


def test_product_ids_do_not_collide_on_large_keys(spark):
    rows = [(1, 8_000_000, 1), (9, 0, 1), (1, 1_000_000, 8), (1, 1_000_001, 0)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int")
    assert df.select(C.product_id_expr()).distinct().count() == len(rows)
