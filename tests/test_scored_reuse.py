"""The frequency-table classifiers: counted once for all models, equal to a count by hand."""

from collections import Counter

from pyspark.sql import functions as F

from catalog_engine.plans import eval_plans as EP
from catalog_engine.sources import catalog as C
from catalog_engine.sources import scored as SC


def tables(spark, tmp_path):
    lines = [(i, i % 7 + 1, i % 5, 1, float(i * 900 % 100000), float(i % 9), "ANRX"[i % 4]) for i in range(200)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, "
                                 "l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"w{i} x{i % 2}", f"b{i % 3}", f"t{i % 2}") for i in range(4)],
                          "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def test_probabilities_are_smoothed_training_counts(spark, tmp_path):
    d = tables(spark, tmp_path)
    tiered = C.with_tier(C.lines(spark, d))
    rows = SC.scored(tiered, C.parts(spark, d), ["quantity"]).join(tiered.select("product_id", "NumImages"), "product_id").collect()
    counts = Counter((r["NumImages"], r["label_idx"]) for r in rows if r["split"] == "train")
    for r in rows:
        n = [counts[(r["NumImages"], j)] + 1.0 for j in range(3)]
        assert r["p_quantity"] == [x / sum(n) for x in n]


def test_unseen_values_get_equal_probabilities(spark, tmp_path):
    d = tables(spark, tmp_path)
    test_only = F.when(F.col("product_id").isNotNull(), F.col("product_id"))  # a value of its own in every row
    tiered = C.with_tier(C.lines(spark, d)).withColumn("DataSource", test_only)
    held = SC.scored(tiered, C.parts(spark, d), ["source"]).filter("split = 'test'").collect()
    assert held and all(r["p_source"] == [1 / 3] * 3 for r in held)


def test_models_share_one_count_of_the_rows(spark, tmp_path):
    """With adaptive execution off the plan shows the reuse; each model used to read the lines anew."""
    d = tables(spark, tmp_path)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = EP._all_scores(spark, d)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") >= len(SC.MODELS) - 1
    assert plan.count("FileScan") <= 4  # lines and parts: for the counts, and for the rows they are applied to
