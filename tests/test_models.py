"""Seeded model tests on a separable fixture: schema, label domain, accuracy
above the majority share, save/load, side-by-side scoring, SAMME, integrated run."""

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.operators import evaluate as E
from catalog_engine.operators import models as M
from catalog_engine.operators import training as TR
from catalog_engine.operators.custom_ml import Samme
from catalog_engine.sources import files


@pytest.fixture(scope="module")
def catalog(spark):
    """Tier follows the image count and the brand, so the classes are separable."""
    tier = F.element_at(F.array(*[F.lit(t) for t in S.TIERS]), (F.col("id") % 3 + 1).cast("int"))
    df = spark.range(900).select(
        F.col("id").alias(S.PRODUCT_ID), tier.alias(S.TIER),
        F.concat(F.element_at(F.array(F.lit("cheap"), F.lit("plain"), F.lit("luxe")),
                              (F.col("id") % 3 + 1).cast("int")), F.lit(" item "),
                 F.element_at(F.array(*[F.lit(w) for w in ("red", "blue", "tall", "slim", "soft")]),
                              (F.col("id") % 5 + 1).cast("int"))).alias(S.NAME),
        F.element_at(F.array(F.lit("b0"), F.lit("b1"), F.lit("b2")), (F.col("id") % 3 + 1).cast("int")).alias(S.BRAND),
        F.element_at(F.array(F.lit("Men"), F.lit("Women")), (F.col("id") % 2 + 1).cast("int")).alias(S.GENDER),
        F.lit("Black").alias(S.COLOR),
        ((F.col("id") % 3) * 10 + (F.col("id") % 5)).cast("int").alias(S.IMAGES))
    return df.withColumn(S.PRICE, F.lit(1.0)) \
             .withColumn("l_orderkey", F.col(S.PRODUCT_ID)).withColumn("l_linenumber", F.lit(1))


@pytest.mark.parametrize("name,params", [
    ("RandomForest", dict(n_trees=10, max_depth=4)),
    ("GradientBoosting", dict(n_iter=3, max_depth=3)),
    ("SVM", dict(max_iter=20, n_features=50)),
    ("NeuralNetwork", dict(max_iter=50, hidden=(8,))),
    ("text_lr", dict(max_iter=50)),
    ("ada", dict(n_estimators=4)),
])
def test_models_learn_separable_tiers(spark, catalog, name, params):
    _, pred = TR.train_one(catalog, name, **params)
    assert pred.columns == [S.PRODUCT_ID, "split", "label", "prediction", "probability"]
    test = pred.filter(F.col("split") == "test")
    assert {r.prediction for r in test.select("prediction").distinct().collect()} <= set(S.TIERS)
    acc = test.agg(E.accuracy_pct()).first()[0]
    assert acc > 40.0, acc                         # majority share is ~33 %
    s = test.select(F.aggregate("probability", F.lit(0.0), lambda a, v: a + v).alias("s"))
    assert s.agg(F.min("s")).first()[0] == pytest.approx(1.0, abs=1e-6)


def test_unknown_algorithm_raises():
    with pytest.raises(KeyError):
        M.spec("XGBoost")


def test_save_load_and_feature_importance(spark, catalog, tmp_path):
    df = M.tier_label(catalog)
    model = TR.fit(df, "RandomForest", n_trees=5, max_depth=3)
    path = str(tmp_path / "rf")
    files.save_model(model, path)
    again = files.load_model(spark, path)
    a = TR.predictions(model, df, "RandomForest").orderBy(S.PRODUCT_ID).collect()
    b = TR.predictions(again, df, "RandomForest").orderBy(S.PRODUCT_ID).collect()
    assert a == b
    assert files.load_model(spark, str(tmp_path / "absent")) is None
    imp = M.feature_importance(model)
    assert [n for n, _ in imp] == [S.BRAND, S.GENDER, S.COLOR, S.IMAGES]


def test_integrated_run_side_by_side(spark, catalog):
    res = TR.integrated_run(
        catalog, structured=("rf", "ada"), text=("text_lr",), transfer=("transfer_rf",),
        overrides={"rf": dict(n_trees=5, max_depth=3), "ada": dict(n_estimators=3),
                   "text_lr": dict(max_iter=20), "transfer_rf": dict(n_trees=3, max_depth=3)})
    assert not res["failures"]
    scores = {r.model: r for r in res["scores"].collect()}
    assert set(scores) == {"rf", "ada", "text_lr", "transfer_rf"}
    assert {r.family for r in scores.values()} == {"structured", "text", "transfer"}
    scored = res["scored"]
    assert {"rf__probability", "ada__probability", "text_lr__probability", "vote"} <= set(scored.columns)
    assert scored.count() == catalog.count()
    assert 0.0 <= res["ensemble"].first()[0] <= 1.0
    long = TR.per_model_long(scored, [n for n, _ in res["fitted"]])
    assert long.count() == 4 * catalog.count()
    assert {r.model for r in long.select("model").distinct().collect()} == {
        "rf", "ada", "text_lr", "transfer_rf"}


def test_compare_algorithms_table(spark, catalog):
    out = TR.compare_algorithms(catalog, ["RandomForest", "text_lr"],
                                overrides={"RandomForest": dict(n_trees=5, max_depth=3),
                                           "text_lr": dict(max_iter=20)})
    rows = {r.algorithm: r for r in out.collect()}
    assert set(rows) == {"RandomForest", "text_lr"}
    for r in rows.values():
        assert r.test_error == pytest.approx(100.0 - r.test_accuracy, abs=1e-5)
        assert r.overfit_gap == pytest.approx(r.train_accuracy - r.test_accuracy, abs=1e-5)
        assert 0.0 <= r.f1 <= 100.0


def test_training_curve_four_series(spark):
    from pyspark.ml.functions import array_to_vector
    df = spark.range(400).select(
        (F.col("id") % 2).cast("double").alias("y"),
        array_to_vector(F.array((F.col("id") % 2).cast("double"), (F.col("id") % 7).cast("double"))).alias("x"),
        F.col("id"))
    train, val = df.filter("id % 5 != 0"), df.filter("id % 5 = 0")
    curve = TR.training_curve(train, val, "x", "y", [2, 4, 2], epochs=3).orderBy("epoch").collect()
    assert [r.epoch for r in curve] == [1, 2, 3]
    assert all(r.train_loss > 0 and 0 <= r.val_acc <= 1 for r in curve)


def test_pca_two_components_centred(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from catalog_engine.operators import features as FE
    df = spark.range(50).select(array_to_vector(F.array(
        F.col("id").cast("double"), (F.col("id") * 2 + 1).cast("double"), F.lit(3.0))).alias("v"))
    out = Pipeline(stages=FE.pca_2d("v")).fit(df).transform(df)
    means = out.select(vector_to_array("pca").alias("p")).agg(
        F.avg(F.col("p")[0]), F.avg(F.col("p")[1])).first()
    assert means[0] == pytest.approx(0.0, abs=1e-9) and means[1] == pytest.approx(0.0, abs=1e-9)


@pytest.mark.parametrize("name,params", [
    ("SVM", dict(max_iter=5, n_features=20)),            # Python stages: Fourier features
    ("GradientBoosting", dict(n_iter=2, max_depth=2)),   # Python stage: margins -> probability
    ("ada", dict(n_estimators=3)),                        # Python model: SAMME stumps
])
def test_pipelines_with_python_stages_save_and_load(spark, catalog, tmp_path, name, params):
    df = M.tier_label(catalog)
    model = TR.fit(df, name, **params)
    files.save_model(model, str(tmp_path / name))
    again = files.load_model(spark, str(tmp_path / name))
    a = TR.predictions(model, df, name).orderBy(S.PRODUCT_ID).collect()
    b = TR.predictions(again, df, name).orderBy(S.PRODUCT_ID).collect()
    assert a == b


def test_boosting_evaluates_its_input_once(spark):
    """However many rounds run, the rows it is given are computed once."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def label(i):
        seen.add(1)
        return float(i % 3)
    df = spark.range(300, numPartitions=2).select(
        label("id").alias("label"), array_to_vector(F.array((F.col("id") % 3).cast("double"), (F.col("id") % 7).cast("double"))).alias("features"))
    Samme(n_estimators=12, checkpoint_every=5).fit(df)
    assert seen.value == 300
