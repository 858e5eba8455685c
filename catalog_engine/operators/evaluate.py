"""Model evaluation as relational queries (M12 vote, M17, M19-M24, M26-M27, A13-A14,
A18-A22, T4-T5, P13-P14).

Inputs are prediction tables: one row per scored product with ``label``
(actual class name), ``prediction`` and ``probability`` (array in class
order). Every metric is an aggregate over that table: partial aggregation
runs map-side, and the only per-class tables are k or k x k rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.operators import rules

LOG_EPS = 1e-7


def label_domain(spark: SparkSession, labels: list, name: str = "label") -> DataFrame:
    """The class list as a small fixed table (k rows, safe to broadcast)."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(labels)], f"class_idx int, {name} string")


def with_confidence(df: DataFrame, prob: str, labels: list,
                    pred: str = "prediction") -> DataFrame:
    """confidence = max probability, prediction = class at the argmax."""
    names = F.array(*[F.lit(c) for c in labels])
    return df.withColumns({
        "confidence": F.array_max(F.col(prob)),
        pred: F.element_at(names, X.argmax(prob) + 1),
    })


def soft_vote(df: DataFrame, prob_cols: list, labels: list, out: str = "vote_probability",
              max_models: int | None = None) -> DataFrame:
    """Average the class probabilities of up to ``max_models`` models.

    Models were applied to the same rows as extra columns, so the vote is a
    row-wise expression: no shuffle, no regrouping by row key.
    """
    cols = prob_cols[:max_models] if max_models else prob_cols
    voted = df.withColumn(out, X.array_mean(cols))
    return with_confidence(voted, out, labels, pred="vote")


def confusion_matrix(df: DataFrame, labels: list, label: str = "label",
                     pred: str = "prediction") -> DataFrame:
    """rows = actual, columns = predicted, in the given class order;
    classes absent from the data still get a row of zeros."""
    spark = df.sparkSession
    counts = df.groupBy(label).pivot(pred, labels).count()
    dom = F.broadcast(label_domain(spark, labels, label))
    out = dom.join(counts, label, "left")
    return out.select(label, *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                               for c in labels])


def class_counts(df: DataFrame, labels: list, label: str = "label",
                 pred: str = "prediction") -> DataFrame:
    """Per class: support, predicted count and true positives (k rows)."""
    spark = df.sparkSession
    cells = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("n"))
    by_actual = cells.groupBy(label).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = cells.groupBy(F.col(pred).alias(label)).agg(F.sum("n").alias("n_pred"))
    dom = F.broadcast(label_domain(spark, labels, label))
    return (dom.join(by_actual, label, "left").join(by_pred, label, "left")
               .select("class_idx", label,
                       *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
                         for c in ("support", "tp", "n_pred")]))


def _prf(cc: DataFrame) -> DataFrame:
    p = X.ratio(F.col("tp"), F.col("n_pred"))
    r = X.ratio(F.col("tp"), F.col("support"))
    return cc.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", X.ratio(F.lit(2.0) * F.col("precision") * F.col("recall"),
                      F.col("precision") + F.col("recall")))


def per_class_prf(df: DataFrame, labels: list, label: str = "label",
                  pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Precision, recall, F1 and support per class (zero division -> 0)."""
    out = _prf(class_counts(df, labels, label, pred))
    return out.select("class_idx", label, *[F.bround(c, digits).alias(c)
                                            for c in ("precision", "recall", "f1")], "support")


def classification_report(df: DataFrame, labels: list, label: str = "label",
                          pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Per-class rows, then accuracy, macro avg and weighted avg rows.

    The accuracy row carries the accuracy in all three score columns and the
    row count as support.
    """
    prf = _prf(class_counts(df, labels, label, pred))
    k = float(len(labels))
    tot = F.sum("support")
    summary = prf.agg(
        X.ratio(F.sum("tp"), tot).alias("acc"),
        (F.sum("precision") / F.lit(k)).alias("mp"), (F.sum("recall") / F.lit(k)).alias("mr"),
        (F.sum("f1") / F.lit(k)).alias("mf"),
        X.ratio(F.sum(F.col("precision") * F.col("support")), tot).alias("wp"),
        X.ratio(F.sum(F.col("recall") * F.col("support")), tot).alias("wr"),
        X.ratio(F.sum(F.col("f1") * F.col("support")), tot).alias("wf"),
        tot.alias("n"))
    rows = prf.select(F.col(label).alias("row"), "precision", "recall", "f1", "support")
    acc = summary.select(F.lit("accuracy").alias("row"), F.col("acc").alias("precision"),
                         F.col("acc").alias("recall"), F.col("acc").alias("f1"),
                         F.col("n").alias("support"))
    macro = summary.select(F.lit("macro avg").alias("row"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1"),
                           F.col("n").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("row"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1"),
                              F.col("n").alias("support"))
    out = rows.unionByName(acc).unionByName(macro).unionByName(weighted)
    return out.select("row", *[F.bround(c, digits).alias(c) for c in ("precision", "recall", "f1")],
                      "support")


def weighted_prf(df: DataFrame, labels: list, label: str = "label",
                 pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Support-weighted precision, recall and F1 in one row."""
    prf = _prf(class_counts(df, labels, label, pred))
    tot = F.sum("support")
    return prf.agg(*[F.bround(X.ratio(F.sum(F.col(c) * F.col("support")), tot), digits)
                     .alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])


def accuracy_pct(label: str = "label", pred: str = "prediction") -> Column:
    """Accuracy in percent as the mean of a 0/1 flag."""
    return F.avg((F.col(label) == F.col(pred)).cast("double")) * F.lit(100.0)


def train_test_summary(df: DataFrame, split: str = "split", label: str = "label",
                       pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Train and test accuracy/error, overfit gap, counts and ratios."""
    hit = (F.col(label) == F.col(pred)).cast("double")
    is_tr, is_te = F.col(split) == "train", F.col(split) == "test"
    agg = df.agg(
        F.avg(F.when(is_tr, hit)).alias("tr"), F.avg(F.when(is_te, hit)).alias("te"),
        F.count_if(is_tr).alias("n_train"), F.count_if(is_te).alias("n_test"))
    n = F.col("n_train") + F.col("n_test")
    return agg.select(
        F.bround(F.col("tr") * 100.0, digits).alias("train_accuracy"),
        F.bround(F.col("te") * 100.0, digits).alias("test_accuracy"),
        F.bround((F.lit(1.0) - F.col("tr")) * 100.0, digits).alias("train_error"),
        F.bround((F.lit(1.0) - F.col("te")) * 100.0, digits).alias("test_error"),
        F.bround((F.col("tr") - F.col("te")) * 100.0, digits).alias("overfit_gap"),
        "n_train", "n_test",
        F.bround(X.ratio(F.col("n_train"), n), digits).alias("train_ratio"),
        F.bround(X.ratio(F.col("n_test"), n), digits).alias("test_ratio"))


def log_loss_and_accuracy(df: DataFrame, prob: str, label_idx: str, pred_idx: str,
                          digits: int = 6) -> DataFrame:
    """Accuracy and mean cross-entropy with probabilities clipped to
    [1e-7, 1 - 1e-7]."""
    p = F.element_at(F.col(prob), F.col(label_idx) + 1)
    clipped = F.greatest(F.least(p, F.lit(1.0 - LOG_EPS)), F.lit(LOG_EPS))
    return df.agg(
        F.bround(F.avg((F.col(label_idx) == F.col(pred_idx)).cast("double")), digits).alias("accuracy"),
        F.bround(F.avg(-F.ln(clipped)), digits).alias("loss"),
        F.count(F.lit(1)).alias("n"))


def confidence_vs_correct(df: DataFrame, n_bins: int = 20, label: str = "label",
                          pred: str = "prediction", digits: int = 6) -> DataFrame:
    """Per confidence bin over [0, 1], the share of correct predictions."""
    b = X.equal_width_bin(F.col("confidence"), F.lit(0.0), F.lit(1.0), n_bins)
    return (df.withColumn("bin", b).groupBy("bin")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.bround(F.avg((F.col(label) == F.col(pred)).cast("double")), digits)
                   .alias("accuracy")))


def adaptive_rate(acc: str = "score", target: float = 0.95):
    """min(0.1, (target - acc) * 2) below the target, else 0.01."""
    a = F.col(acc)
    return F.when(a < F.lit(target), F.least(F.lit(0.1), (F.lit(target) - a) * F.lit(2.0))) \
            .otherwise(F.lit(0.01))


def family_means(scores: DataFrame, digits: int = 6) -> DataFrame:
    """Mean score per model family."""
    return scores.groupBy("family").agg(F.bround(F.avg("score"), digits).alias("mean_score"),
                                        F.count(F.lit(1)).alias("n_models"))


def family_summary(scores: DataFrame, ensemble: DataFrame | None = None,
                   traits: dict | None = None, digits: int = 6) -> DataFrame:
    """Model count and best score per family, plus the ensemble row
    (one model, its accuracy) when given, each with its trait from the
    caller's notes on families."""
    fam = scores.groupBy("family").agg(F.count(F.lit(1)).alias("n_models"),
                                       F.max("score").alias("best_score"))
    if ensemble is not None:
        fam = fam.unionByName(ensemble.select(F.lit("ensemble").alias("family"),
                                              F.lit(1).cast("long").alias("n_models"),
                                              F.col("ensemble").alias("best_score")))
    trait = rules.note("family", traits) if traits else F.lit(None).cast("string")
    return fam.select("family", "n_models", F.bround("best_score", digits).alias("best_score"),
                      trait.alias("trait"))


def ensemble_gain(scores: DataFrame, ensemble_score: DataFrame, digits: int = 6) -> DataFrame:
    """Best single model vs the ensemble: absolute and relative gain.

    ``ensemble_score`` is a one-row frame with column ``ensemble``.
    """
    best = scores.agg(F.max("score").alias("best_single"))
    ens = ensemble_score.select("ensemble").scalar()
    return best.select(
        F.bround("best_single", digits).alias("best_single"),
        F.bround(ens, digits).alias("ensemble"),
        F.bround(ens - F.col("best_single"), digits).alias("gain"),
        F.bround(F.lit(100.0) * X.ratio(ens - F.col("best_single"), F.col("best_single")), digits)
        .alias("gain_pct"))


def misclassified(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Rows whose prediction differs from the label."""
    return df.filter(F.col(label) != F.col(pred))


def first_misclassified(df: DataFrame, order: list, n: int = 16, label: str = "label",
                        pred: str = "prediction") -> DataFrame:
    """T5: the first n misclassified rows by ``order``."""
    return misclassified(df, label, pred).orderBy(*order).limit(n)


def tier_index(col: str = S.TIER) -> Column:
    c = F.col(col)
    return F.when(c == "Low", 0).when(c == "Medium", 1).when(c == "High", 2)
