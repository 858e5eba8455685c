"""Evaluation queries over the outputs of the frequency-table models (``sources.scored``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators import evaluate as E
from catalog_engine.operators import rules, stats, topk
from catalog_engine.plans import fixtures
from catalog_engine.plans.registry import register
from catalog_engine.sources import catalog as C
from catalog_engine.sources import scored as SC

WS = "WITH " + C.catalog_sql() + "," + SC.scored_sql()
T = S.TIERS
RF = f"p_{SC.FIRST}"  # the model that single-model queries look at
ORDER = ["product_id", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "Price"]
ORDER_SQL = ", ".join(ORDER)
LBL = SC.label_of


def _scored(spark, d, models=None):
    return SC.scored(C.with_tier(C.lines(spark, d)), C.parts(spark, d), models)


def _rf(spark, d, split: str | None = "test"):
    df = E.with_confidence(_scored(spark, d, [SC.FIRST]), RF, T)
    return df.filter(F.col("split") == split) if split else df


def _rf_sql(split: str | None = "test") -> str:
    where = f"WHERE split = '{split}'" if split else ""
    return (f", rf AS (SELECT *, {LBL('pred0')} AS prediction, conf0 AS confidence, "
            f"p0_0, p0_1, p0_2 FROM scored {where})")


@register("m17_confidence_argmax", f"""{WS}{_rf_sql(None)}
SELECT product_id, l_orderkey, l_linenumber, prediction, confidence FROM rf""")
def m17_confidence_argmax(spark, d):
    """Unrounded: both engines compute the probabilities with the same operations
    in the same order, so the doubles agree bit for bit."""
    return _rf(spark, d, None).select("product_id", "l_orderkey", "l_linenumber", "prediction",
                                      "confidence")


_DOM = "dom(class_idx, label) AS (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High'))"


@register("m19_confusion", f"""{WS}{_rf_sql()}, {_DOM}
SELECT d.label,
  CAST(count_if(rf.prediction = 'Low') AS BIGINT) AS Low,
  CAST(count_if(rf.prediction = 'Medium') AS BIGINT) AS Medium,
  CAST(count_if(rf.prediction = 'High') AS BIGINT) AS High
FROM dom d LEFT JOIN rf ON rf.label = d.label GROUP BY d.label""")
def m19_confusion(spark, d):
    return E.confusion_matrix(_rf(spark, d), T)


_CC = f"""{WS}{_rf_sql()}, {_DOM},
cc AS (SELECT d.class_idx, d.label,
    CAST((SELECT count(*) FROM rf WHERE rf.label = d.label) AS BIGINT) AS support,
    CAST((SELECT count(*) FROM rf WHERE rf.label = d.label AND rf.prediction = d.label) AS BIGINT) AS tp,
    CAST((SELECT count(*) FROM rf WHERE rf.prediction = d.label) AS BIGINT) AS n_pred
  FROM dom d),
pr AS (SELECT *, {Q.ratio('tp', 'n_pred')} AS precision, {Q.ratio('tp', 'support')} AS recall FROM cc),
prf AS (SELECT *, {Q.ratio(f'{Q.dbl(2)} * precision * recall', 'precision + recall')} AS f1 FROM pr)"""


@register("m22_per_class_prf", _CC + """
SELECT class_idx, label, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even(f1, 6) AS f1, support FROM prf""")
def m22_per_class_prf(spark, d):
    return E.per_class_prf(_rf(spark, d), T)


@register("m20_classification_report", _CC + f""",
s AS (SELECT {Q.ratio('sum(tp)', 'sum(support)')} AS acc, sum(precision) / {Q.dbl(3)} AS mp,
      sum(recall) / {Q.dbl(3)} AS mr, sum(f1) / {Q.dbl(3)} AS mf,
      {Q.ratio('sum(precision * support)', 'sum(support)')} AS wp,
      {Q.ratio('sum(recall * support)', 'sum(support)')} AS wr,
      {Q.ratio('sum(f1 * support)', 'sum(support)')} AS wf,
      CAST(sum(support) AS BIGINT) AS n FROM prf),
u AS (SELECT label AS row, precision, recall, f1, support FROM prf
      UNION ALL SELECT 'accuracy', acc, acc, acc, n FROM s
      UNION ALL SELECT 'macro avg', mp, mr, mf, n FROM s
      UNION ALL SELECT 'weighted avg', wp, wr, wf, n FROM s)
SELECT row, round_even(precision, 6) AS precision, round_even(recall, 6) AS recall,
       round_even(f1, 6) AS f1, support FROM u""")
def m20_classification_report(spark, d):
    return E.classification_report(_rf(spark, d), T)


@register("m21_weighted_prf", _CC + f"""
SELECT round_even({Q.ratio('sum(precision * support)', 'sum(support)')}, 6) AS weighted_precision,
       round_even({Q.ratio('sum(recall * support)', 'sum(support)')}, 6) AS weighted_recall,
       round_even({Q.ratio('sum(f1 * support)', 'sum(support)')}, 6) AS weighted_f1 FROM prf""")
def m21_weighted_prf(spark, d):
    return E.weighted_prf(_rf(spark, d), T)


@register("m23_train_test", f"""{WS}{_rf_sql(None)},
a AS (SELECT avg(CASE WHEN split = 'train' THEN CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END END) AS tr,
             avg(CASE WHEN split = 'test' THEN CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END END) AS te,
             CAST(count_if(split = 'train') AS BIGINT) AS n_train,
             CAST(count_if(split = 'test') AS BIGINT) AS n_test FROM rf)
SELECT round_even(tr * 100.0, 6) AS train_accuracy, round_even(te * 100.0, 6) AS test_accuracy,
       round_even((1.0 - tr) * 100.0, 6) AS train_error, round_even((1.0 - te) * 100.0, 6) AS test_error,
       round_even((tr - te) * 100.0, 6) AS overfit_gap, n_train, n_test,
       round_even({Q.ratio('n_train', 'n_train + n_test')}, 6) AS train_ratio,
       round_even({Q.ratio('n_test', 'n_train + n_test')}, 6) AS test_ratio FROM a""")
def m23_train_test(spark, d):
    return E.train_test_summary(_rf(spark, d, None))


@register("m24_accuracy_logloss", f"""{WS}{_rf_sql()}
SELECT round_even(avg(CASE WHEN label_idx = pred0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round_even(avg(-ln(greatest(least(CASE label_idx WHEN 0 THEN p0_0 WHEN 1 THEN p0_1 ELSE p0_2 END,
                                        {Q.dbl(1 - 1e-7)}), {Q.dbl(1e-7)}))), 6) AS loss,
       count(*) AS n FROM rf""")
def m24_accuracy_logloss(spark, d):
    df = _rf(spark, d).withColumn("pred_idx", X.argmax(RF))
    return E.log_loss_and_accuracy(df, RF, "label_idx", "pred_idx")


@register("m26_confidence_vs_correct", f"""{WS}{_rf_sql()}
SELECT {Q.equal_width_bin('confidence', Q.dbl(0), Q.dbl(1), 20)} AS bin, count(*) AS n,
       round_even(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM rf GROUP BY 1""")
def m26_confidence_vs_correct(spark, d):
    return E.confidence_vs_correct(_rf(spark, d))


_VOTE = [SC.model_index(m) for m in SC.VOTERS[:SC.MAX_VOTERS]]


def _vote_sql() -> str:
    v = [f"(({' + '.join(f'p{i}_{j}' for i in _VOTE)}) / {Q.dbl(len(_VOTE))})" for j in range(3)]
    return f""", vt AS (SELECT *, {v[0]} AS v0, {v[1]} AS v1, {v[2]} AS v2 FROM scored WHERE split = 'test'),
vote AS (SELECT *, {LBL('CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END')} AS vote,
         greatest(v0, v1, v2) AS confidence FROM vt)"""


def _vote(spark, d):
    df = _scored(spark, d, SC.VOTERS).filter(F.col("split") == "test")
    return E.soft_vote(df, [f"p_{m}" for m in SC.VOTERS], T, max_models=SC.MAX_VOTERS)


@register("m12_soft_vote", f"""{WS}{_vote_sql()}
SELECT product_id, l_orderkey, l_linenumber, vote, confidence FROM vote""")
def m12_soft_vote(spark, d):
    return _vote(spark, d).select("product_id", "l_orderkey", "l_linenumber", "vote", "confidence")


@register("a21_a22_vote_accuracy", f"""{WS}{_vote_sql()}
SELECT round_even(avg(CASE WHEN vote = label THEN 1.0 ELSE 0.0 END) * 100.0, 6) AS accuracy_pct,
       round_even(avg(confidence), 6) AS mean_confidence FROM vote""")
def a21_a22_vote_accuracy(spark, d):
    return _vote(spark, d).agg(F.bround(E.accuracy_pct("label", "vote"), 6).alias("accuracy_pct"),
                               F.bround(F.avg("confidence"), 6).alias("mean_confidence"))


def _hist_body(x: str, src: str, by: list, n: int) -> str:
    g = ", ".join(by)
    gsel = (g + ", ") if by else ""
    join = f"JOIN r USING ({g})" if by else ", r"
    width = f"((hi - lo) / {Q.dbl(n)})"
    return f""",
hv AS (SELECT {gsel}{x} AS x FROM {src} WHERE {x} IS NOT NULL AND NOT isnan({x})),
r AS (SELECT {gsel}min(x) AS lo, max(x) AS hi FROM hv {'GROUP BY ' + g if by else ''}),
b AS (SELECT {gsel}{Q.equal_width_bin('x', 'lo', 'hi', n)} AS bin, lo, hi FROM hv {join})
SELECT {gsel}bin, round_even(lo + (bin - 1) * {width}, 6) AS bin_lo,
       round_even(lo + bin * {width}, 6) AS bin_hi, count(*) AS n
FROM b GROUP BY {gsel}bin, lo, hi"""


@register("a13_confidence_histogram", f"{WS}{_rf_sql()}" + _hist_body("confidence", "rf", [], 20))
def a13_confidence_histogram(spark, d):
    return stats.histogram(_rf(spark, d), "confidence", 20)


@register("a14_class_prob_histograms", f"""{WS}{_rf_sql()},
lp AS (SELECT label, 0 AS class_idx, p0_0 AS prob FROM rf UNION ALL
       SELECT label, 1, p0_1 FROM rf UNION ALL SELECT label, 2, p0_2 FROM rf)"""
          + _hist_body("prob", "lp", ["class_idx", "label"], 20))
def a14_class_prob_histograms(spark, d):
    long = _rf(spark, d).select("label", F.posexplode(RF).alias("class_idx", "prob"))
    return stats.histogram(long, "prob", 20, by=["class_idx", "label"])


# ---------------------------------------------------------------- model scores

def _all_scores(spark, d):
    """(family, model, score) of every model and of the vote on the test rows: one aggregate pass."""
    df = _scored(spark, d).filter(F.col("split") == "test")
    df = E.soft_vote(df, [f"p_{m}" for m in SC.VOTERS], T, max_models=SC.MAX_VOTERS)
    wide = df.agg(*[F.avg((X.argmax(f"p_{m}") == F.col("label_idx")).cast("double")).alias(m) for _, m, _ in SC.MODELS],
                  F.avg((F.col("vote") == F.col("label")).cast("double")).alias(VOTE[1]))
    rows = [F.struct(F.lit(f).alias("family"), F.lit(m).alias("model"), F.col(m).alias("score"))
            for f, m in [*((f, m) for f, m, _ in SC.MODELS), VOTE]]
    return wide.select(F.explode(F.array(*rows)).alias("_s")).select("_s.*")


VOTE = ("ensemble", "soft_vote")


def _scores(spark, d):
    """Per model test accuracy, in long form."""
    return _models_of(_all_scores(spark, d))


def _models_of(rows):
    return rows.filter(F.col("family") != VOTE[0])


def _ensemble_of(rows):
    return rows.filter(F.col("family") == VOTE[0]).select(F.col("score").alias("ensemble"))


def _scores_sql() -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS family, '{m}' AS model, avg(CASE WHEN pred{i} = label_idx THEN 1.0 ELSE 0.0 END) "
        f"AS score FROM scored WHERE split = 'test'" for i, (f, m, _) in enumerate(SC.MODELS))
    return f", scores AS ({rows})"


_ENS_SQL = ", ens AS (SELECT avg(CASE WHEN vote = label THEN 1.0 ELSE 0.0 END) AS ensemble FROM vote)"


@register("u2_score_union", f"""{WS}{_scores_sql()}{_vote_sql()}{_ENS_SQL}
SELECT family, model, round_even(score, 6) AS score FROM scores
UNION ALL SELECT 'ensemble', 'soft_vote', round_even(ensemble, 6) FROM ens""")
def u2_score_union(spark, d):
    return _all_scores(spark, d).select("family", "model", F.bround("score", 6).alias("score"))


@register("a18_family_means", f"""{WS}{_scores_sql()}
SELECT family, round_even(avg(score), 6) AS mean_score, count(*) AS n_models FROM scores GROUP BY family""")
def a18_family_means(spark, d):
    return E.family_means(_scores(spark, d))


_TRAITS_SQL = f"traits(family, trait) AS (VALUES {fixtures.values_sql(fixtures.FAMILY_NOTES.items())})"


@register("a20_family_summary", f"""{WS}{_scores_sql()}{_vote_sql()}{_ENS_SQL}, {_TRAITS_SQL},
fam AS (SELECT family, count(*) AS n_models, max(score) AS best_score FROM scores GROUP BY family
        UNION ALL SELECT 'ensemble', 1, ensemble FROM ens)
SELECT family, n_models, round_even(best_score, 6) AS best_score, trait
FROM fam LEFT JOIN traits USING (family)""")
def a20_family_summary(spark, d):
    rows = _all_scores(spark, d)
    return E.family_summary(_models_of(rows), _ensemble_of(rows), fixtures.FAMILY_NOTES)


@register("a23_report_facts", f"""{WS},
c AS (SELECT count(DISTINCT ProductBrand) + max(CASE WHEN ProductBrand IS NULL THEN 1 ELSE 0 END) AS n_brands,
             count(DISTINCT Gender) + max(CASE WHEN Gender IS NULL THEN 1 ELSE 0 END) AS n_genders,
             count(DISTINCT PrimaryColor) + max(CASE WHEN PrimaryColor IS NULL THEN 1 ELSE 0 END) AS n_colors,
             round_even(avg(Price), 6) AS avg_price,
             {Q.pct("count_if(PriceCategory = 'Low')", 'count(*)', 6)} AS pct_low,
             {Q.pct("count_if(PriceCategory = 'Medium')", 'count(*)', 6)} AS pct_medium,
             {Q.pct("count_if(PriceCategory = 'High')", 'count(*)', 6)} AS pct_high FROM catalog),
m AS (SELECT round_even({Q.ratio("count_if(split = 'train')", 'count(*)')}, 6) AS train_ratio,
             round_even({Q.ratio("count_if(split = 'test')", 'count(*)')}, 6) AS test_ratio,
             round_even(100.0 * avg(CASE WHEN split = 'train' THEN CASE WHEN pred0 = label_idx THEN 1.0 ELSE 0.0 END END), 6) AS train_accuracy,
             round_even(100.0 * avg(CASE WHEN split = 'test' THEN CASE WHEN pred0 = label_idx THEN 1.0 ELSE 0.0 END END), 6) AS test_accuracy
      FROM scored)
SELECT * FROM c, m""")
def a23_report_facts(spark, d):
    """Catalog facts and the model's split/accuracy facts in one row; the
    model facts join the catalog row as scalar subqueries, not a cross join."""
    facts = C.catalog_facts(*([C.lines(spark, d), C.parts(spark, d)]))
    rf = _rf(spark, d, None)
    n = F.count(F.lit(1))
    is_tr, is_te = F.col("split") == "train", F.col("split") == "test"
    hit = (F.col("prediction") == F.col("label")).cast("double")
    m = rf.agg(F.bround(X.ratio(F.count_if(is_tr), n), 6).alias("train_ratio"),
               F.bround(X.ratio(F.count_if(is_te), n), 6).alias("test_ratio"),
               F.bround(F.avg(F.when(is_tr, hit)) * 100.0, 6).alias("train_accuracy"),
               F.bround(F.avg(F.when(is_te, hit)) * 100.0, 6).alias("test_accuracy"))
    return facts.withColumns({c: m.select(c).scalar() for c in m.columns})


@register("a19_ensemble_gain", f"""{WS}{_scores_sql()}{_vote_sql()}{_ENS_SQL},
b AS (SELECT max(score) AS best_single FROM scores)
SELECT round_even(best_single, 6) AS best_single, round_even(ensemble, 6) AS ensemble,
       round_even(ensemble - best_single, 6) AS gain,
       round_even(100.0 * {Q.ratio('ensemble - best_single', 'best_single')}, 6) AS gain_pct
FROM b, ens""")
def a19_ensemble_gain(spark, d):
    rows = _all_scores(spark, d)
    return E.ensemble_gain(_models_of(rows), _ensemble_of(rows))


@register("t4_best_model", f"""{WS}{_scores_sql()}
SELECT family, model, round_even(score, 6) AS score FROM scores ORDER BY score DESC, model LIMIT 1""")
def t4_best_model(spark, d):
    best = topk.arg_max(_scores(spark, d), "score", ["model"])
    return best.select("family", "model", F.bround("score", 6).alias("score"))


@register("m27_adaptive_rate", f"""{WS}{_scores_sql()}
SELECT model, round_even(CASE WHEN score < 0.95 THEN least(0.1, (0.95 - score) * 2.0) ELSE 0.01 END, 9)
       AS learning_rate FROM scores""")
def m27_adaptive_rate(spark, d):
    return _scores(spark, d).select("model", F.bround(E.adaptive_rate("score"), 9).alias("learning_rate"))


@register("p13_p14_misclassified", f"""{WS}{_rf_sql()}
SELECT product_id, l_orderkey, l_linenumber, label, prediction,
       CAST(label = prediction AS INTEGER) AS correct FROM rf WHERE label <> prediction""")
def p13_p14_misclassified(spark, d):
    from catalog_engine.operators.transforms import correct_flag
    mis = E.misclassified(correct_flag(_rf(spark, d)))
    return mis.select("product_id", "l_orderkey", "l_linenumber", "label", "prediction", "correct")


@register("t5_first_misclassified", f"""{WS}{_rf_sql()}
SELECT product_id, label, prediction FROM rf WHERE label <> prediction ORDER BY {ORDER_SQL} LIMIT 16""")
def t5_first_misclassified(spark, d):
    return E.first_misclassified(_rf(spark, d), ORDER, 16).select("product_id", "label", "prediction")


@register("d1_advice_by_prediction", f"""{WS}{_rf_sql()}
SELECT prediction, count(*) AS n, {fixtures.case_sql("prediction", fixtures.TIER_NOTES)} AS advice
FROM rf GROUP BY prediction""")
def d1_advice_by_prediction(spark, d):
    counts = _rf(spark, d).groupBy("prediction").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("advice", rules.note("prediction", fixtures.TIER_NOTES))


@register("d3_d4_model_bands", f"""{WS},
acc AS ({' UNION ALL '.join(
    f"SELECT '{m}' AS model, 100.0 * avg(CASE WHEN split = 'train' THEN CASE WHEN pred{i} = label_idx THEN 1.0 ELSE 0.0 END END) AS tr, "
    f"100.0 * avg(CASE WHEN split = 'test' THEN CASE WHEN pred{i} = label_idx THEN 1.0 ELSE 0.0 END END) AS te FROM scored"
    for i, (_, m, _) in enumerate(SC.MODELS))})
SELECT model, round_even(te, 6) AS accuracy_pct, round_even(tr - te, 6) AS overfit_gap,
       CASE WHEN te > 80 THEN 'good' ELSE 'needs work' END AS wording,
       CASE WHEN te >= 90 THEN 'excellent' WHEN te >= 80 THEN 'good' WHEN te >= 70 THEN 'fair' ELSE 'poor' END AS band,
       CASE WHEN tr - te < 5 THEN 'healthy' WHEN tr - te < 10 THEN 'mild overfit' ELSE 'overfit' END AS overfit_band
FROM acc""")
def d3_d4_model_bands(spark, d):
    df = _scored(spark, d)
    aggs = []
    for _, m, _ in SC.MODELS:
        hit = (X.argmax(f"p_{m}") == F.col("label_idx")).cast("double")
        aggs += [(F.avg(F.when(F.col("split") == "train", hit)) * 100.0).alias(f"{m}__tr"),
                 (F.avg(F.when(F.col("split") == "test", hit)) * 100.0).alias(f"{m}__te")]
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"{m}__tr").alias("tr"), F.col(f"{m}__te").alias("te"))
        for _, m, _ in SC.MODELS])).alias("s")).select("s.*")
    long = long.withColumns({"accuracy_pct": F.col("te"), "overfit_gap": F.col("tr") - F.col("te")})
    return long.select(
        "model", F.bround("accuracy_pct", 6).alias("accuracy_pct"),
        F.bround("overfit_gap", 6).alias("overfit_gap"),
        rules.accuracy_wording().alias("wording"), rules.accuracy_band().alias("band"),
        rules.overfit_band().alias("overfit_band"))


def _side_by_side_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT product_id, l_orderkey, l_linenumber, '{m}' AS model, {LBL(f'pred{i}')} AS prediction, conf{i} AS confidence "
        f"FROM scored WHERE split = 'test'" for i, (_, m, _) in enumerate(SC.MODELS))


@register("j4_m16_side_by_side", f"{WS} {_side_by_side_sql()}")
def j4_m16_side_by_side(spark, d):
    """All models' predictions of the same row: columns of one frame, then long rows."""
    df = _scored(spark, d).filter(F.col("split") == "test")
    names = F.array(*[F.lit(c) for c in T])
    per = [F.struct(F.lit(m).alias("model"), F.element_at(names, X.argmax(f"p_{m}") + 1).alias("prediction"),
                    F.array_max(f"p_{m}").alias("confidence")) for _, m, _ in SC.MODELS]
    return df.select("product_id", "l_orderkey", "l_linenumber", F.explode(F.array(*per)).alias("_m")).select(
        "product_id", "l_orderkey", "l_linenumber", "_m.*")
