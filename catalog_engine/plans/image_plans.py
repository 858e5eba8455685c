"""Image-side queries over the ``embeddings`` table (the decoded-picture stand-in):
class names (J2), per-split class counts (A17/J5), first picture per class (W1),
soft-max over logits (F16), array reshaping and scaling (P18, P19, X4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators import stats
from catalog_engine.plans.registry import register
from catalog_engine.sources import images as IM
from catalog_engine.sources.catalog import read_table

CLASSES_SQL = "classes(label, class_name) AS (VALUES " + ", ".join(
    f"({i}, '{n}')" for i, n in enumerate(IM.CLASS_NAMES)) + ")"
SPLIT_SQL = f"CASE WHEN {Q.is_test_row('vec_id', 0.2, X.MULT_SPLIT)} THEN 'test' ELSE 'train' END"


def _emb(spark, d):
    return read_table(spark, d, "embeddings")


@register("a17_j2_class_split_counts", f"""WITH {CLASSES_SQL},
c AS (SELECT label, CAST(count_if({SPLIT_SQL} = 'train') AS BIGINT) AS n_train,
             CAST(count_if({SPLIT_SQL} = 'test') AS BIGINT) AS n_test FROM embeddings GROUP BY label)
SELECT classes.label, class_name, coalesce(n_train, 0) AS n_train, coalesce(n_test, 0) AS n_test
FROM classes LEFT JOIN c USING (label)""")
def a17_j2_class_split_counts(spark, d):
    df = _emb(spark, d).select("label", F.when(X.is_test_row("vec_id", 0.2), "test")
                               .otherwise("train").alias("split"))
    counts = stats.split_class_counts(df, "label")
    dom = F.broadcast(IM.class_frame(spark))
    out = dom.join(counts, "label", "left")
    return out.select("label", "class_name",
                      F.coalesce("n_train", F.lit(0)).cast("long").alias("n_train"),
                      F.coalesce("n_test", F.lit(0)).cast("long").alias("n_test"))


@register("w1_first_per_class", f"""WITH {CLASSES_SQL}
SELECT e.label, min(vec_id) AS vec_id, any_value(class_name) AS class_name
FROM embeddings e LEFT JOIN classes USING (label) GROUP BY e.label""")
def w1_first_per_class(spark, d):
    first = stats.first_per_class(_emb(spark, d).select("label", "vec_id"), "label", "vec_id")
    return IM.with_class_names(first).select("label", "vec_id", "class_name")


_SOFTMAX_SQL = """
entries AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
means AS (SELECT label, i, round_even(avg(x), 9) AS m FROM entries GROUP BY label, i),
centres AS (SELECT list(c ORDER BY label) AS centres FROM (SELECT label, list(m ORDER BY i) AS c FROM means GROUP BY label)),
z AS (SELECT vec_id, label, list_transform(centres, lambda c: list_inner_product(c, CAST(embedding AS DOUBLE[]))) AS z
      FROM embeddings, centres),
e AS (SELECT vec_id, label, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM z),
p AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)"""


def _centre_logits(spark, d):
    """(vec_id, label, z): a logit for each class, the inner product of the whole vector with
    the mean vector of the class. The classes' means are a few rows, read as one scalar."""
    emb = _emb(spark, d)
    means = (emb.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i")
             .agg(F.bround(F.avg(F.col("x").cast("double")), 9).alias("m")))
    centre = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("c"))
    centres = centre.select(F.transform(F.sort_array(F.collect_list(F.struct("label", "c"))), lambda e: e["c"])).scalar()
    vectors = emb.select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"), centres.alias("centres"))
    inner = lambda c: F.aggregate(F.zip_with(c, "v", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return vectors.select("vec_id", "label", F.transform("centres", inner).alias("z"))


@register("f16_softmax_argmax", f"""WITH {_SOFTMAX_SQL}
SELECT vec_id, label, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS pred,
       round_even(list_max(p), 9) AS p_max FROM p""")
def f16_softmax_argmax(spark, d):
    p = _centre_logits(spark, d).withColumn("p", X.softmax("z"))
    return p.select("vec_id", "label", X.argmax("p").alias("pred"),
                    F.bround(F.array_max("p"), 9).alias("p_max"))


@register("m24_softmax_logloss_by_class", f"""WITH {_SOFTMAX_SQL}, {CLASSES_SQL}
SELECT p.label, class_name, count(*) AS n,
       round_even(avg(CASE WHEN list_position(p, list_max(p)) - 1 = p.label THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round_even(avg(-ln(greatest(least(p[p.label + 1], {Q.dbl(1 - 1e-7)}), {Q.dbl(1e-7)}))), 6) AS loss
FROM p LEFT JOIN classes USING (label) GROUP BY p.label, class_name""")
def m24_softmax_logloss_by_class(spark, d):
    """M24 per class on the soft-max of the class-mean logits."""
    p = _centre_logits(spark, d).withColumn("p", X.softmax("z"))
    pl = F.element_at("p", F.col("label") + 1)
    clipped = F.greatest(F.least(pl, F.lit(1 - 1e-7)), F.lit(1e-7))
    agg = p.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.bround(F.avg((X.argmax("p") == F.col("label")).cast("double")), 6).alias("accuracy"),
        F.bround(F.avg(-F.ln(clipped)), 6).alias("loss"))
    return IM.with_class_names(agg).select("label", "class_name", "n", "accuracy", "loss")


@register("p18_p19_x4_pixel_arrays", """
WITH g AS (SELECT vec_id, label, list_transform(range(0, 8), lambda i: list_slice(embedding, i * 8 + 1, i * 8 + 8)) AS grid
           FROM embeddings),
f AS (SELECT vec_id, label, flatten(grid) AS flat FROM g)
SELECT vec_id, label, CAST(len(flat) AS INTEGER) AS n_pixels,
       round_even(CAST(list_max(flat) AS DOUBLE) / 255.0, 9) AS max_scaled,
       CAST(list_position(flat, list_max(flat)) AS INTEGER) AS argmax_pos,
       round_even(CAST(flat[64] AS DOUBLE), 9) AS last_pixel FROM f""")
def p18_p19_x4_pixel_arrays(spark, d):
    """An 8 x 8 grid view of each 64-value vector, flattened back, scaled."""
    e = _emb(spark, d).select("vec_id", "label", IM.to_grid("embedding", 8, 8).alias("grid"))
    f = e.withColumn("flat", F.transform(IM.flatten_grid("grid"), lambda x: x.cast("double")))
    f = IM.scale_pixels(f, "flat", "scaled")
    return f.select("vec_id", "label", F.size("flat").alias("n_pixels"),
                    F.bround(F.array_max("scaled"), 9).alias("max_scaled"),
                    F.array_position("flat", F.array_max("flat")).cast("int").alias("argmax_pos"),
                    F.bround(F.element_at("flat", 64), 9).alias("last_pixel"))
