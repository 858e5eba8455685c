"""Frequency-table classifiers of the price tier, fitted and applied relationally.

Each model predicts a row's tier from one or two categorical features of its
line and part: the class counts of the feature value among the training rows,
with one added to each class, divided by their sum. Fitting is one aggregate
over the training rows (all models at once, as long rows), applying is a join
with the counts. Counts are integers and the division is one IEEE operation,
so Spark and DuckDB agree bit for bit, and the queries on model outputs have
exact oracles. The models read different features, so they disagree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine import schema as S
from catalog_engine.functions import exprs as X
from catalog_engine.functions import sqltext as Q
from catalog_engine.operators.evaluate import tier_index

#: (family, model, features). All features have fixed, small domains.
MODELS = [
    ("structured", "quantity", ["NumImages"]),
    ("structured", "brand", ["ProductBrand"]),
    ("structured", "type", ["Gender"]),
    ("structured", "source", ["DataSource"]),
    ("structured", "line_number", ["l_linenumber"]),
    ("text", "first_word", ["PrimaryColor"]),
    ("text", "last_word", ["LastWord"]),
    ("text", "first_word_by_source", ["PrimaryColor", "DataSource"]),
    ("transfer", "quantity_by_source", ["NumImages", "DataSource"]),
    ("transfer", "brand_by_quantity", ["ProductBrand", "NumImages"]),
]
TEST_SHARE = 0.2
#: The vote takes five of these seven: the soft vote's limit applies.
VOTERS = [m for f, m, _ in MODELS if f != "text"]
MAX_VOTERS = 5
FIRST = MODELS[0][1]
NO_VALUE = "?"


def model_index(model: str) -> int:
    return [m for _, m, _ in MODELS].index(model)


def _feature(columns: list) -> Column:
    """A model's feature value as text."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)) for c in columns])


def scored(tiered_lines: DataFrame, part_df: DataFrame, models: list | None = None) -> DataFrame:
    """Catalog rows with split, label and one probability array per model."""
    used = [(m, cols) for _, m, cols in MODELS if models is None or m in models]
    if any(c in {S.BRAND, S.GENDER, S.COLOR, "LastWord"} for _, cols in used for c in cols):
        words = part_df.withColumn("LastWord", F.element_at(F.split(F.col(S.NAME), " "), -1))
        tiered_lines = tiered_lines.join(words, F.col("l_partkey") == F.col("p_partkey"), "left")
    base = tiered_lines.select(
        S.PRODUCT_ID, "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.PRICE,
        F.when(X.is_test_row(S.PRODUCT_ID, TEST_SHARE), F.lit("test")).otherwise(F.lit("train")).alias("split"),
        F.col(S.TIER).alias("label"), tier_index(S.TIER).alias("label_idx"),
        *[_feature(cols).alias(f"f_{m}") for m, cols in used])
    long = base.filter(F.col("split") == "train").select(
        "label_idx", F.explode(F.array(*[F.struct(F.lit(model_index(m)).alias("m"), F.col(f"f_{m}").alias("v")) for m, _ in used])).alias("_f"))
    # the model's number is also an aggregate: a filter on the key itself would move below the
    # aggregate, and every model would read and count the rows for itself instead of reusing one exchange
    counts = long.groupBy(F.col("_f.m").alias("m"), F.col("_f.v").alias("v")).agg(
        F.max("_f.m").alias("model"), *[F.count_if(F.col("label_idx") == j).alias(f"n{j}") for j in range(3)])

    one = F.lit(1.0)
    n = [F.col(f"n{j}").cast("double") + one for j in range(3)]
    unseen = F.array(*[one / (one + one + one)] * 3)

    def apply(df: DataFrame, model: str) -> DataFrame:
        # probabilities belong to a feature's value: divided there, not once more in every row.
        # adaptive execution broadcasts the table where its size, known by then, allows it
        own = counts.filter(F.col("model") == model_index(model)).select(
            F.col("v").alias(f"f_{model}"), F.array(*[x / (n[0] + n[1] + n[2]) for x in n]).alias("_p"))
        return df.join(own, f"f_{model}", "left").withColumn(f"p_{model}", F.coalesce("_p", unseen)).drop("_p", f"f_{model}")

    return reduce(apply, [m for m, _ in used], base)


def scored_sql() -> str:
    """DuckDB ``WITH`` body defining ``scored`` (needs ``catalog``) with columns
    p{i}_{j} plus pred{i} (argmax) and conf{i} (max)."""
    def feature(cols):
        names = {"LastWord": "list_last(string_split(ProductName, ' '))"}
        return "concat_ws('|', " + ", ".join(f"coalesce(CAST({names.get(c, c)} AS VARCHAR), '{NO_VALUE}')" for c in cols) + ")"

    split = f"CASE WHEN {Q.is_test_row('product_id', TEST_SHARE, X.MULT_SPLIT)} THEN 'test' ELSE 'train' END"
    idx = "CASE PriceCategory WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 END"
    tables, joins, parts, derived = [], [], [], []
    for i, (_, _model, cols) in enumerate(MODELS):
        tables.append(f"m{i} AS (SELECT f{i} AS v, " + ", ".join(f"count_if(label_idx = {j}) AS c{j}" for j in range(3))
                      + " FROM scored0 WHERE split = 'train' GROUP BY 1)")
        joins.append(f"LEFT JOIN m{i} ON m{i}.v = s.f{i}")
        n = [f"(CAST(coalesce(m{i}.c{j}, 0) AS DOUBLE) + {Q.dbl(1)})" for j in range(3)]
        parts += [f"{n[j]} / ({n[0]} + {n[1]} + {n[2]}) AS p{i}_{j}" for j in range(3)]
        p = [f"p{i}_{j}" for j in range(3)]
        derived.append(f"CASE WHEN {p[0]} >= {p[1]} AND {p[0]} >= {p[2]} THEN 0 "
                       f"WHEN {p[1]} >= {p[2]} THEN 1 ELSE 2 END AS pred{i}")
        derived.append(f"greatest({p[0]}, {p[1]}, {p[2]}) AS conf{i}")
    features = ", ".join(f"{feature(cols)} AS f{i}" for i, (_, _, cols) in enumerate(MODELS))
    return f"""
scored0 AS (
  SELECT product_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, Price,
         {split} AS split, PriceCategory AS label, {idx} AS label_idx, {features}
  FROM catalog),
{', '.join(tables)},
scored1 AS (SELECT s.*, {', '.join(parts)} FROM scored0 s {' '.join(joins)}),
scored AS (SELECT *, {', '.join(derived)} FROM scored1)"""


def label_of(idx_sql: str) -> str:
    return f"['Low', 'Medium', 'High'][{idx_sql} + 1]"
