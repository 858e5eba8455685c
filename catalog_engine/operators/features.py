"""Feature encoders and transforms.

Relational forms are exact and oracle-checked; ML forms (StringIndexer,
StandardScaler, VectorAssembler, PCA) are the stages used in model pipelines.
Fitted statistics are a handful of scalars or one row per category, so they
are cheap to compute with partial aggregation and safe to broadcast.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog_engine.functions import exprs as X
from catalog_engine.session import ensure_checkpoint_dir


PART_BITS = 33


def positions(rows: DataFrame, col: str, out: str) -> DataFrame:
    """Rows of distinct, non-null values of col with their places 0..k-1 in its order, never
    brought together: rows are dealt to ranges and sorted there, numbered within their range,
    and shifted by the sizes of the ranges before. The numbered rows are checkpointed, since a
    second run could draw other ranges."""
    ensure_checkpoint_dir(rows.sparkSession, allow_local=True)
    mark = "_position"
    numbered = (rows.repartitionByRange(col).sortWithinPartitions(col)
                .withColumn(mark, F.monotonically_increasing_id()).checkpoint())
    # monotonically_increasing_id: the partition above PART_BITS bits, the place in it below
    part, place = F.shiftright(mark, PART_BITS), F.col(mark).bitwiseAND((1 << PART_BITS) - 1)
    starts, total = [], 0
    for r in numbered.groupBy(part.cast("int").alias("part")).count().orderBy("part").collect():  # one row for each range
        starts.append((r["part"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    placed = numbered.withColumn("_part", part.cast("int")).join(F.broadcast(offsets), "_part")
    return placed.select(*rows.columns, (F.col("_start") + place).cast("int").alias(out))


def label_codes(values: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """F9/F15 relational: sorted distinct values -> 0..k-1 (``LabelEncoder``), for any number
    of values."""
    return positions(values.select(col).filter(F.col(col).isNotNull()).distinct(), col, out or f"{col}_ix")


BROADCAST_CODES = 100_000
"""A code table of so many rows at most is broadcast; a longer one is joined as the planner sees fit."""


def encode(df: DataFrame, codes: DataFrame, col: str, handle_unknown: str = "error") -> DataFrame:
    """attach codes; an unseen category raises (``keep`` gives code k)."""
    out = [c for c in codes.columns if c != col][0]
    k = codes.count()
    joined = df.join(F.broadcast(codes) if k <= BROADCAST_CODES else codes, col, "left")
    if handle_unknown == "keep":
        return joined.withColumn(out, F.coalesce(F.col(out), F.lit(k)))
    return joined.withColumn(out, F.when(F.col(out).isNotNull() | F.col(col).isNull(), F.col(out))
                             .otherwise(F.raise_error(F.concat(F.lit("unseen label: "), F.col(col)))))


def string_indexer(col: str, out: str | None = None, handle_invalid: str = "error") -> StringIndexer:
    """F9 as an ML stage: alphabetical codes, like ``LabelEncoder``."""
    return StringIndexer(inputCol=col, outputCol=out or f"{col}_ix",
                         stringOrderType="alphabetAsc", handleInvalid=handle_invalid)


def standardize(df: DataFrame, cols: list, fit_on: DataFrame | None = None,
                digits: int | None = None) -> DataFrame:
    """F11 relational: (x - mean) / population sd, statistics from ``fit_on``
    (the training rows). Statistics arrive as scalar subqueries, no join."""
    src = fit_on if fit_on is not None else df
    out = {}
    for c in cols:
        mu = src.select(F.avg(c)).scalar()
        sd = src.select(F.stddev_pop(c)).scalar()
        z = F.when(sd == 0, F.lit(0.0)).otherwise((F.col(c) - mu) / sd)
        out[f"{c}_z"] = F.bround(z, digits) if digits is not None else z
    return df.withColumns(out)


def standard_scaler(inp: str, out: str) -> StandardScaler:
    """F11 as an ML stage. Spark divides by the sample deviation; the factor
    sqrt(n / (n - 1)) separates it from scikit-learn's population one."""
    return StandardScaler(inputCol=inp, outputCol=out, withMean=True, withStd=True)


def assembler(cols: list, out: str = "features") -> VectorAssembler:
    """text vector first, then the metadata columns (importance slicing
    relies on metadata being last)."""
    return VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep")


def to_array(col: str):
    """vector -> array<double>, only where an array op needs it."""
    return vector_to_array(F.col(col))


def covariance(df: DataFrame, cols: list) -> DataFrame:
    """(i, j, covariance) of numeric columns, i <= j, by one aggregate: the sums of entries
    and of products are taken in one pass, exact for whole numbers. Sample covariance, null
    under two rows; a row with a null in any column takes no part."""
    exact = lambda c: c.cast("decimal(38,0)") if whole else c.cast("double")
    whole = all(t in ("tinyint", "smallint", "int", "bigint") for c, t in df.dtypes if c in cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = df.na.drop(subset=cols).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(exact(F.col(c))).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.sum(exact(F.col(cols[i]).cast("decimal(19,0)" if whole else "double") * F.col(cols[j]))).alias(f"p{i}_{j}") for i, j in pairs])
    d = lambda c: F.col(c).cast("double")
    entries = [F.struct(F.lit(cols[i]).alias("i"), F.lit(cols[j]).alias("j"),
                        F.when(F.col("n") > 1, (d(f"p{i}_{j}") - d(f"s{i}") * d(f"s{j}") / d("n")) / (d("n") - 1)).alias("covariance"))
               for i, j in pairs]
    return sums.select(F.explode(F.array(*entries)).alias("_e")).select("_e.*")


def principal_axes(entries: DataFrame, cols: list, k: int = 2) -> np.ndarray:
    """the first k eigenvectors (rows) of a covariance table; the entry of largest size of
    each is positive, so signs don't depend on the solver."""
    matrix = np.zeros((len(cols), len(cols)))
    for r in entries.collect():  # one row for each pair of columns
        i, j = cols.index(r["i"]), cols.index(r["j"])
        matrix[i, j] = matrix[j, i] = r["covariance"]
    values, vectors = np.linalg.eigh(matrix)
    axes = vectors[:, np.argsort(-values, kind="stable")[:k]].T
    largest = axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)]
    return axes * np.sign(np.where(largest == 0, 1, largest))[:, None]


def project(df: DataFrame, cols: list, axes: np.ndarray, out: str = "pc") -> DataFrame:
    """centred columns times the axes, as <out>1, <out>2, ...; row-local but for the means,
    taken over the rows without nulls."""
    means = [df.na.drop(subset=cols).select(F.avg(c)).scalar() for c in cols]
    centred = [F.col(c).cast("double") - m for c, m in zip(cols, means, strict=True)]
    return df.withColumns({f"{out}{n}": sum((c * float(a) for c, a in zip(centred, axis, strict=True)), F.lit(0.0))
                           for n, axis in enumerate(axes, 1)})


def pca_2d(inp: str, out: str = "pca") -> list:
    """centre, then two principal components (Spark's PCA does not centre)."""
    return [StandardScaler(inputCol=inp, outputCol="_centred", withMean=True, withStd=False),
            PCA(k=2, inputCol="_centred", outputCol=out)]


def split_digest(keys: list, seed: int = X.MULT_SPLIT) -> Column:
    """Hexadecimal md5 of the keys as text and a seed: the order in which rows are drawn."""
    return F.md5(F.concat(F.concat_ws("-", *keys), F.lit(f"|{seed}")).cast("binary"))


REFINE_DIGITS, LAST_ROWS = 3, 4096
"""Digits that a round of refinement looks at, and rows that the last one may order."""


def smallest(rows: DataFrame, digest: str, share: float) -> str | None:
    """The ceil(share * n)-th smallest of a column of hexadecimal strings of one length, by
    refinement: each round counts rows by their next digits (at most 4,096 counts) and
    descends into the one bin that holds the wanted row. No sort but of the last bin."""
    prefix, rest = "", None
    while True:
        digits = F.substring(digest, len(prefix) + 1, REFINE_DIGITS)
        inside = rows.where(F.col(digest).startswith(prefix)) if prefix else rows
        counts = sorted(tuple(r) for r in inside.groupBy(digits.alias("digits")).count().collect())
        rest = math.ceil(share * sum(n for _, n in counts)) if rest is None else rest
        if not rest:
            return None
        for part, n in counts:
            if rest <= n:
                break
            rest -= n
        prefix += part
        if n <= LAST_ROWS or not part:
            last = rows.where(F.col(digest).startswith(prefix)).orderBy(digest).limit(rest)
            return last.agg(F.max(digest)).first()[0]


def exact_split(df: DataFrame, keys: list, test_share: float, seed: int = X.MULT_SPLIT, out: str = "split") -> DataFrame:
    """exactly ceil(share * n) rows are 'test', the others 'train'. The cut is found by
    ``smallest``; the split itself is a filter, so it needs no shuffle and stays the same when
    rows are computed again. keys: columns that tell rows apart; rows that repeat all keys of the
    row at the cut go to its side with it. An empty table stays empty."""
    cut = smallest(df.select(split_digest(keys, seed).alias("_digest")), "_digest", test_share)
    test = F.lit(False) if cut is None else split_digest(keys, seed) <= cut
    return df.withColumn(out, F.when(test, "test").otherwise("train"))


def split_column(key: str, test_share: float, out: str = "split"):
    """'train' / 'test' by a seeded hash of the key (stable under repartitioning)."""
    return F.when(X.is_test_row(key, test_share), F.lit("test")).otherwise(F.lit("train")).alias(out)
