"""File sources and sinks: catalog CSVs (S1-S3), model store (S9), cached
frames (S10), result store (S11)."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog_engine import schema as S
from catalog_engine.sources.catalog import REFERENCE_TIERS, SINGLE_SOURCE_TIERS, with_tier


@dataclass
class SourceSpec:
    """One catalog source: where it is, the columns it may have and their types,
    how they map to the common schema, its id column and its tier thresholds.

    CSV columns are found by their header name, in any order. A column that the
    schema has and the file lacks is null; ``required`` ones must be there."""
    name: str
    path: str
    schema: T.StructType = field(default_factory=lambda: S.RAW_CATALOG_CSV_SCHEMA)
    rename: dict = field(default_factory=lambda: {"Price (INR)": S.PRICE})
    key: str = "ProductID"
    tiers: tuple = REFERENCE_TIERS
    drop_missing: list = field(default_factory=lambda: [S.COLOR])
    default_images: int | None = None
    fmt: str = "csv"
    required: list = field(default_factory=lambda: [S.PRICE])


def retailer(name: str, path: str, columns: dict, key: str) -> SourceSpec:
    """A single retailer's CSV with its own column names (common name -> its
    name), the single-source tiers, and one image where it has no count."""
    types = {f.name: f.dataType for f in S.CATALOG_SCHEMA}
    schema = T.StructType([T.StructField(key, T.StringType()),
                           *[T.StructField(own, types[common]) for common, own in columns.items()]])
    return SourceSpec(name, path, schema, {own: common for common, own in columns.items()}, key,
                      SINGLE_SOURCE_TIERS, [], 1)


BAD_CELLS = "_bad_cells"


def _by_header(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A CSV's columns by header name, cast to the declared types; BAD_CELLS
    counts cells of a row that hold text which the type can't."""
    raw = spark.read.option("header", True).csv(spec.path)  # all columns text: nothing is inferred
    have = set(raw.columns)
    cell = {f.name: F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast("string") for f in spec.schema}
    typed = {f.name: cell[f.name].try_cast(f.dataType) for f in spec.schema}
    bad = [(cell[c].isNotNull() & (F.trim(cell[c]) != "") & typed[c].isNull()).cast("int") for c in cell]
    missing = [c for c in spec.schema.names if c not in have and spec.rename.get(c, c) in spec.required]
    if missing:
        raise ValueError(f"{spec.name}: no column {', '.join(missing)} in {sorted(have)}")
    return raw.select(*[typed[c].alias(c) for c in cell], reduce(lambda x, y: x + y, bad).alias(BAD_CELLS))


def read_source(spark: SparkSession, spec: SourceSpec, keep_bad: bool = False) -> DataFrame:
    """Declared types (never inferred), renamed, keyed, labelled.

    Rows with a cell that can't be read as its type are left out, not labelled
    (``keep_bad``: kept, with their number of such cells). ``product_id`` is the
    source's name and its own id, so ids of different sources never meet; a file
    without an id column gets the digest of the row."""
    if spec.fmt == "csv":
        df = _by_header(spark, spec)
    else:
        df = spark.read.schema(spec.schema).format(spec.fmt).load(spec.path).withColumn(BAD_CELLS, F.lit(0))
    own = F.col(f"`{spec.key}`").cast("string") if spec.key in df.columns else F.lit(None)
    digest = F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).cast("binary"))
    df = df.withColumn(S.PRODUCT_ID, F.concat(F.lit(f"{spec.name}:"), F.coalesce(own, digest)))
    df = df.withColumnsRenamed(spec.rename)
    if not keep_bad:
        df = df.filter(F.col(BAD_CELLS) == 0).drop(BAD_CELLS)
    if spec.drop_missing:
        df = df.na.drop(subset=[c for c in spec.drop_missing if c in df.columns])
    if spec.default_images is not None:
        img = F.col(S.IMAGES) if S.IMAGES in df.columns else F.lit(None)
        df = df.withColumn(S.IMAGES, F.coalesce(img, F.lit(spec.default_images)).cast("int"))
    df = df.withColumn(S.SOURCE, F.lit(spec.name))
    df = df.withColumn(S.PRICE, F.when(~F.isnan(F.col(S.PRICE)), F.col(S.PRICE)))
    return with_tier(df, spec.tiers)


def load_sources(spark: SparkSession, specs: list, harmonise: dict | None = None):
    """S3: load every source that can be read; a missing or unreadable one is
    skipped and reported. Raises when none loads.

    Returns (union by name, load report DataFrame(source, status, message)); the
    message of a loaded source tells how many rows were left out as unreadable.
    """
    frames, report = [], []
    for spec in specs:
        try:
            df = read_source(spark, spec, keep_bad=True)
            bad = df.filter(F.col(BAD_CELLS) > 0).count()
            frames.append(df.filter(F.col(BAD_CELLS) == 0).drop(BAD_CELLS))
            report.append((spec.name, "loaded", f"{bad} unreadable rows left out" if bad else None))
        except (AnalysisException, ValueError) as e:
            report.append((spec.name, "skipped", str(e).splitlines()[0][:300]))
    if not frames:
        raise FileNotFoundError("no catalog source could be loaded: "
                                + "; ".join(f"{n}: {m}" for n, _, m in report))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if harmonise:
        out = out.na.replace(harmonise, subset=[S.GENDER])
    rep = spark.createDataFrame(report, "source string, status string, message string")
    return out, rep


def save_model(model: PipelineModel, path: str) -> None:
    """Overwrite-save a fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(spark: SparkSession, path: str) -> PipelineModel | None:
    """The saved pipeline, or None when nothing was trained yet (the
    reference asks the user to train first)."""
    try:
        spark.read.text(f"{path.rstrip('/')}/metadata").limit(1).collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(path)


class Cached:
    """Keep a frame persisted for the length of a ``with`` block."""

    def __init__(self, df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK):
        self.df, self.level = df, level

    def __enter__(self) -> DataFrame:
        return self.df.persist(self.level)

    def __exit__(self, *exc):
        self.df.unpersist()
        return False


def store_results(df: DataFrame, path: str, run_id: str, table: str) -> None:
    """Store a result frame of one run under ``path/table/run_id=...``.
    Storing a run again replaces that run and no other."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{table}/run_id={run_id}")


def read_results(spark: SparkSession, path: str, table: str, run_id: str | None = None) -> DataFrame:
    """Read stored results back; a run filter prunes to one partition."""
    df = spark.read.parquet(f"{path.rstrip('/')}/{table}")
    return df.filter(F.col("run_id") == run_id) if run_id else df
