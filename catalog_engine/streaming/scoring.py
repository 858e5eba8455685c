"""ST1: score arriving products with a fitted pipeline (Structured Streaming).

File source with a fixed schema -> ``PipelineModel.transform`` -> one Parquet partition for each
micro-batch. Stateless, so each micro-batch is independent; the checkpoint (in the cluster's
checkpoint folder unless given) makes the query restartable, and a replayed batch replaces its
own partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from catalog_engine import schema as S
from catalog_engine.operators import models as M
from catalog_engine.operators import rules
from catalog_engine.session import ensure_checkpoint_dir


def scored_rows(model: PipelineModel, rows: DataFrame, prefix: str, key: str = S.PRODUCT_ID, labels: list = S.TIERS,
                notes: dict | None = None) -> DataFrame:
    """(key, prediction, confidence, probability, and the caller's note on the prediction) of
    batch or streaming rows."""
    pred, prob = M.output_columns(prefix)
    names = F.array(*[F.lit(c) for c in labels])
    p = vector_to_array(F.col(prob))
    out = model.transform(rows).select(key, F.element_at(names, F.col(pred).cast("int") + 1).alias("prediction"),
                                       F.array_max(p).alias("confidence"), p.alias("probability"))
    return out.withColumn("advice", rules.note("prediction", notes)) if notes else out


def batch_writer(sink_dir: str):
    """Function of a micro-batch that writes its own partition batch=<id> anew: a batch that is
    replayed after a failure replaces what its first run left, so rows are never there twice."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/batch={batch_id}")

    return write


def start_scoring(spark: SparkSession, model: PipelineModel, source_dir: str, schema: StructType,
                  sink_dir: str, prefix: str, checkpoint: str | None = None, available_now: bool = True,
                  fmt: str = "parquet", prepare: Callable[[DataFrame], DataFrame] = lambda rows: rows,
                  key: str = S.PRODUCT_ID, labels: list = S.TIERS, notes: dict | None = None) -> StreamingQuery:
    """Start the scoring query; ``available_now`` processes what is there and stops. prepare
    derives the model's input from the source's rows. Without a checkpoint folder one is named after
    source and sink, so that two streams never share their state."""
    own = hashlib.sha256(f"{source_dir}|{sink_dir}".encode()).hexdigest()[:32]
    state = checkpoint or f"{ensure_checkpoint_dir(spark, allow_local=True).rstrip('/')}/streams/{own}"
    rows = prepare(spark.readStream.schema(schema).format(fmt).load(source_dir))
    w = (scored_rows(model, rows, prefix, key, labels, notes).writeStream.foreachBatch(batch_writer(sink_dir))
         .option("checkpointLocation", state))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
