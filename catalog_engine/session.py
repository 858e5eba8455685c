"""Session construction and cluster-facing settings.

The library never invents storage locations on a cluster: the checkpoint
folder comes from ``spark.checkpoint.dir`` (or an already-set SparkContext
checkpoint dir). Only ``local_session`` (tests, bench) fills it in when unset.
"""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours should carry. Shuffle partitions are left to
# the caller: 8 on local[8], thousands on a real cluster, and AQE coalesces.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app_name: str = "catalog_engine", driver_memory: str = "16g",
                  extra: dict | None = None) -> SparkSession:
    """A local-mode session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark, allow_local=True)
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names, if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d
    return spark.sparkContext.getCheckpointDir()


def ensure_checkpoint_dir(spark: SparkSession, allow_local: bool = False) -> str:
    """Return the checkpoint folder; create a scratch one only in local mode."""
    d = checkpoint_dir(spark)
    if d:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return d
    master = spark.sparkContext.master
    if not (allow_local and re.match(r"local(\[|$)", master)):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; a shared folder is required on a cluster")
    d = tempfile.mkdtemp(prefix="ce-ckpt-", dir=os.environ.get("CE_SCRATCH", "/tmp"))
    try:
        spark.conf.set("spark.checkpoint.dir", d)
    except Exception:  # static on some builds; the context setting suffices
        pass
    spark.sparkContext.setCheckpointDir(d)
    return d
