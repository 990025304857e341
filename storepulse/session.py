"""Session construction and lineage-cutting helpers.

The cluster names a shared checkpoint folder in ``spark.checkpoint.dir``; we read it from the
session and only fall back to a scratch folder when it is unset (tests on one machine).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Session settings we rely on: AQE re-plans joins and coalesces partitions at runtime, its
# skew-join handling splits oversized shuffle partitions, UTC keeps timestamps comparable with
# the DuckDB oracle, and the UI server stays off.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
BATCH_BYTES = 4 << 20  # of an Arrow batch between a task and its Python worker, about


def get_spark(master: str | None = None, app: str = "storepulse",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the SparkContext.

    Uses ``spark.checkpoint.dir`` when the cluster sets it; otherwise (one machine, local master)
    creates a fresh scratch folder. On any other master a missing setting is an error: a folder of
    the driver's own machine would be invisible to the executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="storepulse-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    sc.setCheckpointDir(path)
    return path


def bounded_batches(spark: SparkSession) -> None:
    """From now on tasks of this session hand rows to their Python workers in batches of about ``BATCH_BYTES``.

    By Spark's default of 64 MB a task holds most of its partition's texts twice, as vectors in the JVM and as a batch in
    Python. No row is cut: a longer text makes a batch of its own, and a group still arrives whole, in more batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    This computes the plan once (``Dataset.checkpoint`` would compute it a second time to write
    it), keeps it columnar, and the result survives executor loss. Never machine-local."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
