"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every job of the library.  AQE re-plans joins and
# partition counts from runtime statistics and splits skewed shuffle
# partitions; the session time zone is pinned so date arithmetic is stable.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpointed intermediate tables are deleted from the shared folder
    # once no DataFrame refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Cluster sizing (applied to non-local sessions, e.g. under spark-submit,
# and only where the user has not set a value).  Many initial
# shuffle partitions let AQE coalesce down to ~256 MB each at runtime, so a
# 100 TB line scan and its store-day shuffle keep partitions that fit an
# executor; skewed partitions above 512 MB are split in joins.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8192",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "16m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
}


def get_spark(app: str = "retail_signal", master: str | None = None,
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Return a session with the library defaults.

    On a cluster ``master`` stays ``None`` so spark-submit decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if master and master.startswith("local"):
        # Local mode runs everything in the driver JVM; give it the memory
        # an executor would have (only effective before the JVM starts).
        conf["spark.driver.memory"] = os.environ.get("RETAIL_SIGNAL_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    if not _is_local(spark):
        explicit = spark.sparkContext.getConf()
        for k, v in CLUSTER_CONF.items():
            if k not in conf and not explicit.contains(k):
                spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a private
    temporary folder; a cluster session without it is an error, because a
    machine-local folder does not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                           "(HDFS / object store) before running the pipeline")
    path = tempfile.mkdtemp(prefix="retail_signal_ckpt_")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it
    back.

    Used where a table is read several times (global statistics, null
    report, fills): a lost executor re-reads the table instead of
    recomputing the raw lines, and unlike a row checkpoint each reader
    still prunes columns and pushes filters.  Never ``localCheckpoint``.
    ``compression``: the Parquet codec, if not the session's.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_wide_code(spark: SparkSession) -> None:
    """The JVM compiles no method of over 8,000 bytes of bytecode: the one
    method of a whole stage that computes dozens of columns stays interpreted.
    From that size on Spark is to run the stage from split methods instead,
    unless the session names a limit of its own."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":  # Spark's default
        spark.conf.set(key, "8000")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context, so
    that functions that run in tasks import there without an installation."""
    sc = spark.sparkContext
    if getattr(sc, "_retail_signal_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="retail_signal_py_"), "retail_signal.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._retail_signal_shipped = True
