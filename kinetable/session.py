"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinetable")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config(CHECKPOINT_KEY, _own_folder())
        .getOrCreate()
    )


def setting(spark: SparkSession, key: str, default: int) -> int:
    """An integer option of the engine, read from the session."""
    return int(spark.conf.get(f"spark.kinetable.{key}", str(default)))


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the one the cluster names in ``spark.checkpoint.dir``. A local master
    has a single machine, so only there a temporary folder is as good.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
    context.setCheckpointDir(_own_folder())
    return context.getCheckpointDir()


def _own_folder() -> str:
    """A temporary folder that goes with the process."""
    folder = tempfile.mkdtemp(prefix="kinetable-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/kinetable/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, so a lost executor costs a re-read."""
    spark = df.sparkSession
    root = scratch_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
