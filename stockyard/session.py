"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "stockyard", memory: str = "12g") -> SparkSession:
    """A `local[n]` session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    The cluster names it in `spark.checkpoint.dir`. A folder of our own is made
    only on a local master where none is set; on a cluster that is an error,
    since a machine-local folder would vanish with its executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="stockyard-checkpoint-"))
    return sc.getCheckpointDir()


# Streams handle their batches in threads of their own.
_SCRATCH = threading.local()


def _scratches() -> list[str]:
    if not hasattr(_SCRATCH, "folders"):
        _SCRATCH.folders = []
    return _SCRATCH.folders


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder, or below the innermost `scratch`, for one run's tables."""
    inner = _scratches()
    root = inner[-1] if inner else checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Tables that are stored inside are removed at the end; write the results before that.

        with scratch(spark):
            admission_funnel(...).write.parquet(path)
    """
    folder = run_folder(spark, "scratch")
    _scratches().append(folder)
    try:
        yield folder
    finally:
        _scratches().remove(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write rows that several results share to the shared folder and read them from there.

    Unlike a checkpoint this is columnar, so readers prune columns, and its size
    is known to the planner.
    """
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint that keeps partitions and their order."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
