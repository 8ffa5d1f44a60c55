"""Session settings and lineage cutting."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings the jobs are written for.  Skewed joins are split by AQE at
# run time; forcing the split even when it costs one more shuffle keeps a key that
# holds a large share of the rows from becoming a single task.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app: str = "cohortry", cpus: int | str = "*") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    shuffle = str(cpus if isinstance(cpus, int) else os.cpu_count() or 8)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("COHORTRY_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", shuffle)
    )
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def apply_settings(spark: SparkSession) -> None:
    """Set the run-time settings on a session that was made elsewhere."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Remove a staged folder when the session ends; results that are read lazily need it until then."""

    def remove() -> None:
        context = spark.sparkContext
        if context._jsc is not None:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)

    atexit.register(remove)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that holds checkpoints.

    The cluster names a shared folder in ``spark.checkpoint.dir``.  A temporary
    folder is only used where nothing is configured and the session is local.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="cohortry-checkpoint-")
    context.setCheckpointDir(configured)
    return configured


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result as a columnar table in the shared folder and read it back.

    Later jobs scan only the columns they need, and a lost executor costs a re-read.
    """
    folder = f"{ensure_checkpoint_dir(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    path = f"{folder}/{name}"
    remove_at_exit(df.sparkSession, folder)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*staged: DataFrame) -> None:
    """Remove staged tables that nothing reads any more, and let Spark remove the shuffle files of finished jobs."""
    for df in staged:
        context, files = df.sparkSession.sparkContext, df.inputFiles()
        if files:
            target = context._jvm.org.apache.hadoop.fs.Path(files[0]).getParent().getParent()
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
    if staged:
        context._jvm.System.gc()
