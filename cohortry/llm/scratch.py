"""Intermediate tables in the shared folder, removed as soon as they are used up."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from cohortry.session import SETTINGS, ensure_checkpoint_dir


class Scratch:
    """One folder below ``spark.checkpoint.dir`` for the tables of one operator call.

    ``keep`` writes a table there and reads it back, which cuts lineage: a lost executor costs a re-read.
    ``drop`` removes tables that no later step reads.  What the returned frame still reads stays until the
    session ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
        for key, value in SETTINGS.items():
            if key != "spark.sql.session.timeZone":
                spark.conf.set(key, value)
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def read_all(self, names: list[str], like: DataFrame) -> DataFrame:
        """Tables of one schema in one scan, which deals their files into tasks together."""
        return self.spark.read.schema(like.schema).parquet(*map(self.path, names))

    def drop(self, *names: str) -> None:
        """Remove the named tables, or everything."""
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        for path in [self.path(n) for n in names] or [self.root]:
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
        if names:
            self.release()

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs, which it does when the driver's collector finds them unused."""
        self.spark.sparkContext._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
