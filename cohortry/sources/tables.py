"""Named tables, bound queries, result sinks and stored models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def src_table(spark: SparkSession, name: str, columns: Sequence[str] = ("*",)) -> DataFrame:
    """A projection of a catalog table or view."""
    return spark.table(name).select(*columns)


def src_param_query(spark: SparkSession, text: str, args: dict, **frames: DataFrame) -> DataFrame:
    """A query with named values bound by Spark; frames are referred to as ``{name}``."""
    return spark.sql(text, args=args, **frames)


def sink_replace(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Overwrite a Parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def sink_parts(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Overwrite those partitions of a Parquet table that ``df`` has rows of; the others stay as they are.

    For split frames and prediction tables that are stored per position, label and year and written one at a
    time.  A partition of which ``df`` has no rows is not touched, so nothing is lost by writing an empty frame.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def sink_ctas(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Store a derived table in the catalog under a name, replacing an earlier one."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def sink_model(model: PipelineModel, path: str) -> None:
    """Store a fitted model; its input names live in its stages."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
