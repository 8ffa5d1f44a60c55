"""Splitting, folding, scaling, imputing and encoding of feature frames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortry.operators.ordering import digest, exact_median, null_safe_join, order_cuts, take_smallest, with_cuts, within_cut
from cohortry.session import stage


def ml_split(df: DataFrame, key: str, frac: float = 0.3, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Mark the test part: the first ``ceil(frac * n)`` rows, per stratum if given.

    Rows are ordered by a seeded digest of their key, so the same rows fall on the same
    side on every run and in every engine.
    """
    return take_smallest(df, key, lambda n: F.ceil(n * F.lit(frac)), strata=by, seed=seed, flag="is_test")


def ml_folds(df: DataFrame, key: str, label: str, k: int = 3, seed: int = 0) -> DataFrame:
    """Assign stratified folds as consecutive runs of each class.

    Classes are laid end to end in label order, and position ``p`` of that line counts
    towards fold ``p mod k``; a class fills its folds in order with those counts.
    """
    # One row per class: where its run starts on the line, NULL last.
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    line = Window.orderBy(F.asc_nulls_last(label)).rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select(label, (F.sum("_n").over(line) - F.col("_n")).alias("_start"))
    placed = null_safe_join(df, stage(starts, "class-starts"), [label])

    def upto(i: int):
        def below(end: Column) -> Column:
            """Places before ``end`` that count towards the folds up to ``i``."""
            return F.floor(end / k) * (i + 1) + F.least(end % k, F.lit(i + 1))

        return lambda n: below(F.col("_start") + n) - below(F.col("_start"))

    cuts = order_cuts(placed, key, [upto(i) for i in range(k - 1)], strata=[label, "_start"], seed=seed).drop("_start")
    marked = with_cuts(df, cuts, [label])
    text = digest(key, seed)
    fold = F.lit(0)
    for i in range(k - 1):
        cut = F.col("_cuts")[F.lit(i)]
        before = within_cut(F.lit(0.0), text, cut["cut_value"], cut["cut_digest"])
        fold = fold + F.when(before, 0).otherwise(1)
    return marked.withColumn("fold", fold.cast("int")).drop("_cuts")


@dataclass(frozen=True)
class Standardiser:
    """Per-column mean and population deviation of a training frame."""

    columns: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame, columns: Sequence[str]) -> "Standardiser":
        row = train.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.stddev_pop(c).alias(f"s_{c}") for c in columns],
        ).first()
        means = tuple(float(row[f"m_{c}"] or 0.0) for c in columns)
        spreads = tuple(float(row[f"s_{c}"] or 0.0) or 1.0 for c in columns)
        return cls(tuple(columns), means, spreads)

    def transform(self, df: DataFrame) -> DataFrame:
        """Scale the columns; a column without spread is only centred."""
        scaled = {
            c: (F.col(c) - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.columns, self.means, self.deviations)
        }
        return df.withColumns(scaled)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.columns, self.means, self.deviations))
        return spark.createDataFrame(rows, "feature string, mean double, deviation double")

    def save(self, spark: SparkSession, path: str) -> None:
        self.frame(spark).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Standardiser":
        rows = spark.read.parquet(path).collect()
        return cls(
            tuple(r.feature for r in rows), tuple(r["mean"] for r in rows), tuple(r.deviation for r in rows)
        )


def agg_moments(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation of each column, one row per column, in one pass."""
    entries = [
        F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("deviation"))
        for c in columns
    ]
    return train.agg(F.array(*entries).alias("m")).select(F.inline("m"))


def ml_impute_median(df: DataFrame, column: str, key: str) -> DataFrame:
    """Fill NULLs of a column with the exact median of its known values."""
    middle = exact_median(df, column, key).agg(F.max("median").alias("m")).scalar()
    return df.withColumn(column, F.coalesce(F.col(column).cast("double"), middle))


class OneHot:
    """Indicator columns for categorical columns, with categories from several frames."""

    def __init__(self, columns: Sequence[str], encode: str = "onehot"):
        if encode not in ("onehot", "drop"):
            raise ValueError("encode is 'onehot' or 'drop'")
        self.columns, self.encode = list(columns), encode
        self.encoded: list[str] = []
        self.model: PipelineModel | None = None

    @property
    def outputs(self) -> list[str]:
        return [f"{c}_vec" for c in self.encoded]

    def _text(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"_{c}": F.col(c).cast("string") for c in self.columns})

    def fit(self, *frames: DataFrame) -> "OneHot":
        if self.encode == "onehot":
            both = self._text(frames[0]).select(*[f"_{c}" for c in self.columns])
            for other in frames[1:]:
                both = both.unionByName(self._text(other).select(*[f"_{c}" for c in self.columns]))
            index = StringIndexer(
                inputCols=[f"_{c}" for c in self.columns],
                outputCols=[f"{c}_idx" for c in self.columns],
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            )
            fitted = index.fit(both)
            # A column without any value in the frames has nothing to encode.
            self.encoded = [c for c, labels in zip(self.columns, fitted.labelsArray) if labels]
            # "keep" gives unseen categories the last index; dropping it makes them all zero.
            hot = OneHotEncoder(
                inputCols=[f"{c}_idx" for c in self.encoded], outputCols=self.outputs, dropLast=True
            )
            stages = [fitted, hot.fit(fitted.transform(both))] if self.encoded else [fitted]
            self.model = PipelineModel(stages=stages)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if self.encode == "drop":
            return df.drop(*self.columns)
        out = self.model.transform(self._text(df))
        return out.drop(*[f"_{c}" for c in self.columns], *[f"{c}_idx" for c in self.columns], *self.columns)

    def categories(self) -> dict[str, list[str]]:
        if self.model is None:
            return {}
        named = zip(self.columns, self.model.stages[0].labelsArray)
        return {c: list(labels) for c, labels in named if c in self.encoded}

    def long_form(self, df: DataFrame, key: str) -> DataFrame:
        """One row per key, column and category with its indicator."""
        parts = [
            F.arrays_zip(
                F.array(*[F.lit(c) for _ in labels]).alias("feature"),
                F.array(*[F.lit(v) for v in labels]).alias("category"),
                F.transform(vector_to_array(f"{c}_vec"), lambda x: x.cast("int")).alias("hot"),
            )
            for c, labels in self.categories().items()
        ]
        if not parts:
            return df.select(key, F.lit("").alias("feature"), F.lit("").alias("category"), F.lit(0).alias("hot")).limit(0)
        encoded = self.transform(df)
        return encoded.select(key, F.inline(F.concat(*parts)))
