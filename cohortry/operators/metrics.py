"""Model quality figures as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cohortry.functions.scalar import safe_div


def agg_confusion(df: DataFrame, label: str = "label", prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts with accuracy, precision, recall and F1; an undefined ratio is 0."""

    def cell(actual: int, predicted: int, name: str) -> Column:
        return F.count_if((F.col(label) == actual) & (F.col(prediction) == predicted)).alias(name)

    def ratio(top: Column, bottom: Column) -> Column:
        return F.coalesce(safe_div(top, bottom), F.lit(0.0))

    counts = df.groupBy(*by).agg(cell(1, 1, "tp"), cell(0, 1, "fp"), cell(1, 0, "fn"), cell(0, 0, "tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def agg_r2(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Coefficient of determination: one less the residual over the total sum of squares."""
    known = df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    residual = F.sum(F.pow(F.col(label) - F.col(prediction), F.lit(2.0)))
    total = F.var_pop(label) * F.count(F.lit(1))
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (1.0 - residual / F.nullif(total, F.lit(0.0))).alias("r2"),
    )
