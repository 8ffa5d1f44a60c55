"""Projection of adult height and weight from measurements at the draft."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from cohortry.functions import scalar as fn
from cohortry.operators.metrics import agg_r2
from cohortry.operators.prepare import ml_split

# Draft years used for training and the model inputs.
YEARS = (2014, 2018)
INPUTS = ["age0", "height0", "weight0", "pos_flag"]


def join_draft_measure(draft: DataFrame, bios: DataFrame, measured: DataFrame) -> DataFrame:
    """Draft picks with their biography and their measurements of that draft."""
    picks = draft.select("player_id", "year", "ov")
    people = bios.select("player_id", "dob", F.col("height").alias("height1"), F.col("weight").alias("weight1"), F.col("pos2").alias("pos"))
    then = measured.select("year", "ov", F.col("height").alias("height0"), F.col("weight").alias("weight0"))
    return picks.join(then, ["year", "ov"]).join(people, "player_id")


def body_training_set(draft: DataFrame, bios: DataFrame, measured: DataFrame, years: tuple[int, int] = YEARS) -> DataFrame:
    """Age, height and weight at the draft beside the adult figures."""
    rows = join_draft_measure(draft.where(F.col("year").between(*years)), bios, measured)
    known = rows.where(F.col("height1").isNotNull() & F.col("weight1").isNotNull() & F.col("pos").isNotNull())
    return known.select(
        "player_id",
        fn.decimal_age(fn.cutoff_date("year"), "dob").alias("age0"),
        "height0", "weight0", "height1", "weight1", "pos",
    )


def fit_body(training: DataFrame, var: str = "height", frac: float = 0.3, seed: int = 0) -> tuple[PipelineModel, DataFrame]:
    """Linear model of the adult figure and its r2 on the held-out part; NULL ages are left out."""
    rows = training.withColumn("pos_flag", fn.position_flag("pos"))
    split = ml_split(rows, "player_id", frac, seed)
    model = Pipeline(
        stages=[
            VectorAssembler(inputCols=INPUTS, outputCol="body_features", handleInvalid="skip"),
            LinearRegression(
                featuresCol="body_features", labelCol=f"{var}1", predictionCol=f"{var}_adult", solver="normal", regParam=0.0
            ),
        ]
    ).fit(split.where("not is_test"))
    held_out = model.transform(split.where("is_test"))
    return model, agg_r2(held_out, f"{var}1", f"{var}_adult")


def ml_project_body(cohort: DataFrame, height: PipelineModel, weight: PipelineModel) -> DataFrame:
    """Replace height and weight by their adult projections from ``age1``."""
    inputs = cohort.withColumns(
        {
            "age0": F.col("age1"),
            "height0": F.col("height").cast("double"),
            "weight0": F.col("weight").cast("double"),
            "pos_flag": fn.position_flag("pos"),
        }
    )
    tall = height.transform(inputs).drop("body_features")
    both = weight.transform(tall).drop("body_features")
    return both.withColumns({"height": F.col("height_adult"), "weight": F.col("weight_adult")}).drop(
        *INPUTS, "height_adult", "weight_adult"
    )
