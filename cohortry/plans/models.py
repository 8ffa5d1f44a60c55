"""Training, evaluation and application of the ranking models."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import PipelineModel, classification as mc, regression as mr
from pyspark.ml import feature as mf
from pyspark.ml.feature import SQLTransformer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.operators.leastsq import LeastSquares
from cohortry.operators.metrics import agg_confusion, agg_r2
from cohortry.operators.prepare import OneHot, Standardiser, ml_folds, ml_impute_median, ml_split
from cohortry.operators.resample import ml_nearmiss, oversample
from cohortry.plans import features as ff
from cohortry.plans.body import ml_project_body
from cohortry.session import stage

# The boosting defaults and selection thresholds of the models.
BOOST_TREES = 100
BOOST_DEPTH = 3
BOOST_RATE = 0.1
IMPORTANCE_MIN = 0.01
COEFFICIENT_MIN = 1e-5
# Share of the largest variance that is added to each, as the library's Gaussian classifier has it.
VARIANCE_SHARE = 1e-9
FOLDS = 3


def booster(trees: int = BOOST_TREES, seed: int = 0, **kw) -> mc.GBTClassifier:
    return mc.GBTClassifier(maxIter=trees, maxDepth=BOOST_DEPTH, stepSize=BOOST_RATE, seed=seed, **kw)


# Estimators offered beside the default ones, by name; each takes the usual MLlib parameters.
CLASSIFIERS = {
    "boosted": booster,
    "gaussian": lambda **kw: mc.NaiveBayes(modelType="gaussian", **kw),
    "forest": mc.RandomForestClassifier,
    "tree": mc.DecisionTreeClassifier,
    "perceptron": mc.MultilayerPerceptronClassifier,
    "linear_svc": mc.LinearSVC,
    "logistic": mc.LogisticRegression,
}
REGRESSORS = {
    "linear": lambda **kw: mr.LinearRegression(regParam=0.0, **kw),
    "ridge": lambda regParam=1.0, **kw: mr.LinearRegression(regParam=regParam, elasticNetParam=0.0, **kw),
    "lasso": lambda regParam=1.0, **kw: mr.LinearRegression(regParam=regParam, elasticNetParam=1.0, **kw),
    "boosted": mr.GBTRegressor,
    "forest": mr.RandomForestRegressor,
    "tree": mr.DecisionTreeRegressor,
}
SCALERS = {
    "minmax": mf.MinMaxScaler,
    "maxabs": mf.MaxAbsScaler,
    "robust": mf.RobustScaler,
    "unit": mf.Normalizer,
}


def dealt_parts(width: int, members: int = 2) -> list[list[int]]:
    """Inputs dealt out to members in turn; a member without any gets them all."""
    return [list(range(m, width, members)) or list(range(width)) for m in range(members)]


class SoftVote:
    """Mean of the class probabilities of several fitted classifiers, each on all inputs or on its own."""

    def __init__(self, members: Sequence, slicers: Sequence[VectorSlicer] = ()):
        self.members, self.slicers = list(members), list(slicers)

    @classmethod
    def fit(cls, train: DataFrame, estimators: dict, parts: Sequence[Sequence[int]] | None = None) -> "SoftVote":
        """``train`` holds ``features`` and ``label``; ``parts`` are the inputs of each estimator."""
        fitted, slicers = [], []
        for k, (name, estimator) in enumerate(estimators.items()):
            features = "features"
            if parts is not None:
                features = f"_part_{name}"
                slicers.append(VectorSlicer(inputCol="features", outputCol=features, indices=list(parts[k])))
            rows = slicers[-1].transform(train) if parts is not None else train
            estimator = estimator.setFeaturesCol(features).setLabelCol("label").setPredictionCol(f"_pred_{name}")
            estimator = estimator.setProbabilityCol(f"_prob_{name}").setRawPredictionCol(f"_raw_{name}")
            fitted.append(estimator.fit(rows))
        return cls(fitted, slicers)

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for step in [*self.slicers, *self.members]:
            out = step.transform(out)
        shares = [vector_to_array(m.getProbabilityCol())[1] for m in self.members]
        mean = reduce(lambda a, b: a + b, shares) / float(len(shares))
        out = out.withColumn("probability", mean).withColumn("prediction", (mean > 0.5).cast("int"))
        scratch = [c for m in self.members for c in (m.getPredictionCol(), m.getProbabilityCol(), m.getRawPredictionCol())]
        return out.drop(*scratch, *[x.getOutputCol() for x in self.slicers])


def scale_stage(scaler: Standardiser) -> SQLTransformer:
    """The fitted scaler as a stage that is stored with the model."""
    z = [f"(`{c}` - {m!r}D) / {s!r}D AS `z_{c}`" for c, m, s in zip(scaler.columns, scaler.means, scaler.deviations)]
    return SQLTransformer(statement=f"SELECT *, {', '.join(z)} FROM __THIS__")


def text_stage(columns: Sequence[str]) -> SQLTransformer:
    casts = [f"CAST(`{c}` AS STRING) AS `_{c}`" for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(casts)} FROM __THIS__")


def _inputs(columns: Sequence[str], categorical: Sequence[str]) -> list[str]:
    out = {"player_id", "age1", "is_test", "fold", *ff.ADJUSTED_PARTS, *ff.LABEL_COLUMNS, *ff.TARGET_COLUMNS, *categorical}
    return [c for c in columns if c not in out]


class Preparation:
    """Scaling, encoding, assembling and selecting as one chain of fitted stages."""

    def __init__(self, stages: list, names: list[str]):
        self.stages, self.names = stages, names

    @classmethod
    def fit(cls, train: DataFrame, others: Sequence[DataFrame], scaled: Sequence[str], drop: Sequence[str], clusters: int, encode: str) -> "Preparation":
        scaler = Standardiser.fit(train, scaled)
        kept = [c for c in train.columns if c not in drop]
        categorical = [c for c in ff.CATEGORICAL + ff.CLUSTER_COLUMNS if c in kept]
        numeric = _inputs(kept, categorical)
        ordered = [f"z_{c}" if c in scaled else c for c in numeric]
        stages, names = [scale_stage(scaler)], list(numeric)
        hot = OneHot(categorical, encode).fit(train, *others)
        if hot.model is not None:
            stages += [text_stage(categorical), *hot.model.stages]
            names += [f"{c}={v}" for c, labels in hot.categories().items() for v in labels]
        stages.append(VectorAssembler(inputCols=ordered + hot.outputs, outputCol="all_features"))
        return cls(stages, names)

    def select(self, weights: Sequence[float], minimum: float) -> list[tuple[str, float]]:
        """Keep the inputs whose absolute weight reaches the minimum; all if none does."""
        picked = [i for i, w in enumerate(weights) if abs(w) >= minimum] or list(range(len(self.names)))
        self.stages.append(VectorSlicer(inputCol="all_features", outputCol="features", indices=picked))
        report = [(self.names[i], float(weights[i])) for i in picked]
        self.names = [self.names[i] for i in picked]
        return report

    def model(self, *more) -> PipelineModel:
        return PipelineModel(stages=[*self.stages, *more])


def ml_select_importance(train: DataFrame, label: str, trees: int = BOOST_TREES, seed: int = 0, features: str = "all_features") -> list[float]:
    """Importance of every input in a boosted-tree fit."""
    fitted = booster(trees, seed, featuresCol=features, labelCol=label).fit(train)
    return [float(v) for v in fitted.featureImportances.toArray()]


def ml_select_coef(train: DataFrame, label: str, names: Sequence[str], features: str = "all_features") -> list[float]:
    """Coefficient of every input in a linear fit; 0 for inputs that depend on earlier ones."""
    fitted = LeastSquares.fit(train, names, vector_to_array(features), F.col(label))
    return [c or 0.0 for c in fitted.coefficients]


def ml_ols_pvalues(train: DataFrame, inputs: Sequence[str], target: str) -> DataFrame:
    """Coefficients, t and p-values of a least-squares fit without intercept; NULL for inputs that depend on earlier ones."""
    fitted = LeastSquares.fit(train, inputs, F.array(*[F.col(c).cast("double") for c in inputs]), F.col(target), intercept=False)
    return fitted.frame(train.sparkSession)


def gaussian_vote(rows: DataFrame, width: int, fold: str | None = None) -> DataFrame:
    """``id, label, prediction, probability`` (and the fold) by a vote of two Gaussian classifiers on different inputs.

    With ``fold``, each row is judged by the models of the rows outside its fold, all folds in one pass: the sums of a
    fold are taken off the sums of all.  ``rows``: ``id, vec, label`` (0 or 1) and the fold.  To the driver go sums per
    fold, class and input.  A class that a training part lacks has no probability.
    """
    by = [fold] if fold else []
    entry = lambda i: F.col("vec")[i].cast("double")
    sums = rows.groupBy(*by, F.col("label").cast("int").alias("label")).agg(
        F.count("*").alias("n"),
        F.array(*[F.sum(entry(i)) for i in range(width)]).alias("s"),
        F.array(*[F.sum(entry(i) * entry(i)) for i in range(width)]).alias("q"),
    ).collect()
    figures = []
    for held in sorted({r[fold] for r in sums}) if fold else [None]:
        mine = [r for r in sums if not fold or r[fold] != held]
        of = {c: [[sum(x) for x in zip(*((r.n, *r.s, *r.q) for r in mine if r.label == c))]] for c in (0, 1)}
        total = sum(r.n for r in mine)
        for part in dealt_parts(width):
            whole = [[sum(getattr(r, a)[i] for r in mine) for i in part] for a in ("s", "q")] if mine else [[], []]
            floor = VARIANCE_SHARE * max((q / total - (x / total) ** 2 for x, q in zip(*whole)), default=0.0)
            shapes = []
            for c in (0, 1):
                n, *rest = of[c][0] or [0] * (2 * width + 1)
                means = [rest[i] / n for i in part] if n else [0.0] * len(part)
                spreads = [max(0.0, rest[width + i] / n - m * m) + floor for i, m in zip(part, means)] if n else [1.0] * len(part)
                start = math.log(n / total) - 0.5 * sum(math.log(2 * math.pi * max(v, 1e-300)) for v in spreads) if n else None
                shapes.append((start, [[float(i), m, max(v, 1e-300)] for i, m, v in zip(part, means, spreads)]))
            figures.append((held, shapes))
    spark = rows.sparkSession
    kinds = f"{fold + ' int, ' if fold else ''}start0 double, shape0 array<array<double>>, start1 double, shape1 array<array<double>>"
    table = [(*([held] if fold else []), zero[0], zero[1], one[0], one[1]) for held, (zero, one) in figures]
    # Two rows per fold, gathered into one array of members.
    members = spark.createDataFrame(table, kinds).groupBy(*by).agg(F.collect_list(F.struct("start0", "shape0", "start1", "shape1")).alias("members"))

    def score(m: Column, c: int) -> Column:
        def far(acc: Column, s: Column) -> Column:
            gap = F.get(F.col("vec"), s[0].cast("int")).cast("double") - s[1]
            return acc - gap * gap / (2 * s[2])

        return F.aggregate(m[f"shape{c}"], m[f"start{c}"], far)

    members = stage(members, "members")
    judged = rows.join(members, fold) if fold else rows.withColumn("members", members.select("members").scalar())
    def chance_of(m: Column) -> Column:
        lead = score(m, 0) - score(m, 1)
        return 1 / (1 + F.exp(F.when(lead > 700, 700.0).otherwise(lead)))

    chance = F.transform("members", chance_of)
    mean = F.aggregate(chance, F.lit(0.0), lambda a, x: a + x) / F.size(chance)
    judged = judged.withColumn("probability", mean).withColumn("prediction", (F.col("probability") > 0.5).cast("int"))
    return judged.select(*by, "id", "label", "prediction", "probability")


def rebalance(rows: DataFrame, imb: int, seed: int = 0) -> DataFrame:
    """``vec, label`` after oversampling (1), undersampling (2) or nothing (0)."""
    if imb == 1:
        return oversample(rows, "label", seed=seed)
    if imb == 2:
        return ml_nearmiss(rows, "label").select("vec", "label")
    return rows.select("vec", "label")


def _vote_fit(rows: DataFrame, imb: int, trees: int, seed: int, voters: str = "boosted", width: int = 0) -> SoftVote:
    balanced = rebalance(rows, imb, seed).select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    balanced = stage(balanced, "balanced")
    if voters == "gaussian":
        return SoftVote.fit(balanced, {"first": CLASSIFIERS["gaussian"](), "second": CLASSIFIERS["gaussian"]()}, dealt_parts(width))
    return SoftVote.fit(balanced, {"boosted": booster(trees, seed), "gaussian": CLASSIFIERS["gaussian"]()})


def _scored(vote: SoftVote, rows: DataFrame) -> DataFrame:
    return vote.transform(rows.select("id", "label", array_to_vector("vec").alias("features"))).select(
        "id", "label", "prediction", "probability"
    )


def ml_cv(
    rows: DataFrame, imb: int = 1, trees: int = BOOST_TREES, seed: int = 0, folds: int = FOLDS, voters: str = "boosted", width: int = 0
) -> DataFrame:
    """Metrics per fold; each fold's training part is rebalanced on its own.

    ``rows`` is a stored frame of ``id, vec, label``.  With Gaussian voters (on vectors of ``width`` numbers) and no
    rebalancing, the models of all folds come from one pass.
    """
    folded = stage(ml_folds(rows, "id", "label", folds, seed), "folds")
    if voters == "gaussian" and imb == 0:
        scored = gaussian_vote(folded, width, "fold")
        return agg_confusion(scored.withColumn("part", F.concat(F.lit("fold"), "fold")), by=["part"])
    parts = []
    for fold in range(folds):
        vote = _vote_fit(folded.where(F.col("fold") != fold).drop("fold"), imb, trees, seed, voters, width)
        parts.append(_scored(vote, folded.where(F.col("fold") == fold)).withColumn("part", F.lit(f"fold{fold}")))
    return agg_confusion(reduce(DataFrame.unionByName, parts), by=["part"])


def train_eval_classifier(
    features: DataFrame,
    *,
    adj: int = 1,
    clusters: int = 0,
    label: int = 2,
    imb: int = 1,
    threshold: float = IMPORTANCE_MIN,
    encode: str = "onehot",
    frac: float = 0.3,
    trees: int = BOOST_TREES,
    seed: int = 0,
    voters: str = "boosted",
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """Split, scale, encode, select, cross-validate, fit and test a classifier.

    ``voters``: boosted trees and a Gaussian classifier, inputs selected by importance (``boosted``); or two Gaussian
    classifiers on different inputs, selected by their coefficients in a linear fit (``gaussian``), all in closed form.

    Returns the model, the metrics (``part`` is ``fold0..`` or ``test``) and the selected
    inputs with their importance.  ``imb`` is 0 for none, 1 for over-, 2 for undersampling.
    """
    target = f"classifier{label}"
    split = stage(ml_split(features, "player_id", frac, seed, by=[target]), "split")
    train, test = split.where("not is_test"), split.where("is_test")
    drop = ff.variant_drop_list(adj, clusters, "class")
    prep = Preparation.fit(train, [test], ff.SCALED_CLASS, drop, clusters, encode)
    encoded = prep.model().transform(train)
    if voters == "gaussian":
        weights = ml_select_coef(encoded, target, prep.names)
    else:
        weights = ml_select_importance(encoded, target, trees, seed)
    chosen = prep.select(weights, threshold)
    prepared = prep.model().transform(split).select(
        F.col("player_id").alias("id"), vector_to_array("features").alias("vec"), F.col(target).alias("label"), "is_test"
    )
    prepared = stage(prepared, "prepared")
    fit_rows = prepared.where("not is_test").drop("is_test")
    cv = ml_cv(fit_rows, imb, trees, seed, voters=voters, width=len(prep.names))
    vote = _vote_fit(fit_rows, imb, trees, seed, voters, len(prep.names))
    tested = agg_confusion(_scored(vote, prepared.where("is_test")).withColumn("part", F.lit("test")), by=["part"])
    spark = features.sparkSession
    return (
        prep.model(*vote.slicers, *vote.members),
        cv.unionByName(tested),
        spark.createDataFrame(chosen, "feature string, weight double"),
    )


def train_eval_regressor(
    features: DataFrame,
    *,
    adj: int = 1,
    clusters: int = 0,
    target: str = "p_gp",
    threshold: float = COEFFICIENT_MIN,
    encode: str = "onehot",
    frac: float = 0.3,
    seed: int = 0,
) -> tuple[PipelineModel, DataFrame, DataFrame, DataFrame]:
    """Split, scale, encode, select, fit and test a linear regressor.

    Returns the model, its r2 on the held-out part, t and p-values of the selected inputs in a fit without
    intercept, and the selected inputs with their coefficients.
    """
    split = stage(ml_split(features, "player_id", frac, seed), "split")
    train, test = split.where("not is_test"), split.where("is_test")
    drop = ff.variant_drop_list(adj, clusters, "regr")
    prep = Preparation.fit(train, [test], ff.SCALED_REGR, drop, clusters, encode)
    encoded = prep.model().transform(train)
    prep.select(ml_select_coef(encoded, target, prep.names), threshold)
    rows = stage(prep.model().transform(train).select("features", target), "selected")
    plain = LeastSquares.fit(rows, prep.names, vector_to_array("features"), F.col(target), intercept=False)
    pvalues = plain.frame(features.sparkSession)
    linear = mr.LinearRegression(featuresCol="features", labelCol=target, predictionCol="prediction", regParam=0.0).fit(rows)
    model = prep.model(linear)
    quality = agg_r2(model.transform(test), target, "prediction")
    chosen = list(zip(prep.names, [float(c) for c in linear.coefficients]))
    return model, quality, pvalues, features.sparkSession.createDataFrame(chosen, "feature string, weight double")


def prepare_cohort(cohort: DataFrame, height: PipelineModel, weight: PipelineModel) -> DataFrame:
    """Fill the summed rate of the first age with its median and project the body figures."""
    return ml_project_body(ml_impute_median(cohort, "adj_p_a17", "player_id"), height, weight)


def rank_predictions(scored: DataFrame, by: Sequence[str] = ("prediction", "probability"), top_n: int | None = None) -> DataFrame:
    """Highest first, ties by entity; ``top_n`` keeps the head without a full sort."""
    ordered = scored.orderBy(*[F.desc(c) for c in by], "player_id")
    return ordered if top_n is None else ordered.limit(top_n)


def rank_all(scored: DataFrame, by: Sequence[str] = ("prediction", "probability"), key: str = "player_id") -> DataFrame:
    """Every row with its ``rank`` in the order of ``rank_predictions``, from 1.

    The order is cut into ranges; rows are numbered within their range and shifted by the sizes of the ranges before, so
    no task sees more than a range.  Equal scores are told apart by the entity, so many of them are many ranges.
    """
    order = [*[F.desc_nulls_last(c) for c in by], F.asc(key)]
    ranges = stage(scored.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    # One row per range, which is one per shuffle partition.
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranges.withColumn("_inside", inside).join(stage(before, "range-sizes"), "_range")
    return ranked.withColumn("rank", F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def score_cohort_classifier(cohort: DataFrame, model: PipelineModel, height: PipelineModel, weight: PipelineModel) -> DataFrame:
    """Prediction and probability per entity of the cohort, ranked."""
    members = [s for s in model.stages if hasattr(s, "getProbabilityCol")]
    steps = PipelineModel(stages=[s for s in model.stages if s not in members])
    ready = steps.transform(prepare_cohort(cohort, height, weight))
    scored = SoftVote(members).transform(ready).select("player_id", "prediction", "probability")
    return rank_predictions(scored)


def score_cohort_regressor(cohort: DataFrame, model: PipelineModel, height: PipelineModel, weight: PipelineModel, name: str = "p_gp") -> DataFrame:
    """Predicted rate per entity of the cohort, ranked."""
    scored = model.transform(prepare_cohort(cohort, height, weight)).select("player_id", F.col("prediction").alias(name))
    return rank_predictions(scored, [name])
