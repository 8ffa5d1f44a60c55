"""Class rebalancing: oversampling by interpolation, undersampling by nearness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from cohortry.operators.knn import join_knn
from cohortry.operators.ordering import digest_fraction, take_smallest
from cohortry.session import stage

# Copies of one seed row are laid out in runs of this length.
RUN = 1_000
MARGIN = 1.0
# Rows that vote on a seed, and how far beyond a safe seed a made row may lie.
VOTERS = 10
OUT_STEP = 0.5
MARGIN_DIGITS = 9


def class_sizes(df: DataFrame, label: str) -> tuple[int, int, int, int]:
    """``(minority label, its size, majority label, its size)`` of a binary label."""
    rows = df.groupBy(label).count().orderBy("count", F.desc(label)).limit(3).collect()
    if len(rows) != 2:
        raise ValueError("rebalancing needs exactly two classes")
    return rows[0][label], rows[0]["count"], rows[1][label], rows[1]["count"]


def linear_border(df: DataFrame, label: str, minority_value, vec_col: str = "vec") -> tuple[list[float], float]:
    """Weights and intercept of a linear separator, positive on the minority's side."""
    signed = F.when(F.col(label) == minority_value, 1.0).otherwise(0.0)
    prepared = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"), signed.alias("y"))
    model = LinearSVC(labelCol="y", featuresCol="features", maxIter=20, regParam=0.01).fit(prepared)
    return [float(w) for w in model.coefficients], float(model.intercept)


def border_rows(minority: DataFrame, border: tuple[Sequence[float], float], vec_col: str = "vec") -> DataFrame:
    """Minority rows on or inside the margin of a linear separator."""
    weights, intercept = border
    margin = F.aggregate(
        F.zip_with(F.col(vec_col), F.array(*[F.lit(float(w)) for w in weights]), lambda a, w: a.cast("double") * w),
        F.lit(float(intercept)),
        lambda acc, v: acc + v,
    )
    return minority.where(F.round(margin, MARGIN_DIGITS) <= MARGIN)


def vote_on_seeds(seeds: DataFrame, rows: DataFrame, label: str, minority_value, voters: int = VOTERS) -> DataFrame:
    """Seeds with their ``kind``, by the classes of their nearest rows among all rows.

    ``noise`` where all of them are of the majority, ``danger`` where at least half are, else ``safe``.  The votes are
    counted by seed after a join on the neighbour's id, so no row's class is collected anywhere.
    """
    near = join_knn(seeds, rows, voters, exclude_self=True).select(F.col("left_id").alias("id"), F.col("right_id").alias("voter"))
    classes = rows.select(F.col("id").alias("voter"), (F.col(label) != minority_value).alias("other"))
    votes = near.join(classes, "voter").groupBy("id").agg(F.count_if("other").alias("against"), F.count("*").alias("votes"))
    kind = F.when(F.col("against") == F.col("votes"), "noise").when(2 * F.col("against") >= F.col("votes"), "danger").otherwise("safe")
    return seeds.join(votes.select("id", kind.alias("kind")), "id")


def ml_smote(
    df: DataFrame,
    label: str,
    *,
    id_col: str = "id",
    vec_col: str = "vec",
    k: int = 5,
    variant: str = "svm",
    seed: int = 0,
    border: tuple[Sequence[float], float] | None = None,
    voters: int = VOTERS,
    out_step: float = OUT_STEP,
) -> DataFrame:
    """Synthetic minority rows that bring the classes to equal size.

    A synthetic row lies on the line through a minority row, its seed, and one of the seed's ``k`` nearest
    minority rows.  With ``plain`` the seeds are all minority rows and made rows lie between the two.  With ``svm`` they are
    those near a linear class border, fitted unless ``border`` (weights, intercept) is given, on which the
    ``voters`` nearest rows of both classes vote: noise is no seed, made rows of an endangered seed lie
    between the two, those of a safe seed lie beyond it, away from the neighbour, by up to ``out_step`` of the distance.
    Without any seed left all minority rows serve, as in ``plain``.  Seeds share the copies evenly, the remainder going to the first in
    digest order; copy ``c`` goes to neighbour ``1 + c mod k``, at a distance drawn from the
    digest of seed, neighbour and copy.

    Returns ``seed_id, neighbour_id, copy, lambda, kind, step, vec, label`` for the new rows only; ``step`` is the signed
    share of the way to the neighbour.
    """
    if variant not in ("svm", "plain"):
        raise ValueError("variant is 'svm' or 'plain'")
    minority_value, n_min, _, n_maj = class_sizes(df, label)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), label)
    minority = rows.where(F.col(label) == minority_value).select("id", "vec")
    seeds = minority.withColumn("kind", F.lit("danger"))
    if variant == "svm":
        near = border_rows(minority, border or linear_border(rows, label, minority_value))
        judged = stage(vote_on_seeds(near, rows, label, minority_value, voters).where("kind <> 'noise'"), "seeds")
        seeds = seeds if judged.isEmpty() else judged
    n_seeds = seeds.count()
    missing = n_maj - n_min
    each, rest = divmod(missing, n_seeds)
    shared = take_smallest(seeds, "id", lambda n: F.lit(rest), seed=seed, flag="extra")
    copies = F.lit(each) + F.col("extra").cast("int")
    runs = shared.withColumn("copies", copies).where("copies > 0")
    runs = runs.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / RUN).cast("int"))))
    if each > RUN:
        runs = runs.repartition("id", "run")
    first = F.col("run") * RUN
    made = runs.select(
        F.col("id").alias("seed_id"),
        F.col("vec").alias("seed_vec"),
        "kind",
        F.explode(F.sequence(first, F.least(first + RUN, F.col("copies")) - 1)).alias("copy"),
    )
    near = join_knn(seeds, minority, k, exclude_self=True)
    reach = min(k, n_min - 1)
    if reach < 1:
        raise ValueError("interpolation needs at least two minority rows")
    # The neighbours' vectors meet the made rows only, not all pairs of seeds and neighbours.
    pairs = near.select(F.col("left_id").alias("seed_id"), F.col("right_id").alias("neighbour_id"), "rank")
    drawn = made.withColumn("rank", (F.col("copy") % reach + 1).cast("int")).join(pairs, ["seed_id", "rank"])
    drawn = drawn.join(minority.select(F.col("id").alias("neighbour_id"), F.col("vec").alias("near_vec")), "neighbour_id")
    text = F.md5(F.concat_ws(":", "seed_id", "neighbour_id", "copy", F.lit(seed)))
    mixed = F.zip_with(
        "seed_vec", "near_vec",
        lambda a, b: a.cast("double") + (b.cast("double") - a.cast("double")) * F.col("step"),
    )
    step = F.when(F.col("kind") == "safe", -out_step * F.col("lambda")).otherwise(F.col("lambda"))
    return drawn.withColumn("lambda", digest_fraction(text)).withColumn("step", step).select(
        "seed_id", "neighbour_id", "copy", "lambda", "kind", "step", mixed.alias("vec"), F.lit(minority_value).alias(label)
    )


def oversample(df: DataFrame, label: str, *, id_col: str = "id", vec_col: str = "vec", **kw) -> DataFrame:
    """The rows of ``df`` and the synthetic ones, as ``vec, label``."""
    extra = ml_smote(df, label, id_col=id_col, vec_col=vec_col, **kw).select("vec", label)
    own = df.select(F.col(vec_col).cast("array<double>").alias("vec"), label)
    return own.unionByName(extra)


def near_miss_scores(df: DataFrame, label: str, *, id_col: str = "id", vec_col: str = "vec", k: int = 3, sizes: tuple | None = None) -> DataFrame:
    """Mean distance of each majority row to its ``k`` nearest minority rows."""
    minority_value, _, majority_value, _ = sizes or class_sizes(df, label)
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label).alias("y"))
    near = join_knn(rows.where(F.col("y") == majority_value), rows.where(F.col("y") == minority_value), k)
    return near.groupBy(F.col("left_id").alias("id")).agg(F.round(F.avg("distance"), 6).alias("mean_distance"))


def ml_nearmiss(df: DataFrame, label: str, *, id_col: str = "id", vec_col: str = "vec", k: int = 3) -> DataFrame:
    """All minority rows and as many majority rows, those nearest to the minority."""
    sizes = class_sizes(df, label)
    minority_value, n_min, majority_value, _ = sizes
    scores = stage(near_miss_scores(df, label, id_col=id_col, vec_col=vec_col, k=k, sizes=sizes), "scores")
    kept = take_smallest(scores, "id", lambda n: F.least(n, F.lit(n_min)), value="mean_distance", flag="kept")
    majority = df.where(F.col(label) == majority_value).join(
        kept.where("kept").select(F.col("id").alias(id_col)), id_col, "left_semi"
    )
    return df.where(F.col(label) == minority_value).unionByName(majority)
