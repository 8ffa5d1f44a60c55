"""Clustering of the adjusted-rate frame and what a cluster says about its members."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, functions as F

from cohortry.functions.scalar import safe_div
from cohortry.operators.ordering import digest
from cohortry.session import stage

# Numbers of clusters, elbow grid, games of a season and of a career.
LEVELS = (50, 100, 200)
ELBOW_GRID = tuple(range(25, 351, 25))
SEASON_GAMES = 82
CAREER_GAMES = 164
RATE_COLUMNS = ["g_a17", "g_a18", "a_a17", "a_a18"]
AGE_WEIGHTS = (1, 2, 1, 2)
GRAIN = 1_000_000
ROUNDS = 20
POINTS_A_SLICE = 1_000
# The centres of each level, in whole millionths.
Centres = dict[int, np.ndarray]


def cluster_inputs(rates: DataFrame) -> DataFrame:
    """Four dimensions in which the second age weighs twice.

    Listing a dimension twice and scaling it by the root of two give the same distances.
    """
    root = math.sqrt(2.0)
    return rates.select(
        "*",
        F.col("g_a17").cast("double").alias("c1"), (F.col("g_a18") * root).alias("c2"),
        F.col("a_a17").cast("double").alias("c3"), (F.col("a_a18") * root).alias("c4"),
    )


def _assembled(rates: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=["c1", "c2", "c3", "c4"], outputCol="cluster_features").transform(
        cluster_inputs(rates)
    )


def whole_rates(rates: DataFrame) -> DataFrame:
    """``player_id, p``: the rates as whole millionths, so that sums and distances do not depend on their order."""
    whole = [F.round(F.round(F.col(c).cast("double"), 6) * GRAIN).cast("bigint") for c in RATE_COLUMNS]
    return rates.select(F.col("player_id").cast("bigint").alias("player_id"), F.array(*whole).alias("p"))


def _gaps(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, in which the second age weighs twice."""
    return ((points[:, None, :] - centres[None]) ** 2 * np.array(AGE_WEIGHTS)).sum(axis=2)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for at in range(0, batch.num_rows, POINTS_A_SLICE):
        part = batch.slice(at, POINTS_A_SLICE)
        yield part.column(0), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1)


def _centre_sums(points: DataFrame, centres: Centres) -> DataFrame:
    """``level, centre, n, s0..s3``: the points nearest to each centre of every level, added up within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {k: np.zeros((len(c), 1 + len(RATE_COLUMNS)), np.int64) for k, c in centres.items()}
        for batch in batches:
            for _, p in _slices(batch):
                for k, c in centres.items():
                    label = _gaps(p, c).argmin(axis=1)
                    np.add.at(sums[k], label, np.hstack([np.ones((len(p), 1), np.int64), p]))
        for k, total in sums.items():
            hit = np.flatnonzero(total[:, 0])
            columns = [np.full(len(hit), k, np.int32), hit.astype(np.int32), *total[hit].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["level", "centre", "n", "s0", "s1", "s2", "s3"])

    parts = points.mapInArrow(run, "level int, centre int, n bigint, s0 bigint, s1 bigint, s2 bigint, s3 bigint")
    return parts.groupBy("level", "centre").agg(*[F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2", "s3")])


def lloyd(rates: DataFrame, levels: Sequence[int] = LEVELS, seed: int = 0, rounds: int = ROUNDS) -> Centres:
    """Centres of every level after at most ``rounds`` rounds of nearest centre and mean.

    The first centres of a level are the first entities by digest, as many as the level or as there are.  Ties go to
    the lower centre, means are rounded half up to whole millionths, a centre without points stays.  All levels share
    a pass over the points; each round's centres are a stored table, and the rounds end when none moves.  Only centres
    go to the driver: the sum of the levels.
    """
    points = stage(whole_rates(rates), "points")
    first = points.select(digest("player_id", seed).alias("text"), "p").orderBy("text", "p").limit(max(levels)).collect()
    centres = {k: np.array([r.p for r in first[:k]], np.int64).reshape(-1, len(RATE_COLUMNS)) for k in levels}
    for r in range(rounds if first else 0):
        means = [F.expr(f"(2 * s{i} + n - pmod(2 * s{i} + n, 2 * n)) div (2 * n)") for i in range(len(RATE_COLUMNS))]
        found = stage(_centre_sums(points, centres).select("level", "centre", F.array(*means).alias("c")), f"centres{r}").collect()
        moved = {k: c.copy() for k, c in centres.items()}
        for x in found:
            moved[x.level][x.centre] = x.c
        if all((moved[k] == centres[k]).all() for k in levels):
            break
        centres = moved
    return centres


def lloyd_assign(rates: DataFrame, centres: Centres) -> DataFrame:
    """``player_id``, and for each level ``clusters<k>`` and ``gap<k>``, the squared distance in square millionths."""
    names = [f(k) for k in centres for f in (lambda k: f"clusters{k}", lambda k: f"gap{k}")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, p in _slices(batch):
                columns = [ids]
                for c in centres.values():
                    gaps = _gaps(p, c)
                    columns += [pa.array(gaps.argmin(axis=1).astype(np.int32)), pa.array(gaps.min(axis=1))]
                yield pa.RecordBatch.from_arrays(columns, ["player_id", *names])

    kinds = ", ".join(f"clusters{k} int, gap{k} bigint" for k in centres)
    return whole_rates(rates).mapInArrow(run, f"player_id bigint, {kinds}")


def ml_kmeans(rates: DataFrame, levels: Sequence[int] = LEVELS, seed: int = 0, max_iter: int = 20) -> PipelineModel:
    """One clustering per level fitted by the library instead, from its own first centres; outputs ``clusters<k>``."""
    rows = _assembled(rates).select("cluster_features").cache()
    try:
        fits = [
            KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="cluster_features", predictionCol=f"clusters{k}").fit(rows)
            for k in levels
        ]
    finally:
        rows.unpersist()
    return PipelineModel(stages=fits)


def ml_kmeans_assign(rates: DataFrame, model: PipelineModel) -> DataFrame:
    """Nearest centre at every level, in one pass over the rows."""
    return model.transform(_assembled(rates)).drop("cluster_features", "c1", "c2", "c3", "c4")


def nearest_centre(points: DataFrame, centres: DataFrame, vec_col: str = "vec") -> DataFrame:
    """Index of the nearest of a small table of centres ``(centre, vec)``; ties to the lower index.

    The centres travel as one array; there are as many as clusters.
    """
    listed = centres.agg(F.array_sort(F.collect_list(F.struct("centre", F.col("vec").alias("at")))).alias("c")).scalar()
    gaps = F.transform(
        F.col("_centres"),
        lambda c: F.struct(
            F.round(
                F.aggregate(F.zip_with(c["at"], F.col(vec_col), lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v), 6
            ).alias("gap"),
            c["centre"].alias("centre"),
        ),
    )
    return points.withColumn("_centres", listed).withColumn("_best", F.array_min(gaps)).select(
        *points.columns, F.col("_best.centre").alias("cluster"), F.col("_best.gap").alias("gap")
    )


def player_clusters(rates: DataFrame, pos: str, levels: Sequence[int] = LEVELS, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Cluster of every entity at the three levels, with the columns of the default levels."""
    assigned = lloyd_assign(rates, lloyd(rates, levels, seed, rounds))
    return assigned.select(
        "player_id", F.lit(pos).alias("pos"),
        *[F.col(f"clusters{k}").alias(f"clusters{name}") for k, name in zip(levels, LEVELS)],
    )


def join_cluster_levels(*levels: DataFrame) -> DataFrame:
    """Left-join single-level tables ``(player_id, clusters<k>)`` on the entity."""
    wide = levels[0]
    for other in levels[1:]:
        wide = wide.join(other, "player_id", "left")
    return wide


def ml_elbow(rates: DataFrame, grid: Sequence[int] = ELBOW_GRID, seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """Within-cluster squared distance for a range of cluster numbers, all from the same passes."""
    rates = stage(rates, "rates")
    assigned = lloyd_assign(rates, lloyd(rates, grid, seed, rounds))
    sums = assigned.agg(*[F.sum(f"gap{k}").alias(f"gap{k}") for k in grid])
    entries = F.array(*[F.struct(F.lit(k).alias("k"), (F.coalesce(f"gap{k}", F.lit(0)) / F.lit(float(GRAIN) ** 2)).alias("cost")) for k in grid])
    return sums.select(F.inline(entries))


def _outcomes(clusters: DataFrame, career: DataFrame, league: str, cluster: str) -> DataFrame:
    target = career.where(F.col("league_name") == league).select("player_id", "gp", "g", "p")
    return clusters.select("player_id", F.col(cluster).alias("cluster")).join(target, "player_id", "left").fillna(
        0, subset=["gp", "g", "p"]
    )


def agg_cluster_profile(clusters: DataFrame, career: DataFrame, league: str, cluster: str = "cluster") -> DataFrame:
    """Size and mean career figures per cluster; no career in the category counts as zeros."""
    return _outcomes(clusters, career, league, cluster).groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in ("gp", "g", "p")]
    )


def join_peers_except_self(
    clusters: DataFrame, career: DataFrame, league: str, cluster_value: int, player_id: int, cluster: str = "cluster"
) -> DataFrame:
    """The other members of one cluster with their career figures, best first."""
    peers = clusters.where((F.col(cluster) == cluster_value) & (F.col("player_id") != player_id))
    return _outcomes(peers, career, league, cluster).orderBy(F.desc("p"), "player_id")


def agg_cluster_value(
    clusters: DataFrame, career: DataFrame, league: str, cluster: str = "cluster",
    min_gp: int = CAREER_GAMES, games: int = SEASON_GAMES,
) -> DataFrame:
    """Expected value of every entity from the rest of its cluster.

    ``pr`` is the share of peers beyond ``min_gp``, ``xp`` their points per season and
    ``xv`` the product.  Each entity's own figures are taken off the cluster totals, so
    nothing is paired within a cluster.
    """
    rows = _outcomes(clusters, career, league, cluster)
    far = F.col("gp") > min_gp
    own = rows.select(
        "player_id", "cluster", far.cast("long").alias("own_n"),
        F.when(far, F.col("p")).otherwise(0).alias("own_p"), F.when(far, F.col("gp")).otherwise(0).alias("own_gp"),
    )
    totals = own.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(f"own_{c}").alias(f"all_{c}") for c in ("n", "p", "gp")],
    )
    # One row per cluster; stored, so that Spark plans the join with its real size.
    joined = own.join(stage(totals, "cluster-totals"), "cluster")
    rest = {c: F.col(f"all_{c}") - F.col(f"own_{c}") for c in ("n", "p", "gp")}
    pr = safe_div(rest["n"], F.col("n") - 1)
    xp = safe_div(rest["p"], rest["gp"]) * games
    return joined.select("player_id", "cluster", pr.alias("pr"), xp.alias("xp"), (pr * xp).alias("xv"))


def rank_expected_value(values: DataFrame, cohort: DataFrame) -> DataFrame:
    """Expected values of the members of a cohort, highest first, unknown last."""
    return cohort.select("player_id").join(values, "player_id", "left").orderBy(F.desc_nulls_last("xv"), "player_id")
