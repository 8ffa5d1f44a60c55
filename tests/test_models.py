"""Invariants of the fitted parts, on the small data."""

import hashlib

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.learning import LEVELS, body_models, class_rows, cluster_rates
from cohortry.catalog.projections import stored_frame
from cohortry.plans import body, clusters, features as ff, models
from cohortry.standin import StandIn

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def data(spark):
    return StandIn(spark, FOLDER)


def test_clusters_cover_everyone_once_with_the_nearest_centre(data):
    rates = cluster_rates(data)
    model = clusters.ml_kmeans(rates, LEVELS, seed=1)
    got = clusters.ml_kmeans_assign(rates, model).collect()
    assert len({r.player_id for r in got}) == len(got) == rates.count()
    centres = np.array(model.stages[0].clusterCenters())
    root = np.sqrt(2)
    for r in got[:100]:
        at = np.array([r.g_a17, r.g_a18 * root, r.a_a17, r.a_a18 * root])
        assert np.argmin(((centres - at) ** 2).sum(axis=1)) == r[f"clusters{LEVELS[0]}"]


def brute_lloyd(rows, k, seed, rounds):
    """Plain rounds over whole numbers; gaps count the second age twice."""
    points = {i: [round(x * 1_000_000) for x in v] for i, v in rows}
    order = sorted(points, key=lambda i: (hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), points[i]))
    centres = [points[i] for i in order[:k]]
    gap = lambda p, c: sum(w * (a - b) ** 2 for w, a, b in zip((1, 2, 1, 2), p, c))
    nearest = lambda p: min((gap(p, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        of = {i: nearest(p)[1] for i, p in points.items()}
        mine = [[points[i] for i in points if of[i] == j] for j in range(len(centres))]
        centres = [[(2 * sum(x) + len(m)) // (2 * len(m)) for x in zip(*m)] if m else c for m, c in zip(mine, centres)]
    return {i: nearest(p)[::-1] for i, p in points.items()}


@pytest.mark.parametrize("rounds", [0, 1, 20])
def test_rounds_against_plain_rounds(spark, rounds):
    """Copies (a third of the rows), ties, more centres than points."""
    rng = np.random.default_rng(7)
    rows = [(i, [round(float(x), 6) for x in rng.random(4)]) for i in range(60)] + [(100 + i, [0.5, -0.25, 0.125, 0.0]) for i in range(30)]
    frame = spark.createDataFrame([(i, *v) for i, v in rows], "player_id int, g_a17 double, g_a18 double, a_a17 double, a_a18 double").repartition(5)
    levels = (3, 8, 500)
    got = clusters.lloyd_assign(frame, clusters.lloyd(frame, levels, 4, rounds)).collect()
    assert len(got) == len(rows)
    for k in levels:
        assert {r.player_id: (r[f"clusters{k}"], r[f"gap{k}"]) for r in got} == brute_lloyd(rows, k, 4, rounds)
    costs = {r.k: r.cost for r in clusters.ml_elbow(frame, levels, 4, rounds).collect()}
    assert all(np.isclose(costs[k], sum(r[f"gap{k}"] for r in got) / 1e12) for k in levels)


def test_rounds_on_nothing(spark):
    frame = spark.createDataFrame([], "player_id int, g_a17 double, g_a18 double, a_a17 double, a_a18 double")
    assert clusters.player_clusters(frame, "F").count() == 0
    assert {r.cost for r in clusters.ml_elbow(frame, (2, 3)).collect()} == {0.0}


def test_clusters_reach_the_frame(data):
    frame = stored_frame(data, clustered=True)
    want = {r.player_id: r[1:] for r in data.clusters().select("player_id", *ff.CLUSTER_COLUMNS).collect()}
    got = {r.player_id: r[1:] for r in frame.select("player_id", *ff.CLUSTER_COLUMNS).collect()}
    assert got == {i: want.get(i, (0, 0, 0)) for i in got} and len(set(got.values())) > 50


def test_doubled_dimension_equals_scaled_dimension(spark):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0), (0.5, 0.1, 0.7, 2.0)], "g_a17 double, g_a18 double, a_a17 double, a_a18 double")
    a, b = [np.array([r.c1, r.c2, r.c3, r.c4]) for r in clusters.cluster_inputs(rows).collect()]
    raw = rows.collect()
    twice = sum((raw[0][c] - raw[1][c]) ** 2 for c in ("g_a17", "g_a18", "g_a18", "a_a17", "a_a18", "a_a18"))
    assert np.isclose(((a - b) ** 2).sum(), twice)


def test_soft_vote_is_the_mean(spark, data):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = class_rows(data).select("id", array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    vote = models.SoftVote.fit(rows, {"boosted": models.booster(2), "gaussian": models.CLASSIFIERS["gaussian"]()})
    out = rows
    for member in vote.members:
        out = member.transform(out)
    want = {r.id: (r.a + r.b) / 2 for r in out.select(
        "id", vector_to_array("_prob_boosted")[1].alias("a"), vector_to_array("_prob_gaussian")[1].alias("b")).collect()}
    for r in vote.transform(rows).collect():
        assert np.isclose(r.probability, want[r.id]) and r.prediction == int(want[r.id] > 0.5)


def test_gaussian_vote_is_the_library_s(spark):
    """All folds in one pass against a fit per fold, with a constant input and one class nearly absent."""
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(4)
    rows = [(i, int(i % 11 == 0), i % 3, [float(x) for x in rng.normal(i % 11 == 0, 1 + i % 2, 4)] + [7.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id int, label int, fold int, vec array<double>").repartition(5)
    got = {r.id: r.probability for r in models.gaussian_vote(frame, 5, "fold").collect()}
    vectors = frame.select("id", "fold", array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))
    for fold in range(3):
        two = {name: models.CLASSIFIERS["gaussian"]() for name in ("first", "second")}
        vote = models.SoftVote.fit(vectors.where(F.col("fold") != fold), two, models.dealt_parts(5))
        want = vote.transform(vectors.where(F.col("fold") == fold)).collect()
        assert want and all(np.isclose(got[r.id], r.probability, atol=1e-9) for r in want)
        assert {c for c in want[0].__fields__} == {"id", "fold", "features", "label", "probability", "prediction"}
    one = frame.where("label = 0").limit(20)
    assert {r.probability for r in models.gaussian_vote(one, 5).collect()} == {None}
    assert models.gaussian_vote(frame.limit(0), 5, "fold").count() == 0


def test_gaussian_classifier_stores_and_scores(data, tmp_path):
    model, quality, weights = models.train_eval_classifier(stored_frame(data), imb=0, voters="gaussian")
    assert {r["part"] for r in quality.collect()} == {"fold0", "fold1", "fold2", "test"} and weights.count() > 7
    model.save(str(tmp_path / "m"))
    height, weight = body_models(data)
    cohort = stored_frame(data, mode="cohort")
    first = models.score_cohort_classifier(cohort, model, height, weight).collect()
    again = models.score_cohort_classifier(cohort, PipelineModel.load(str(tmp_path / "m")), height, weight).collect()
    assert first == again and len(first) == cohort.count()


@pytest.mark.parametrize("adj, level, task, gone", [
    (1, 0, "class", ff.RAW_RATES + ff.CLUSTER_COLUMNS),
    (0, 1, "class", ff.ADJUSTED_SUMS + ff.ADJUSTED_PARTS + ["clusters100", "clusters200"]),
    (0, 3, "regr", ff.ADJUSTED_PARTS + ["clusters50", "clusters100"]),
])
def test_variants(adj, level, task, gone):
    assert sorted(ff.variant_drop_list(adj, level, task)) == sorted(gone)


def test_classifier_stores_and_scores(spark, data, tmp_path):
    model, quality, weights = models.train_eval_classifier(stored_frame(data), imb=2, trees=2)
    parts = {r["part"]: r for r in quality.collect()}
    assert set(parts) == {"fold0", "fold1", "fold2", "test"}
    n = stored_frame(data).count()
    assert sum(parts["test"][c] for c in ("tp", "fp", "fn", "tn")) in range(int(0.3 * n), int(0.3 * n) + 4)
    assert all(r.weight >= models.IMPORTANCE_MIN for r in weights.collect())
    model.write().overwrite().save(str(tmp_path / "m"))
    height, weight = body_models(data)
    cohort = stored_frame(data, mode="cohort")
    first = models.score_cohort_classifier(cohort, model, height, weight).collect()
    again = models.score_cohort_classifier(cohort, PipelineModel.load(str(tmp_path / "m")), height, weight).collect()
    assert first == again and len(first) == cohort.count()
    assert first == sorted(first, key=lambda r: (-r.prediction, -r.probability, r.player_id))


def test_regressor(data):
    frame = stored_frame(data, labelled_only=True)
    _model, quality, pvalues, _weights = models.train_eval_regressor(frame, encode="drop")
    assert quality.first().r2 <= 1.0
    tested = pvalues.collect()
    assert tested and all(0 <= r.p_value <= 1 for r in tested)
    # With indicator columns, the tests are of the selected inputs, some of which depend on others without an intercept.
    _model, quality, pvalues, weights = models.train_eval_regressor(stored_frame(data), target="g_gp", clusters=1)
    assert [r.feature for r in pvalues.collect()] == [r.feature for r in weights.collect()] and quality.first().n > 50
    assert {r.feature.split("=")[0] for r in pvalues.collect()} >= {"league_id17", "country"}


def test_regressor_uses_clusters(data):
    frame = stored_frame(data, clustered=True)
    for level, name in zip((1, 2, 3), ff.CLUSTER_COLUMNS):
        _model, _quality, _p, weights = models.train_eval_regressor(frame, clusters=level)
        used = {r.feature.split("=")[0] for r in weights.collect()}
        assert name in used and not used & {c for c in ff.CLUSTER_COLUMNS if c != name}


def test_draft_twice_keeps_or_drops_copies(spark, data):
    from cohortry.catalog.projections import train_frame

    single = train_frame(data).count()
    double = train_frame(data, dedupe_draft=False).count()
    assert single < double


def test_body_projection_recovers_a_linear_rule(spark):
    rows = spark.range(200).select(
        F.col("id").alias("player_id"), (18 + F.col("id") % 3 / 10).alias("age0"), (170 + F.col("id") % 20).cast("double").alias("height0"),
        (70 + F.col("id") % 13).cast("double").alias("weight0"), F.when(F.col("id") % 4 == 0, "D").otherwise("F").alias("pos"),
    ).withColumn("height1", F.col("height0") + 2 + F.when(F.col("pos") == "D", 1).otherwise(0))
    model, quality = body.fit_body(rows, "height")
    assert quality.first().r2 > 0.999999
    cohort = spark.createDataFrame([(1, 18.1, 180.0, 75.0, "D")], "player_id int, age1 double, height double, weight double, pos string")
    out = body.ml_project_body(cohort, model, body.fit_body(rows.withColumn("weight1", F.col("weight0") * 1.1), "weight")[0]).first()
    assert abs(out.height - 183) < 1e-6 and abs(out.weight - 82.5) < 1e-6


def test_onehot_unseen_category_is_all_zero(spark):
    from cohortry.operators.prepare import OneHot

    train = spark.createDataFrame([(1, "a"), (2, "b")], "id int, c string")
    hot = OneHot(["c"]).fit(train)
    got = hot.long_form(spark.createDataFrame([(3, "z"), (4, "b")], "id int, c string"), "id").collect()
    assert {(r.id, r.category, r.hot) for r in got} == {(3, "a", 0), (3, "b", 0), (4, "a", 0), (4, "b", 1)}
    assert OneHot(["c"], "drop").fit(train).transform(train).columns == ["id"]


def test_every_alternative_can_be_made():
    for name, make in {**models.CLASSIFIERS, **models.REGRESSORS, **models.SCALERS}.items():
        assert make() is not None, name


def test_standin_parameters_match_the_fixture():
    assert standin.AGES == (20, 21) and standin.ANCHOR == "1-URGENT"


def test_rank_of_every_row(spark):
    """Half of the rows share a score; some have none."""
    rows = [(i, i % 2, None if i % 50 == 0 else 0.5 if i % 2 else round((i * 37 % 101) / 101, 6)) for i in range(1000)]
    frame = spark.createDataFrame(rows, "player_id int, prediction int, probability double").repartition(7)
    got = models.rank_all(frame).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[2] is None, -(r[2] or 0), r[0]))
    assert {r.player_id: r["rank"] for r in got} == {r[0]: k for k, r in enumerate(order, 1)} and len(got) == 1000
    assert models.rank_all(frame.limit(0)).count() == 0
