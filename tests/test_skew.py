"""Hot keys, copies and bounded blocks against brute force."""

import hashlib
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.catalog import QUERIES
from cohortry.operators import graph, ordering, prepare, resample
from cohortry.operators.knn import join_knn
from cohortry.operators.pairs import join_consecutive


def hot_season(spark):
    """One entity holds a third of the rows, several of them at each age."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200 + 1).cast("int").alias("player_id"),
        (F.col("id") % 7 + 15).cast("int").alias("age2"),
        F.concat(F.lit("L"), (F.col("id") % 4).cast("string")).alias("league_name"),
        (F.col("id") % 30).cast("int").alias("gp"),
        (F.col("id") % 11).cast("int").alias("p"),
    )
    return rows


@pytest.mark.parametrize("same", [True, False])
def test_pairs_of_a_hot_entity(spark, same):
    season = hot_season(spark)
    a, b = season.alias("a"), season.alias("b")
    literal = a.join(b, (F.col("a.player_id") == F.col("b.player_id")) & (F.col("a.age2") == F.col("b.age2") - 1)).where(
        "a.gp >= 5 and b.gp >= 5"
    )
    if same:
        literal = literal.where("a.league_name = b.league_name")
    want = literal.groupBy(
        F.col("a.player_id").alias("player_id"), F.col("a.age2").alias("age0"),
        F.col("a.league_name").alias("category0"), F.col("b.league_name").alias("category1"),
    ).agg(F.count("*").alias("pairs"), F.sum("a.gp").alias("exposure0"), F.sum("b.p").alias("outcome1"))
    got = join_consecutive(season, min_exposure=5, same_category=same).select(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def vectors(spark, n=400, dims=4, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, dims)).round(3)
    points[: n // 3] = points[0]
    rows = [(i, [float(v) for v in p], int(i % 5 == 0)) for i, p in enumerate(points)]
    return rows, spark.createDataFrame(rows, "id bigint, vec array<double>, label int")


def brute(left, right, k, exclude):
    out = set()
    for i, a, *_ in left:
        near = sorted((round(float(np.linalg.norm(np.array(a) - np.array(b))), 6), j) for j, b, *_ in right if not (exclude and i == j))
        out |= {(i, j, d, r + 1) for r, (d, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("block_rows, pivots", [(20_000, None), (17, 8), (50, 1)])
def test_knn_with_a_third_of_copies(spark, block_rows, pivots):
    rows, frame = vectors(spark)
    got = join_knn(frame, frame, 3, exclude_self=True, block_rows=block_rows, pivots=pivots)
    assert {(r.left_id, r.right_id, r.distance, r["rank"]) for r in got.collect()} == brute(rows, rows, 3, True)


def test_knn_with_fewer_candidates_than_asked(spark):
    rows, frame = vectors(spark, 40)
    few = frame.where("id < 2")
    got = join_knn(frame, few, 5)
    assert {(r.left_id, r.right_id, r.distance, r["rank"]) for r in got.collect()} == brute(rows, rows[:2], 5, False)


def md5_order(values):
    return sorted(values, key=lambda p: (p[1], hashlib.md5(f"{p[0]}:0".encode()).hexdigest()))


def test_smallest_with_heavy_ties(spark):
    data = [(i, 5.0 if i % 3 == 0 else float((i * 37) % 101)) for i in range(2000)]
    frame = spark.createDataFrame(data, "id bigint, v double")
    for m in (0, 1, 700, 1999, 2000):
        got = ordering.take_smallest(frame, "id", lambda n, m=None: F.lit(0), value="v") if m == 0 else ordering.take_smallest(
            frame, "id", (lambda size: (lambda n: F.lit(size)))(m), value="v"
        )
        assert {r.id for r in got.where("taken").collect()} == {i for i, _ in md5_order(data)[:m]}


def test_median_of_a_heavy_value(spark):
    data = [(i, 2.0 if i % 3 else float(i)) for i in range(999)]
    frame = spark.createDataFrame(data, "id bigint, v double")
    assert ordering.exact_median(frame, "v", "id").first()["median"] == float(np.median([v for _, v in data]))


@pytest.mark.parametrize("kind", ["spread", "heavy", "copies", "wide"])
def test_cuts_by_repeated_narrowing(spark, kind):
    """Four parts a round and at most five rows to sort: several rounds, by value and by digest."""
    data = {
        "spread": [(i, (i * 37 % 1009) ** 3 / 7.0, i % 2) for i in range(600)],
        "heavy": [(i, 2.0 if i % 3 else i * 1e-9, None if i % 5 else 1) for i in range(600)],
        "copies": [(i % 4 if i % 2 else i, 7.0 if i % 3 else float(i % 11), 0) for i in range(600)],
        "wide": [(i, [float("inf"), -1.7e308, 5e-324, 1.7e308, float("-inf"), 0.0, 1e-300 * i][i % 7], 0) for i in range(300)],
    }[kind]
    frame = spark.createDataFrame(data, "id bigint, v double, s int")
    spots = [1, 40, 77, 100]
    positions = [(lambda m: lambda n: F.lit(m))(m) for m in spots]
    got = ordering.order_cuts(frame, "id", positions, strata=["s"], value="v", splits=4, sort_rows=5).collect()
    want = set()
    for group in {s for _, _, s in data}:
        rows = sorted((v, hashlib.md5(f"{i}:0".encode()).hexdigest()) for i, v, s in data if s == group)
        want |= {(group, c, len(rows), m, *rows[m - 1]) for c, m in enumerate(spots)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_narrowing_takes_rounds(spark, monkeypatch):
    """One heavy value among others: more than two rounds, and few rows left to sort."""
    staged, stage = [], ordering.stage
    monkeypatch.setattr(ordering, "stage", lambda df, name: (staged.append((name, out := stage(df, name))), out)[1])
    frame = spark.createDataFrame([(i, 5.0 if i % 3 else float(i)) for i in range(3000)], "id bigint, v double")
    ordering.order_cuts(frame, "id", [lambda n: F.lit(1500)], value="v", splits=4, sort_rows=20).collect()
    rounds = [out.count() for name, out in staged if name == "cut-rows"]
    assert len(rounds) >= 3 and rounds == sorted(rounds, reverse=True) and rounds[-1] <= 20


def test_folds_are_balanced_and_disjoint(spark):
    frame = spark.range(101).withColumn("label", (F.col("id") % 5 == 0).cast("int"))
    got = prepare.ml_folds(frame, "id", "label").groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in got) == 101
    for label in (0, 1):
        sizes = [r["count"] for r in got if r.label == label]
        assert len(sizes) == 3 and max(sizes) - min(sizes) <= 1


def test_smote_balances_and_stays_on_lines(spark):
    rows, frame = vectors(spark, 120)
    by_id = {i: np.array(v) for i, v, _ in rows}
    for variant in ("plain", "svm"):
        made = resample.ml_smote(frame, "label", variant=variant).collect()
        assert len(made) == 120 - 2 * sum(r[2] for r in rows)
        for r in made:
            a, b = by_id[r.seed_id], by_id[r.neighbour_id]
            assert r.seed_id != r.neighbour_id and 0 <= r["lambda"] < 1
            assert r.step == (-resample.OUT_STEP * r["lambda"] if r.kind == "safe" else r["lambda"])
            assert variant == "svm" or r.kind == "danger"
            assert np.allclose(np.array(r.vec), a + (b - a) * r.step)
        assert rows[made[0].seed_id][2] == rows[made[0].neighbour_id][2] == 1


def test_votes_on_seeds(spark):
    """A minority row among the majority is noise, one at the border is endangered, one among its own is safe."""
    spots = [(0.0, 0)] * 30 + [(10.0, 1)] * 12 + [(20.0, 0)] * 6 + [(20.0, 1)] * 5 + [(0.0, 1)]
    rng = np.random.default_rng(3)
    rows = [(i, [x + float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))], y) for i, (x, y) in enumerate(spots)]
    frame = spark.createDataFrame(rows, "id long, vec array<double>, label int").repartition(4)
    minority = frame.where("label = 1").select("id", "vec")
    got = {r.id: r.kind for r in resample.vote_on_seeds(minority, frame, "label", 1).collect()}
    want = {i: "noise" if x == 0 else "safe" if x == 10 else "danger" for i, (x, y) in enumerate(spots) if y}
    assert got == want
    made = resample.ml_smote(frame, "label", border=([0.0, 0.0], 0.0)).collect()
    assert {r.seed_id for r in made} <= {i for i, k in want.items() if k != "noise"} and len(made) == 36 - 18
    # Beyond the margin of the given separator there are no seeds; then all minority rows serve.
    made = resample.ml_smote(frame, "label", border=([0.0, 0.0], 5.0)).collect()
    assert len(made) == 18 and {r.kind for r in made} == {"danger"}


def test_smote_runs_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(resample, "RUN", 3)
    rows, frame = vectors(spark, 100)
    few = frame.where("label = 0 or id < 15")
    made = resample.ml_smote(few, "label", variant="plain").collect()
    assert len(made) == 80 - 3 and len({(r.seed_id, r.copy) for r in made}) == 77


def test_frontier_against_a_plain_search(spark):
    links = [(i, i % 9, str((i * 7) % 5)) for i in range(60)] + [(i, (i + 1) % 9, "x") for i in range(0, 60, 4)] + [(99, 77, "z")]
    frame = spark.createDataFrame(links, "player_id int, league_id int, season string")
    seeds = spark.createDataFrame([(3,), (99,)], "player_id int")
    got = {r.player_id: r["round"] for r in graph.join_frontier(frame, seeds, expandable=F.col("player_id") % 2 == 1).collect()}
    want, front, step = {3: 0, 99: 0}, {3, 99}, 0
    while front:
        step += 1
        keys = {(k, s) for i, k, s in links if i in front and i % 2 == 1}
        front = {i for i, k, s in links if (k, s) in keys} - want.keys()
        want.update(dict.fromkeys(front, step))
    assert got == want
    once = graph.join_frontier(frame, seeds, max_rounds=1)
    assert once.agg(F.max("round")).first()[0] <= 1
    for size in (1, 10):
        split = graph.join_frontier(frame, seeds, expandable=F.col("player_id") % 2 == 1, links_per_bucket=size)
        assert {r.player_id: r["round"] for r in split.collect()} == want


def test_frontier_reads_what_its_round_opens(spark, monkeypatch):
    """A wide first round, then a chain of single keys; rows without entity or key link nothing."""
    links = [(0, f"wide{i}") for i in range(200)] + [(i + 1, f"wide{i}") for i in range(200)]
    links += [(i, f"chain{i}") for i in range(200, 205)] + [(i + 1, f"chain{i}") for i in range(200, 205)]
    links += [(None, "wide0"), (7, None), (900, None)] + [(5_000 + i, f"far{i // 2}") for i in range(400)]
    frame = spark.createDataFrame(links, "player_id bigint, k string")
    read, opened = [], graph._opened

    def spy(table, buckets):
        pruned = opened(table, buckets)
        if "links" in "".join(table.inputFiles()):
            plan = pruned._jdf.queryExecution().executedPlan().toString()
            assert not buckets or "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan, plan
            read.append(len(buckets))
        return pruned

    monkeypatch.setattr(graph, "_opened", spy)
    seeds = spark.createDataFrame([(0,)], "player_id int")
    got = {r.player_id: r["round"] for r in graph.join_frontier(frame, seeds, keys=("k",), links_per_bucket=20).collect()}
    want = {0: 0, **{i: 1 for i in range(1, 201)}, **{200 + i: 1 + i for i in range(1, 6)}}
    assert got == want
    by_entity, by_key = read[0::2], read[1::2]
    assert by_key[0] > 10 and all(n <= 1 for n in by_key[2:])
    assert by_entity[1] > 10 and all(n == 1 for n in by_entity[2:])


def test_frontier_of_a_hot_key_and_of_nothing(spark):
    links = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(900)]
    frame = spark.createDataFrame(links, "player_id bigint, k string")
    seeds = spark.createDataFrame([(3,)], "player_id bigint")
    got = {r.player_id for r in graph.join_frontier(frame, seeds, keys=("k",), links_per_bucket=50).collect()}
    assert got == set(range(0, 900, 3))
    assert graph.join_frontier(frame, seeds.limit(0), keys=("k",)).isEmpty()
    assert {tuple(r) for r in graph.join_frontier(frame.limit(0), seeds, keys=("k",)).collect()} == {(3, 0)}


ROOT = Path(__file__).resolve().parents[1] / "cohortry"


def test_core_keeps_data_on_the_executors():
    banned = re.compile(r"toPandas|localCheckpoint|crossJoin|\.rdd\b|toLocalIterator|\.sample\(")
    for path in ROOT.rglob("*.py"):
        assert not banned.search(path.read_text()), path


@pytest.mark.parametrize("name", ["season_enrich", "aging_curve", "league_factor", "feat_frame_train", "agg_argmax_row", "join_paths", "agg_cluster_value", "ml_split_stratified"])
def test_plans_have_no_cross_product_and_no_python(spark, small, name, capsys):
    QUERIES[name](spark, small).explain("formatted")
    plan = capsys.readouterr().out
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "Pandas"):
        assert bad not in plan
