"""The neighbour search: what it writes, and its answers on awkward numbers against brute force."""

import threading

import numpy as np
import pytest

from cohortry.operators import knn, resample
from cohortry.operators.knn import join_knn


def frame_of(spark, points, first=0):
    rows = [(first + i, None if p is None else [float(v) for v in p]) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>").repartition(3)


def written(spark):
    """Bytes of the shuffle files of this session."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()))


def test_search_writes_no_copies_of_candidates(spark):
    """Directions in 64 dimensions, where no candidate can be left out by its distance to a few points."""
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 64))
    frame = frame_of(spark, points / np.linalg.norm(points, axis=1, keepdims=True)).persist()
    assert frame.count() == 3000
    before = written(spark)
    near = join_knn(frame, frame, 3, exclude_self=True, pivots=24)
    assert near.count() == 9000
    assert written(spark) - before < 5 * points.nbytes
    frame.unpersist()


def most_written(spark, action):
    """What an action returns, and the most bytes of shuffle files beyond those before it."""
    before, seen, done = written(spark), [0], threading.Event()

    def look():
        while not done.wait(0.05):
            seen.append(written(spark) - before)

    looking = threading.Thread(target=look)
    looking.start()
    try:
        return action(), max(seen)
    finally:
        done.set()
        looking.join()


def points_of(kind, n):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(n, 5))
    if kind == "far":
        points = 1e6 + points.round(2)
    elif kind == "crowded":
        points = np.where(rng.random((n, 1)) < 0.5, points[:1] + 1e-6 * rng.integers(0, 4, (n, 5)), 1e4 * points)
    elif kind == "grid":
        points = rng.integers(0, 3, (n, 5)) * 0.5
    elif kind == "wild":
        points[::7] *= 1e20
        points[1::50] = np.nan
    elif kind == "zeros":
        points = np.where(rng.random((n, 5)) < 0.5, 0.0, -0.0)
    return points


@pytest.mark.parametrize("kind", ["plain", "far", "crowded", "grid", "wild", "zeros"])
@pytest.mark.parametrize("many_tasks", [False, True])
def test_search_against_brute_force(spark, monkeypatch, kind, many_tasks):
    if many_tasks:
        monkeypatch.setattr(knn, "TASK_BYTES", 2_000)
    a, b = points_of(kind, 90), np.vstack([points_of(kind, 150), points_of(kind, 30)])
    got = join_knn(frame_of(spark, a), frame_of(spark, b, 40), 4, block_rows=25).collect()
    for i, p in enumerate(a):
        gaps = [np.round(np.sqrt(((p - q) ** 2).sum()), 6) for q in b]
        want = [x[1:] for x in sorted((np.isnan(d), d if d == d else 0.0, 40 + j) for j, d in enumerate(gaps))[:4]]
        mine = sorted((r["rank"], r.distance, r.right_id) for r in got if r.left_id == i)
        assert [r[0] for r in mine] == [1, 2, 3, 4]
        assert [r[2] for r in mine] == [j for _, j in want]
        assert np.allclose([np.nan_to_num(r[1]) for r in mine], [d for d, _ in want], rtol=1e-12, atol=1e-9)


def test_far_blocks_are_left_out(monkeypatch):
    """Of a hundred blocks a chunk of queries meets those around it, and few pairs get an exact distance."""
    rng = np.random.default_rng(6)
    corners = [(x, y) for x in range(10) for y in range(10)]
    points = [np.array(c) + rng.random((200, 2)) for c in corners]
    blocks = [knn._Block(p, np.arange(200) + 200 * i, np.ones(200, np.int32)) for i, p in enumerate(points)]
    met, exact = [], []
    pairs, distances = knn._pairs, knn._distances
    monkeypatch.setattr(knn, "_pairs", lambda *a: met.append(1) or pairs(*a))
    monkeypatch.setattr(knn, "_distances", lambda a, b, i, j: exact.append(len(i)) or distances(a, b, i, j))
    rows = np.array([4.0, 5.0]) + rng.random((150, 2))
    best, where, place = knn._nearest(rows, blocks, 5)
    everyone = np.vstack(points)
    far = np.round(np.sqrt(((rows[:, None] - everyone[None]) ** 2).sum(axis=2)), 6)
    assert (200 * where + place == np.argsort(far, axis=1, kind="stable")[:, :5]).all() and np.allclose(best, np.sort(far, axis=1)[:, :5])
    assert len(met) <= 9 and sum(exact) < 2 * 5 * len(rows)


def unit_rows(spark, n, width=64, share=3):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(n, width))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in p], int(i % share == 0)) for i, p in enumerate(points)]
    frame = spark.createDataFrame(rows, "id bigint, vec array<double>, label int").repartition(3).persist()
    assert frame.count() == n
    return points, frame


def test_undersampling_writes_the_rows_a_few_times(spark):
    points, frame = unit_rows(spark, 4000)
    got, most = most_written(spark, lambda: resample.near_miss_scores(frame, "label").collect())
    assert len(got) == 4000 - 1334
    for r in got[:100]:
        assert abs(r.mean_distance - np.sort(np.linalg.norm(points[::3] - points[r.id], axis=1))[:3].mean()) < 2e-6
    assert most < 3 * points.nbytes, most / points.nbytes
    frame.unpersist()


def test_oversampling_writes_the_rows_a_few_times(spark):
    points, frame = unit_rows(spark, 3000)
    made, most = most_written(spark, lambda: resample.ml_smote(frame, "label", border=([0.0] * 64, 0.0)).count())
    assert made == 1000
    assert most < 5 * points.nbytes, most / points.nbytes
    frame.unpersist()


def test_search_of_nothing(spark):
    some, none = frame_of(spark, points_of("plain", 5)), frame_of(spark, [])
    assert join_knn(some, none, 2).count() == join_knn(none, some, 2).count() == 0
