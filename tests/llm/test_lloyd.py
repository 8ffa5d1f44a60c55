"""Dimension-sharded clustering against plain Python."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortry.llm import lloyd
from cohortry.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<double>, cluster string, chunk string"


def brute(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        centres = [[sum(v[d] for v in mine) // len(mine) for d in range(dims)] if (mine := [v for (_, v), o in zip(kept, of) if o == j]) else c for j, c in enumerate(centres)]
    return Counter((i, *reversed(nearest(v))) for i, v in kept), centres


def vectors(dims, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(k, [round(rng.gauss(k % 5, 0.7), 3) for _ in range(dims)]) for k in range(n)]
    common = rows[3][1]
    rows += [(n + k, common) for k in range(n // 2)]  # a third of the rows
    rows += [rows[5], (5, rows[6][1]), (None, rows[7][1]), (None, None), (9001, []), (9002, [1.0] * (dims - 1)), (9003, [None] + [1.0] * (dims - 1))]
    rows += [(9004, [float("nan")] * dims), (9005, [float("inf")] + [0.0] * (dims - 1)), (9006, [-3.0] * dims)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "d") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("dims,width,k,rounds", [(7, 3, 4, 3), (64, 32, 8, 10), (5, 32, 8, 0), (2, 1, 500, 2)])
def test_cluster(spark, monkeypatch, dims, width, k, rounds):
    monkeypatch.setattr(lloyd, "ROWS_A_CHUNK", 32)
    rows = vectors(dims, 40 if k == 500 else 400)
    out, centroids = lloyd.cluster(frame(spark, rows), Scratch(spark, "t"), k, rounds, dims, width=width)
    want, centres = brute(rows, k, rounds, dims)
    assert Counter(map(tuple, out.collect())) == want and centroids.tolist() == centres
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("column_blocks")]


def test_ties_go_to_the_smaller_number_and_empty_clusters_stay(spark):
    rows = [(k, [1.0, 1.0]) for k in range(20)] + [(50, [3.0, 1.0])]
    out, centroids = lloyd.cluster(frame(spark, rows), Scratch(spark, "t"), 4, 2, 2)
    want, centres = brute(rows, 4, 2, 2)
    assert Counter(map(tuple, out.collect())) == want and centroids.tolist() == centres and len(centres) == 4


def test_nothing_and_too_large(spark):
    out, centroids = lloyd.cluster(frame(spark, [(1, None)]), Scratch(spark, "t"))
    assert out.count() == 0 and len(centroids) == 0
    assert lloyd.cluster(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))[0].count() == 0
    with pytest.raises(Exception, match="component too large"):
        lloyd.cluster(frame(spark, [(1, [1e300] * 64)]), Scratch(spark, "t"))


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centres = brute(rows, 8, 10, 64)
    got = lloyd.query(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == want
    sums = Counter()
    for (_, c, d), n in want.items():
        sums[c] += d * n
    for r in got:
        assert (r["cluster_inertia"], r["inertia"]) == (sums[r["cluster"]], sum(sums.values()))
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()
