"""Centroid clustering by Lloyd's rounds, sharded by dimension.

Vectors lie in column blocks: a chunk of some thousand vectors, a range of dimensions.  In a round, the task of a block
computes exact partial distances of its vectors from its slice of each centroid; the partial distances of a chunk are
added up over the blocks and the nearest centroid taken; each block adds up its own columns by cluster, and the new
slices follow from the sums.  Everything is whole numbers, so the result does not depend on the order of sums.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm.scratch import Scratch

DIMS = 64
SCALE = 1024
K = 8
ROUNDS = 10
SEED = 3
WIDTH = 32  # dimensions of a block
ROWS_A_CHUNK = 4_096
LARGEST = 1 << 27  # of a scaled component: squared distances then fit 64 bits
BLOCKS = "chunk long, block int, ids array<long>, data binary"
OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def column_blocks(kept: DataFrame, scratch: Scratch, name: str, dims: int, width: int, buckets: int) -> DataFrame:
    """A row per chunk and block, bucketed by both, so that no round shuffles the vectors.  ``ids`` stand with block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_A_CHUNK):
                part = batch.slice(at, ROWS_A_CHUNK)
                whole = part.column(1).flatten().to_numpy().reshape(-1, dims).astype("<i4")
                slices = [whole[:, k : k + width].tobytes() for k in range(0, dims, width)]
                n = len(slices)
                ids = pa.array([part.column(0).to_pylist()] + [None] * (n - 1), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * n), pa.array(range(n), pa.int32()), ids, pa.array(slices)], ["chunk", "block", "ids", "data"]
                )
                chunk += 1

    keys = ("chunk", "block")
    made = kept.mapInArrow(run, BLOCKS).repartition(buckets, *keys)
    made.write.bucketBy(buckets, *keys).option("path", scratch.path(name)).saveAsTable(name)
    return scratch.spark.table(name)


def assign(blocks: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """``chunk, labels, distances``: the nearest centroid of each vector of a chunk, ties to the smaller number."""
    k = len(centroids)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                mine = centroids[:, block * width : (block + 1) * width]
                x = np.frombuffer(data, "<i4").reshape(-1, mine.shape[1]).astype(np.int64)
                out.append(np.stack([((x - c) ** 2).sum(axis=1) for c in mine], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["chunk", "partial"])

    def nearest(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p, np.int64) for p in table["partial"].to_pylist()).reshape(-1, k)
        label = total.argmin(axis=1)
        best = total[np.arange(len(total)), label]
        return pa.table({"chunk": table["chunk"][:1], "labels": pa.array([label.astype("<i4").tobytes()]), "distances": pa.array([best.tobytes()])})

    parts = blocks.select("chunk", "block", "data").mapInArrow(partial, "chunk long, partial binary")
    return parts.groupBy("chunk").applyInArrow(nearest, "chunk long, labels binary, distances binary")


def slices(blocks: DataFrame, labels: DataFrame, n_blocks: int, dims: int, k: int, width: int) -> DataFrame:
    """``dim, cluster, value``: the components of the clusters' means, rounded down; none for empty clusters."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((dims, k), np.int64), np.zeros((dims, k), np.int64)
        for batch in batches:
            for block, data, label in zip(*(batch.column(i).to_pylist() for i in range(3))):
                at = slice(block * width, min(dims, (block + 1) * width))
                x, label = np.frombuffer(data, "<i4").reshape(-1, at.stop - at.start), np.frombuffer(label, "<i4")
                for c in range(k):
                    mine = x[label == c]
                    total[at, c] += mine.sum(axis=0, dtype=np.int64)
                    count[at, c] += len(mine)
        dim, cluster = np.nonzero(count)
        columns = [dim.astype(np.int32), cluster.astype(np.int32), total[dim, cluster], count[dim, cluster]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["dim", "cluster", "total", "n"])

    labels = labels.select("chunk", "labels", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))
    both = blocks.join(labels, ["chunk", "block"]).select("block", "data", "labels")
    parts = both.mapInArrow(sums, "dim int, cluster int, total long, n long")
    parts = parts.groupBy("dim", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return parts.select("dim", "cluster", F.expr("(total - pmod(total, n)) div n").alias("value"))


def cluster(
    vectors: DataFrame,
    scratch: Scratch,
    k: int = K,
    rounds: int = ROUNDS,
    dims: int = DIMS,
    scale: int = SCALE,
    seed: int = SEED,
    width: int = WIDTH,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, np.ndarray]:
    """Assignments ``vec_id, cluster, distance`` after ``rounds`` rounds, and the centroids.

    Components count as floor(scale * x).  The first centroids are the ``k`` vectors with the smallest sha256 of
    ``seed:vec_id``, those without an id last, ties by components; fewer vectors give fewer centroids.

    Vectors that are null, of another length, or that hold null or non-finite components take no part; a scaled
    component beyond 2^27 is an error, as distances would not fit 64 bits.  Repeated rows count each; null ids stay null;
    other columns are not read; an empty table gives no rows.  To the driver go the centroids: ``k`` times ``dims`` numbers.
    """
    spark = scratch.spark
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where((F.size("x") == dims) & ~bad)
    large = F.exists("x", lambda c: F.abs(c) * scale > LARGEST)
    scaled = F.transform("x", lambda c: F.floor(c * scale).cast("long"))
    rows = rows.select("vec_id", F.when(large, F.raise_error(F.lit("component too large"))).otherwise(scaled).alias("v"))
    kept = scratch.keep(rows, "kept")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = np.array([r["v"] for r in first], np.int64).reshape(-1, dims)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    n_blocks = -(-dims // width)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"column_blocks_{uuid.uuid4().hex}"
    blocks = column_blocks(kept, scratch, name, dims, width, max(1, min(most, kept.count() * n_blocks // (8 * ROWS_A_CHUNK))))
    for r in range(rounds + 1):
        labels = scratch.keep(assign(blocks, centroids, width), f"labels{r}")
        if r:
            scratch.drop(f"labels{r - 1}")
        if r < rounds:
            centroids = centroids.copy()
            for x in slices(blocks, labels, n_blocks, dims, len(centroids), width).collect():
                centroids[x["cluster"], x["dim"]] = x["value"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, label, best in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2))):
                yield pa.RecordBatch.from_arrays([ids.values, pa.array(np.frombuffer(label, "<i4")), pa.array(np.frombuffer(best, np.int64))], ["vec_id", "cluster", "distance"])

    ids = blocks.where("block = 0").select("chunk", "ids")
    out = ids.join(labels, "chunk").select("ids", "labels", "distances").mapInArrow(spread, "vec_id long, cluster int, distance long")
    out = scratch.keep(out, "assigned")
    spark.sql(f"drop table {name}")
    scratch.drop("kept", name, f"labels{rounds}")
    return out, centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components."""
    out, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "lloyd"))
    if not len(centroids):
        return spark.createDataFrame([], OUT)
    hashes = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    sums = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    facts = facts.join(sums, "cluster").withColumn("inertia", out.agg(F.sum("distance").alias("inertia")).scalar())
    # A row per centroid: eight at most.
    return out.join(F.broadcast(facts), "cluster").select(*[c.split()[0] for c in OUT.split(", ")])


def rounds_sql(k: int = K, rounds: int = ROUNDS) -> str:
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
a{r} as materialized (
  select rid, cluster, d from (
    select v.rid, c.cluster, cast(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as bigint) as d
    from v, c{r} c) qualify row_number() over (partition by rid order by d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
c{r + 1} as materialized (
  select c.cluster, coalesce(m.v, c.v) as v from c{r} c left join (
    select cluster, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) as v from (
      select cluster, i, sum(x) as s, count(*) as n from (
        select a.cluster, unnest(v.v) as x, generate_subscripts(v.v, 1) as i from a{r} a join v on v.rid = a.rid) group by cluster, i)
    group by cluster) m on m.cluster = c.cluster)""")
    return f"""
with v as materialized (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v
  from embeddings where len(embedding) = {DIMS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select cast(row_number() over (order by sha256('{SEED}:' || vec_id), v) - 1 as integer) as cluster, v from v
  qualify row_number() over (order by sha256('{SEED}:' || vec_id), v) <= {k}),{",".join(steps)}
select v.vec_id, a.cluster, a.d as distance, cast(sum(a.d) over (partition by a.cluster) as bigint) as cluster_inertia,
  cast(sum(a.d) over () as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a{rounds} a join v on v.rid = a.rid join c{rounds} c on c.cluster = a.cluster"""


QUERIES = {"op12_lloyd": query}
ORACLES = {"op12_lloyd": rounds_sql()}
