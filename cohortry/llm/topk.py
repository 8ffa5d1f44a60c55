"""Exact top-k inner products in the way of MaxScore.

A query's dimensions are its terms.  In a shard each term adds at least nothing over the query's least score and at most
its bound.  The terms with the smallest bounds that together cannot lift a row to the k-th best score are
non-essential: rows are scored on the essential terms first, and only rows that the bounds leave in the race are probed
in the others, in steps.  The shards' best rows are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortry.llm.scratch import Scratch

SCALE = 256
K = 5
EVERY = 50
SHARDS = 64
ROWS_A_SHARD = 4_096
QUERIES_A_BLOCK = 1_024
STEP = 8  # non-essential terms of one probe
EXACT = 1 << 53


def best_of(q: np.ndarray, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best rows of a shard for one query, ties to smaller ids.  ``ids`` ascend."""
    base = np.minimum(q * low, q * high)
    bound = np.maximum(q * low, q * high) - base
    here = np.flatnonzero(ids != own)
    head, tail = here[: 8 * k], here[8 * k :]
    score = rows[head] @ q
    if len(tail) and len(head) >= k:
        threshold = np.partition(score, len(score) - k)[len(score) - k]
        order = np.argsort(bound, kind="stable")
        reach = base.sum() + np.cumsum(bound[order])
        split = int(np.searchsorted(reach, threshold))  # these terms alone stay below the threshold
        rest, essential = order[:split][::-1], order[split:]
        found = rows[np.ix_(tail, essential)] @ q[essential] if len(essential) else np.zeros(len(tail))
        for at in range(0, len(rest), STEP):
            left = rest[at:]
            alive = found + base[left].sum() + bound[left].sum() >= threshold
            tail, found = tail[alive], found[alive]
            found = found + rows[np.ix_(tail, left[:STEP])] @ q[left[:STEP]]
        head, score = np.concatenate([head, tail]), np.concatenate([score, found])
    first = np.lexsort((ids[head], -score))[:k]
    return ids[head[first]], score[first]


def search(key, queries: pa.Table, rows: pa.Table, k: int) -> pa.Table:
    out: list[tuple[int, int, int, int]] = []
    if queries.num_rows and rows.num_rows:
        vectors, wanted = rows["v"].to_pylist(), queries["v"].to_pylist()
        width = max(map(len, vectors + wanted))
        dense = lambda x: np.array([v + [0] * (width - len(v)) for v in x], np.int64).reshape(-1, width)
        v, q = dense(vectors), dense(wanted)
        if width and width * int(np.abs(v).max()) * int(np.abs(q).max()) < EXACT:
            v, q = v.astype(float), q.astype(float)  # whole numbers all the same, by a faster product
        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        v, ids = v[order], rows["vec_id"].to_numpy()[order]
        low, high = v.min(axis=0), v.max(axis=0)
        for own, uid, x in zip(queries["vec_id"].to_pylist(), queries["uid"].to_pylist(), q):
            out += [(own, uid, int(i), int(s)) for i, s in zip(*best_of(x, ids, v, low, high, own, k))]
    columns = list(zip(*out)) if out else [()] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], ["query_id", "uid", "vec_id", "score"])


def top_k(vectors: DataFrame, scratch: Scratch, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of the highest inner products for every row whose id is divisible by ``every``.

    Components count as floor(scale * x).  Returns ``query_id, rank, vec_id, score``; ties go to smaller ids.

    Vectors that are null or hold null or non-finite components, and null ids, take no part.  Repeated rows count
    once; a shorter vector is zero in the dimensions that it lacks; an empty vector scores zero.  Query blocks and
    shards have bounded sizes; each shard returns at most ``k`` rows a query.  Other columns are not read.
    """
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(x.isNotNull() & F.col("vec_id").isNotNull() & ~bad).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    rows = scratch.keep(rows.distinct().withColumn("uid", F.xxhash64("v")), "vectors")
    wanted = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), wanted.count()
    shards, blocks = max(SHARDS, n // ROWS_A_SHARD), 1 + m // QUERIES_A_BLOCK
    here = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "uid"), F.lit(shards)).cast("int"))
    here = here.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    wanted = wanted.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    run = lambda key, a, b: search(key, a, b, k)
    found = wanted.groupBy("shard", "block").cogroup(here.groupBy("shard", "block")).applyInArrow(run, "query_id long, uid long, vec_id long, score long")
    best = Window.partitionBy("query_id", "uid").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of every fiftieth vector."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), Scratch(spark, "topk"))


QUERIES = {"op10_top_k": query}
ORACLES = {
    "op10_top_k": f"""
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select q.vec_id as query_id, c.vec_id, c.score, row_number() over (partition by q.vec_id order by c.score desc, c.vec_id) as rank
  from v q, lateral (
    select o.vec_id, cast(list_sum(list_transform(list_zip(q.v, o.v), lambda z: z[1] * z[2])) as bigint) as score
    from v o where o.vec_id <> q.vec_id) c
  where q.vec_id % {EVERY} = 0) t
where rank <= {K}"""
}
