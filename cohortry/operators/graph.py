"""Bounded path search on a directed graph of transition edges, and reachability."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cohortry.session import ensure_checkpoint_dir, remove_at_exit, stage

LINKS_PER_BUCKET = 1_000_000
MOST_BUCKETS = 4_096
BUCKET = "link_bucket"


def node_list(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Every node that is on either end of an edge."""
    return edges.select(F.col(src).alias("node")).union(edges.select(F.col(dst).alias("node"))).distinct()


def join_paths(edges: DataFrame, anchor: str, max_hops: int = 3, anchor_cycles: bool = True) -> DataFrame:
    """Simple paths of up to ``max_hops`` edges that end at the anchor.

    Paths grow backwards from the anchor, one equi-join per hop.  With
    ``anchor_cycles`` the paths that start and end at the anchor are included, the
    anchor's edge to itself among them.
    """
    step = edges.select(
        F.col("src").alias("_from"), F.col("dst").alias("_to"), F.col("le").alias("_w")
    )
    into = step.where(F.col("_to") == anchor)
    closed = (F.col("_from") == anchor) if anchor_cycles else F.lit(False)
    grown = into.where((F.col("_from") != anchor) | closed).select(
        F.col("_from").alias("start"),
        F.array("_from", "_to").alias("path"),
        F.col("_w").cast("double").alias("product"),
    )
    levels = [grown]
    for _ in range(1, max_hops):
        open_paths = levels[-1].where(F.col("start") != anchor)
        nxt = open_paths.join(step, F.col("start") == F.col("_to"))
        fresh = ~F.array_contains("path", F.col("_from"))
        nxt = nxt.where(fresh | ((F.col("_from") == anchor) & F.lit(anchor_cycles)))
        levels.append(
            nxt.select(
                F.col("_from").alias("start"),
                F.concat(F.array("_from"), F.col("path")).alias("path"),
                (F.col("product") * F.col("_w")).alias("product"),
            )
        )
    paths = reduce(DataFrame.unionByName, levels)
    return paths.select("start", "path", F.size("path").alias("nodes"), "product")


def agg_path_score(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean over a node's paths of the product over the squared node count; no path scores 0."""
    scored = paths.groupBy(F.col("start").alias("node")).agg(
        F.avg(F.col("product") / F.pow(F.col("nodes").cast("double"), F.lit(2.0))).alias("score")
    )
    return nodes.join(scored, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))


def path_scores(edges: DataFrame, anchor: str, anchor_cycles: bool = True) -> DataFrame:
    """The scores of ``agg_path_score`` for paths of up to three edges, without listing paths.

    A node's three-edge paths are the sum over its next node of that node's two-edge
    paths, less those that come straight back.  Each step is one join and one sum on
    the edges, so the work grows with the edges and not with the number of paths.
    """
    e = edges.select("src", "dst", F.col("le").cast("double").alias("w"))
    to_anchor = e.where((F.col("dst") == anchor) & (F.col("src") != anchor)).select(
        F.col("src").alias("mid"), F.col("w").alias("w1")
    )
    inner = e.where((F.col("src") != anchor) & (F.col("dst") != anchor) & (F.col("src") != F.col("dst")))
    # Two-edge continuations of each node, by its sum and its count.
    two = (
        inner.join(to_anchor, F.col("dst") == F.col("mid"))
        .groupBy(F.col("src").alias("mid"))
        .agg(F.sum(F.col("w") * F.col("w1")).alias("sum2"), F.count(F.lit(1)).alias("n2"))
    )
    # What leads to the anchor from here, in one and in two edges.
    onward = to_anchor.join(two, "mid", "full").select(
        "mid", "w1", F.coalesce("sum2", F.lit(0.0)).alias("sum2"), F.coalesce("n2", F.lit(0)).alias("n2")
    )
    # Edge out of a node, what leads on, and the edge straight back with the node's own edge.
    back = (
        inner.select(F.col("dst").alias("start"), F.col("src").alias("mid"), F.col("w").alias("w_back"))
        .join(to_anchor.select(F.col("mid").alias("start"), F.col("w1").alias("w_own")), "start")
    )
    out = e.where((F.col("dst") != anchor) & (F.col("src") != F.col("dst")))
    if not anchor_cycles:
        out = out.where(F.col("src") != anchor)
    longer = (
        out.select(F.col("src").alias("start"), F.col("dst").alias("mid"), "w")
        .join(onward, "mid")
        .join(back, ["start", "mid"], "left")
        .groupBy("start")
        .agg(
            F.sum(F.col("w") * F.coalesce("w1", F.lit(0.0))).alias("sum2"),
            F.sum(F.when(F.col("w1").isNotNull(), 1).otherwise(0)).alias("n2"),
            F.sum(F.col("w") * (F.col("sum2") - F.coalesce(F.col("w_back") * F.col("w_own"), F.lit(0.0)))).alias("sum3"),
            F.sum(F.col("n2") - F.when(F.col("w_back").isNotNull(), 1).otherwise(0)).alias("n3"),
        )
    )
    one = e.where(F.col("dst") == anchor)
    if not anchor_cycles:
        one = one.where(F.col("src") != anchor)
    direct = one.select(F.col("src").alias("start"), F.col("w").alias("sum1"))
    zero = F.lit(0.0)
    total = (
        F.coalesce("sum1", zero) / 4 + F.coalesce("sum2", zero) / 9 + F.coalesce("sum3", zero) / 16
    )
    count = (
        F.when(F.col("sum1").isNotNull(), 1).otherwise(0)
        + F.coalesce("n2", F.lit(0))
        + F.coalesce("n3", F.lit(0))
    ).cast("double")
    scores = direct.join(longer, "start", "full").select(
        F.col("start").alias("node"), (total / F.nullif(count, F.lit(0.0))).alias("score")
    )
    return node_list(edges).join(scores, "node", "left").select("node", F.coalesce("score", zero).alias("score"))


def scalar_norm(df: DataFrame, key: str, anchor, value: str) -> DataFrame:
    """Divide a column by the value of the anchor row."""
    base = df.where(F.col(key) == anchor).agg(F.max(value).alias("v")).scalar()
    return df.withColumn(value, F.col(value) / F.nullif(base, F.lit(0.0)))


def league_factor(edges: DataFrame, anchor: str = "NHL", anchor_cycles: bool = True) -> DataFrame:
    """Strength of every category relative to the anchor."""
    scores = path_scores(edges, anchor, anchor_cycles)
    return scalar_norm(scores, "node", anchor, "score").select(
        F.col("node").alias("league_name"), F.col("score").alias("le")
    )


def _opened(table: DataFrame, buckets: list[int]) -> DataFrame:
    """The rows of a stored table in some of its buckets; no other file is read."""
    return table.where(F.col(BUCKET).isin(buckets))


def join_frontier(
    memberships: DataFrame,
    seeds: DataFrame,
    *,
    entity: str = "player_id",
    keys: tuple[str, ...] = ("league_id", "season"),
    expandable: Column | None = None,
    max_rounds: int | None = None,
    links_per_bucket: int = LINKS_PER_BUCKET,
) -> DataFrame:
    """Entities reachable from the seeds through shared keys, with the round they were met in.

    Only rows that satisfy ``expandable`` lead to new keys; a row without entity or without one of
    its keys links nothing.  The links are stored twice in hash buckets, the expandable ones by entity
    and all of them by key, and so are the keys and entities met.  A round reads the buckets that its
    frontier falls in, whose numbers (at most ``MOST_BUCKETS``) are all that the driver sees.  Each
    round's new rows go to the shared folder as one part of a table, so neither the plan nor the
    recovery after a lost executor grows with the rounds.
    """
    spark = memberships.sparkSession
    keys = list(keys)
    opens = F.lit(True) if expandable is None else expandable
    links = memberships.dropna(subset=[entity, *keys]).select(entity, *keys, opens.alias("_opens")).distinct()
    links = stage(links, "links")
    buckets = min(MOST_BUCKETS, 1 + links.count() // links_per_bucket)
    base = f"{ensure_checkpoint_dir(spark)}/frontier-{uuid.uuid4().hex}"
    remove_at_exit(spark, base)

    def keep(df: DataFrame, table: str, by: list[str]) -> DataFrame:
        """Store rows by the hash of some columns; a bucket that a hot key fills is several files."""
        path = f"{base}/{table}"
        placed = df.withColumn(BUCKET, F.pmod(F.xxhash64(*by), F.lit(buckets)).cast("int"))
        placed.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(path)
        return spark.read.schema(placed.schema).parquet(path)

    def touched(df: DataFrame) -> list[int]:
        return [r[0] for r in df.select(BUCKET).distinct().collect()]

    def unmet(candidates: DataFrame, table: str, by: list[str], step: int) -> DataFrame:
        """Of a round's candidates those that no earlier round met, as the round's part of the table."""
        if step > 1 or table == "entities":
            known = spark.read.schema(fresh.schema if table == "entities" else by_key.drop(entity).schema).parquet(f"{base}/{table}")
            if buckets > 1:
                candidates = keep(candidates, f"candidates/{table}-{step}", by)
                known = _opened(known, touched(candidates))
            candidates = candidates.select(*by).join(known.select(*by), by, "left_anti")
        return keep(candidates, f"{table}/round={step}", by)

    by_entity = keep(links.where("_opens").select(entity, *keys), "links/by_entity", [entity])
    by_key = keep(links.select(*keys, entity), "links/by_key", keys)
    first = seeds.select(F.col(entity).cast(links.schema[entity].dataType).alias(entity)).distinct()
    fresh = keep(first, "entities/round=0", [entity])
    step = 0
    while (reached := touched(fresh)) and (max_rounds is None or step < max_rounds):
        step += 1
        leads = _opened(by_entity, reached).join(fresh.select(entity), entity, "left_semi").select(*keys).distinct()
        new_keys = unmet(leads, "keys", keys, step)
        met = _opened(by_key, touched(new_keys)).join(new_keys.select(*keys), keys, "left_semi").select(entity).distinct()
        fresh = unmet(met, "entities", [entity], step)
    schema = T.StructType([*fresh.schema.fields, T.StructField("round", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{base}/entities").drop(BUCKET)
