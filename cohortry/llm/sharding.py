"""Resharding by minimum-cost flow: from the sizes of the old shards and the capacities of the new ones to the block
transfers that move the fewest bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortry.llm.scratch import Scratch, documents

OVERHEAD = 16
OLD, NEW = 32, 40
LEAST_BLOCKS = 256  # blocks of a size class in an old shard, at least
ROWS_A_BLOCK = 2_000
BLOCK = ["old", "size_class", "block"]


def cheapest_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Units to send from each old shard to each new one at the least total cost.

    Successive shortest paths on the graph source -> old -> new -> sink; the graph has a node for each shard.
    """
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    n, m = len(supply), len(capacity)
    while any(left):
        far = 1 << 60
        dist = [0 if left[i] else far for i in range(n)] + [far] * m
        came: list[int] = [-1] * (n + m)
        changed = True
        while changed:  # Bellman-Ford: backward edges have negative costs
            changed = False
            for i in range(n):
                if dist[i] < far:
                    for j in range(m):
                        if dist[i] + cost(i, j) < dist[n + j]:
                            dist[n + j], came[n + j], changed = dist[i] + cost(i, j), i, True
            for (i, j), units in flow.items():
                if units and dist[n + j] - cost(i, j) < dist[i]:
                    dist[i], came[i], changed = dist[n + j] - cost(i, j), n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, node = [], n + end
        while came[node] >= 0:
            path.append((came[node], node))
            node = came[node]
        units = min([left[node], room[end], *(flow[v, u - n] for u, v in path if u >= n)])
        for u, v in path:
            edge = (u, v - n) if u < n else (v, u - n)
            flow[edge] = flow.get(edge, 0) + (units if u < n else -units)
        left[node] -= units
        room[end] -= units
    return {e: units for e, units in flow.items() if units}


def transfers(sizes: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """``old, new, from, to``: stretches of each old shard's bytes and where they go; what stays comes first."""
    total = sum(sizes.values())
    capacity = [total // shards + (j < total % shards) for j in range(shards)]
    old = sorted(sizes)
    flow = cheapest_flow([sizes[i] for i in old], capacity, lambda i, j: int(old[i] != j))
    out = []
    for k, i in enumerate(old):
        at = 0
        for j in sorted((j for e, j in flow if e == k), key=lambda j: (j != i, j)):
            out.append((i, j, at, at + flow[k, j]))
            at += flow[k, j]
    return out


def block_transfers(rows: DataFrame, shards: int, scratch: Scratch) -> DataFrame:
    """Where each block goes as a whole: ``old, size_class, block, n, bytes, shard``.

    Takes the documents' ``size`` with the block they are in.  The flow gives each old shard's stretches of bytes; a
    block goes where its middle falls.  One total per old shard goes to the driver.
    """
    blocks = scratch.keep(rows.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "blocks")
    totals = {r["old"]: r["bytes"] for r in blocks.groupBy("old").agg(F.sum("bytes").alias("bytes")).collect()}
    plan = scratch.spark.createDataFrame(transfers(totals, shards), "old int, shard int, first long, last long")
    plan = plan.groupBy("old").agg(F.collect_list(F.struct("first", "last", "shard")).alias("plan"))
    order = Window.partitionBy("old").orderBy("size_class", "block").rowsBetween(Window.unboundedPreceding, 0)
    middle = blocks.withColumn("middle", F.sum("bytes").over(order) - F.col("bytes") / 2)
    # A row for each old shard, with at most a stretch for each new one.
    goes = F.filter("plan", lambda s: (F.col("middle") >= s["first"]) & (F.col("middle") < s["last"]))
    return middle.join(F.broadcast(plan), "old").select(*BLOCK, "n", "bytes", F.get(goes, F.lit(0))["shard"].alias("shard"))


def reshard(docs: DataFrame, old, shards: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Move blocks of documents from their ``old`` shards (a column or expression) to ``shards`` new ones of near equal bytes.

    Returns ``doc_id, size, text_crc32, old, size_class, block, shard, slot``.  A block is a hash bucket of one size class
    of an old shard and moves or stays as a whole.  Within an old shard the blocks lie by falling size class, so the ends
    of the stretches that move fall among blocks of small documents.

    The bytes decide alone: equal texts with different ids are different documents and may part.  A null text has no
    bytes; null ids are hashed as such; repeated rows are placed each, in one block; other columns are not read.
    """
    crc = F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"), crc.alias("text_crc32"), old.cast("int").alias("old"))
    rows = scratch.keep(rows, "rows")
    most = rows.groupBy("old").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, most // ROWS_A_BLOCK)
    rows = rows.withColumns({"size_class": -F.floor(F.log2("size") * 2).cast("int"), "block": F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(blocks)).cast("int")})
    moves = scratch.keep(block_transfers(rows, shards, scratch), "moves")
    first = F.sum("n").over(Window.partitionBy("shard").orderBy(*BLOCK).rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    rank = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("doc_id", "text_crc32")) - 1
    slots = rows.withColumn("rank", rank).join(moves.select(*BLOCK, "shard", first.alias("before")), BLOCK)
    return slots.select("doc_id", "size", "text_crc32", *BLOCK, "shard", (F.col("before") + F.col("rank")).cast("long").alias("slot"))


def rewrite(docs: DataFrame, plan: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the new files of the shards that gain or lose documents, in order of ``slot``; the others stay as they are.

    Returns the affected shards.
    """
    moved = plan.where("old <> shard")
    affected = moved.select("old").union(moved.select("shard")).distinct().withColumnRenamed("old", "shard")
    crc = F.crc32(F.encode(F.coalesce(text_col, F.lit("")), "UTF-8"))
    keyed = docs.withColumn("text_crc32", crc)
    rows = plan.join(affected, "shard", "left_semi").dropDuplicates(["doc_id", "text_crc32"]).join(keyed, [plan["doc_id"].eqNullSafe(keyed[id_col]), plan["text_crc32"] == keyed["text_crc32"]])
    rows = rows.select("shard", "slot", *[keyed[c] for c in docs.columns if c not in ("shard", "slot")])
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)
    return affected


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents from 32 shards by a hash of the id to 40 shards of near equal bytes."""
    moved = reshard(documents(spark, sf_dir), F.pmod(F.xxhash64("doc_id"), F.lit(OLD)), NEW, Scratch(spark, "sharding"))
    return moved.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_sharding": query}
