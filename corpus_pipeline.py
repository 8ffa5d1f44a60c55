"""A training corpus from ``documents``: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes what its predecessor kept, with the columns of ``documents``; the last lays the tokens into sequences.
Other columns of its input are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm import jaccard, linededup, mixing, packing, quality
from cohortry.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules accept.  A verdict belongs to an id, text and language."""
    keys = {"__text": F.xxhash64(F.coalesce("text", F.lit(""))), "__lang": F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))}
    docs, scratch = docs.select(*COLUMNS), Scratch(spark, "pipeline-quality")
    keyed = docs.withColumns(keys)
    named = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "lang").alias("doc_id"), "text", "lang")
    kept = quality.judge(named, scratch).where("kept").select("doc_id.*").distinct()
    kept = kept.select(F.col("doc_id").alias("__id"), F.col("h").alias("__text"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("__lang"))
    on = [keyed["doc_id"].eqNullSafe(kept["__id"]), keyed["__text"] == kept["__text"], keyed["__lang"] == kept["__lang"]]
    return keyed.join(kept, on, "left_semi").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier document has; ``n_chars`` follows the text."""
    out = linededup.dedup_lines(docs.select(*COLUMNS), Scratch(spark, "pipeline-lines"))
    return out.withColumn("n_chars", F.when(F.col("line_dedup.n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, with the smallest id, of each group of near duplicates (five words, 0.8).

    A node is an id with a text, so rows that share an id but not the text are told apart.  Null ids come last.  Of
    repeated rows one stays; empty texts are no duplicates.
    """
    scratch = Scratch(spark, "pipeline-jaccard")
    docs = docs.select(*COLUMNS).withColumn("__node", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = jaccard.link(docs.select("__node", "text"), scratch, 5, 80, id_col="__node").where("n_shingles > 0").distinct()
    nodes = docs.groupBy("__node").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    nodes = scratch.keep(nodes.join(groups, F.col("__node") == groups["doc_id"]).select("__node", "id", "n", "component_id"), "nodes")
    first = nodes.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__node")).alias("first"))
    rest = nodes.join(first, "component_id").where("__node <> first.__node").select("__node")
    left = docs.join(rest, "__node", "left_anti")
    several = nodes.where("n > 1").select("__node")
    once = left.join(several, "__node", "left_semi").dropDuplicates(["__node"])
    return left.join(several, "__node", "left_anti").unionByName(once).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix(docs, Scratch(spark, "pipeline-mixing"), near=mixing.NEAR).where("taken > 0")
    taken = taken.select("doc_id", "source", "text_hash", (F.col("taken") / F.col("size")).cast("int").alias("times")).distinct()
    keyed = docs.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    on = [keyed[c].eqNullSafe(taken[c]) for c in ("doc_id", "source")] + [keyed["text_hash"] == taken["text_hash"]]
    both = keyed.join(taken, on).select(*[keyed[c] for c in COLUMNS], "times")
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4,096 ids."""
    return packing.pack(docs.select(*COLUMNS), Scratch(spark, "pipeline-packing"), public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Packing needs token ids, which SQL has not.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = scratch.keep(docs, f"stage{number}")
    return docs
