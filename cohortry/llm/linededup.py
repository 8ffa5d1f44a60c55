"""Line dedup with levelled sorted runs of line hashes.

Batches of documents come in order of their ids.  The runs hold every line hash seen so far, each once, in tables
bucketed and sorted by the hash.  A batch is merge-anti-joined with the runs: the hashes that no run has form a new
run, the others are repeats.  When a level has ``FANOUT`` runs they are merged into one run of the next level, so the
number of runs stays logarithmic and a hash is rewritten once per level.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.llm.scratch import Scratch, documents

SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST = 10  # code points of a key that counts
BATCHES = 3
FANOUT = 2
LAST = (1 << 63) - 1
HASH = ["h1", "h2"]


def key_of(line: Column) -> Column:
    inner = F.btrim(line, F.lit(SPACE))
    return F.when(F.octet_length(inner) == F.char_length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


class LineRuns:
    """The runs, and what is known of them: level by level the tables' names."""

    def __init__(self, scratch: Scratch, buckets: int):
        self.scratch, self.buckets, self.spark = scratch, buckets, scratch.spark
        self.levels: list[list[str]] = [[]]

    def write(self, hashes: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        hashes.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", self.scratch.path(name)).saveAsTable(name)
        self.levels[level].append(name)

    def remove(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists {name}")
            self.scratch.drop(name)

    def compact(self) -> None:
        """Merge the runs of each level that has ``FANOUT`` of them.  Runs share no hash."""
        for level, names in enumerate(self.levels):
            if len(names) >= FANOUT:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                merged = self.spark.table(names[0])
                for name in names[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                self.write(merged, level + 1)
                self.levels[level] = []
                self.remove(names)

    def add(self, hashes: DataFrame, name: str) -> DataFrame:
        """Take a batch's distinct hashes; returns them with ``seen``: whether a run had them before."""
        marked = hashes.withColumn("seen", F.lit(False))
        for run in [n for level in self.levels for n in level]:
            mine = self.spark.table(run).select(*HASH, F.lit(True).alias("here"))
            marked = marked.join(mine, HASH, "left").withColumn("seen", F.col("seen") | F.col("here").isNotNull()).drop("here")
        marked = self.scratch.keep(marked, name)
        self.write(marked.where("not seen").select(*HASH), 0)
        self.compact()
        return marked


def drops(docs: DataFrame, scratch: Scratch, batches: int = BATCHES) -> DataFrame:
    """``doc, text_hash, pos``: the lines to drop of ``docs`` (``doc, text_hash, text``)."""
    lines = docs.select("doc", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("key", key_of(F.col("line")))
    lines = lines.where(F.char_length("key") >= LEAST)
    lines = lines.select("doc", "text_hash", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    ends = docs.select(F.percentile_approx("doc", [(i + 1) / batches for i in range(batches - 1)], 10_000)).first()[0] or []
    batch = F.lit(0)
    for end in ends:
        batch = batch + (F.col("doc") > end).cast("int")
    lines = scratch.keep(lines.withColumn("batch", batch), "lines", ("batch",))
    runs = LineRuns(scratch, int(scratch.spark.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for b in range(len(ends) + 1):
        mine = lines.where(F.col("batch") == b)
        hashes = mine.groupBy(*HASH).agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        marked = runs.add(hashes, f"marked{b}")
        repeats = marked.where("seen or first < last").select(*HASH, F.when(F.col("seen"), F.lit(None)).otherwise(F.col("first")).alias("first"))
        found = mine.join(repeats, HASH).where("first is null or doc > first").select("doc", "text_hash", "pos")
        found = scratch.keep(found, f"drops{b}")
        scratch.drop(f"marked{b}")
        out = found if out is None else out.unionByName(found)
    runs.remove([n for level in runs.levels for n in level])
    scratch.drop("lines")
    return out


def dedup_lines(docs: DataFrame, scratch: Scratch, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drop lines that an earlier document has.

    All columns of ``docs`` with the text less its dropped lines, and a struct ``line_dedup`` of ``n_lines`` (before)
    and ``n_dropped``.  A line's key is the line without white space at its ends and with A-Z in lower case; keys of at
    least ten code points that two or more documents have stay only in the document with the smallest id.

    A null or empty text is one empty line; a null id counts as the largest.  Rows with the same id are one document:
    its lines are no repeats of each other.  Rows with a null id are one document too, so lines that only they share
    stay.  A column ``line_dedup`` of the input is replaced, all others are kept whatever their names.  Only built-in
    functions are used.
    """
    text = F.coalesce(text_col, F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    frame = docs.select(rest.alias("rest"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    found = drops(frame.select("doc", "text_hash", "text"), scratch, batches)
    found = found.groupBy("doc", "text_hash").agg(F.collect_set("pos").alias("out"))
    both = frame.join(found, ["doc", "text_hash"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("out"))
    text = F.when(F.col("out").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("lines"), i)), "\n"))
    facts = F.struct(F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"))
    columns = [text.alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns if c != "line_dedup"]
    return both.select(*columns, F.when(F.lit(True), facts).alias("line_dedup"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps of its lines."""
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"), Scratch(spark, "linededup"))
    return kept.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


LINES = f"""
  lines as (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
    from {{docs}}),
  keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as line_key from lines),
  repeats as (
    select line_key, min(doc_id) as first from keyed where length(line_key) >= {LEAST} group by line_key having count(distinct doc_id) > 1),
  flagged as (
    select k.*, coalesce(k.doc_id > r.first, false) as dropped from keyed k left join repeats r on k.line_key = r.line_key)"""
QUERIES = {"op4_line_dedup": query}
ORACLES = {
    "op4_line_dedup": f"""
with {LINES.format(docs="documents")}
select doc_id, count(*) as n_lines, cast(count(*) filter (dropped) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from flagged group by doc_id"""
}
