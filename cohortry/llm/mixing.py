"""Mixing sources to target weights by hash thresholds.

Every document has a hash.  A source takes the documents whose hash is below its threshold, so a larger budget takes a
superset.  The threshold is found from sums of sizes by source and hash bucket: the bucket in which the running sum
passes the budget is split again by the next bits of the hash, until it holds one hash.  Nothing is sorted but the
buckets of one source.  Where a large document at the threshold leaves a gap, further passes over the hashes behind it
take documents that fit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortry.llm.scratch import Scratch, documents

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BITS = 12  # of the hash in each round
NEAR = 0.005  # of the target: a source within it needs no further pass
WIDTH = 3  # hexadecimal digits of a group of bits
ROUNDS = 6  # 6 x 12 bits cover the 64 bits
WORD = r"[^ \t-\r]+"


def digits(h: Column) -> Column:
    """A hash as text: its groups of bits from the top, ``WIDTH`` hexadecimal digits each; it compares like the unsigned hash."""

    def group(k: int) -> Column:
        low = 64 - BITS * (k + 1)  # the last group is shorter
        bits = (F.shiftrightunsigned(h, low) if low >= 0 else h).bitwiseAND(F.lit((1 << (BITS if low >= 0 else BITS + low)) - 1))
        return F.lpad(F.lower(F.hex(bits)), WIDTH, "0")

    return F.concat(*map(group, range(ROUNDS)))


def ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds the weight of each source by its place in the order by code point, null last.

    Places are counted within ranges of the order and shifted by the sizes of the ranges before.
    """
    keyed = sources.withColumn("last", F.col("source").isNull()).repartitionByRange("last", "source").withColumn("part", F.spark_partition_id())
    keyed = scratch.keep(keyed, "ranges")
    sizes = keyed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each shuffle partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("last", "source")) - 1 + F.col("before")
    weights = F.array(*map(F.lit, WEIGHTS))
    return keyed.join(before, "part").withColumn("weight", F.get(weights, (place % len(WEIGHTS)).cast("int"))).drop("last", "part", "before")


def targets(sources: DataFrame, share: float) -> DataFrame:
    """Adds ``target``: shares of the total by weight, at most three times the source's size, the excess reshared.

    In each round the sources that reach their bound drop out and the level (words per unit of weight) rises; only
    one row of sums goes to the driver.
    """
    bound, level, full = F.col("source_size") * F.lit(float(MOST_REPEATS)), 0.0, -1
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        open_ = bound >= F.col("weight") * F.lit(level)
        row = sources.agg(
            F.sum(F.when(~open_, bound).otherwise(0.0)).alias("spent"),
            F.sum(F.when(open_, F.col("weight")).otherwise(0)).alias("weight"),
            F.sum((~open_).cast("int")).alias("full"),
        ).first()
        if not row["weight"] or row["full"] == full:
            break
        full, level = row["full"], (share * total - row["spent"]) / row["weight"]
    return sources.withColumn("target", F.least(bound, F.col("weight") * F.lit(level)))


def narrowed(rows: DataFrame, open_: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``source_key, cut, left, boundary, words``: the hash up to which the words fit into ``need``, what remains of it,
    and the first hash that does not fit with its words (null: all fit).

    Of ``rows``, those count whose hash lies behind ``after`` and whose size is at most ``most``.  Hashes are texts of
    their groups of bits, which compare like the unsigned hash; an empty cut takes nothing.
    """
    open_ = open_.select("source_key", "need", "after", "most").withColumns({"prefix": F.lit(""), "cut": F.lit("")})
    done = None
    for k in range(ROUNDS):
        open_ = scratch.keep(open_, f"{name}-open{k}")
        here = rows.withColumn("digit", F.substring("h", WIDTH * k + 1, WIDTH)).join(open_.select("source_key", "prefix", "after", "most"), "source_key")
        here = here.where((F.col("size") <= F.col("most")) & (F.col("h") > F.col("after")))
        if k:
            here = here.where(F.substring("h", 1, WIDTH * k) == F.col("prefix"))
        sums = here.groupBy("source_key", "digit").agg(F.sum("size").alias("words"), F.min("h").alias("first"), (F.min("h") == F.max("h")).alias("single"))
        running = Window.partitionBy("source_key").orderBy("digit")
        sums = sums.withColumn("upto", F.sum("words").over(running)).join(open_, "source_key")
        # The last bucket that fits entirely, and the one that the budget ends in.
        below = F.col("upto") <= F.col("need")
        hit = ~below & (F.col("upto") - F.col("words") <= F.col("need"))
        best = sums.groupBy("source_key", "need", "prefix", "cut", "after", "most").agg(
            F.max(F.when(below, F.concat("prefix", "digit"))).alias("whole"),
            F.max(F.when(below, F.col("upto"))).alias("fits"),
            F.max(F.when(hit, F.struct("digit", "single", "words", "first"))).alias("hit"),
        )
        best = best.withColumn("cut", F.coalesce(F.rpad("whole", WIDTH * ROUNDS, "f"), "cut")).withColumn("left", F.col("need") - F.coalesce("fits", F.lit(0)))
        best = scratch.keep(best.withColumn("ends", F.col("hit").isNull() | F.col("hit.single")), f"{name}-best{k}")
        part = best.where("ends").select("source_key", "cut", "left", F.col("hit.first").alias("boundary"), "hit.words")
        done = part if done is None else done.unionByName(part)
        open_ = best.where("not ends").select("source_key", F.col("left").alias("need"), "after", "most", F.concat("prefix", "hit.digit").alias("prefix"), "cut")
        if open_.isEmpty():
            break
    return done


def taken_once(passes: str, extra: str) -> Column:
    """Whether one of the passes, or the last document, takes a row beyond the whole repeats."""
    h = F.col("h")
    inside = F.exists(passes, lambda p: (h > p["after"]) & (h <= p["upto"]) & (F.col("size") <= p["most"]))
    return F.coalesce(inside | (h == F.col(extra)), inside, F.lit(False))


def thresholds(rows: DataFrame, sources: DataFrame, scratch: Scratch, near: float | None) -> DataFrame:
    """``source_key, repeats, passes, extra``: whole repeats of every document, and which are taken once more.

    The first pass takes all documents up to a threshold.  Without ``near``, the document there is taken too where that
    brings the sum nearer.  With it, while a source is off its target by more than ``near`` of it, another pass goes on
    behind the document that did not fit, through those that fit into the rest.  Each pass takes a document at least.
    Last, the smallest document left is taken where that brings the sum nearer.
    """
    need = F.col("target") - F.col("repeats") * F.col("source_size")
    state = sources.where("source_size > 0").withColumn("repeats", F.floor(F.col("target") / F.col("source_size")).cast("long"))
    no_pass = F.array().cast("array<struct<after:string,upto:string,most:long>>")
    state = state.select("source_key", "repeats", "target", need.alias("left"), F.lit("").alias("boundary"), F.lit(0).cast("long").alias("words"), no_pass.alias("passes"))
    narrow = rows.where("size > 0").select("source_key", "h", "size")
    off = F.col("left") > (near or 0.0) * F.col("target")
    k = 0
    while True:
        state = scratch.keep(state, f"state{k}")
        active = state.where(off & F.col("boundary").isNotNull()) if k else state
        if active.isEmpty() or k and near is None:
            break
        most = F.floor("left").cast("long") if k else F.lit((1 << 63) - 1)
        wanted = active.select("source_key", F.col("left").alias("need"), F.col("boundary").alias("after"), most.alias("most"))
        found = narrowed(narrow, wanted, scratch, f"pass{k}").select("source_key", "cut", F.col("left").alias("rest"), F.col("boundary").alias("next"), F.col("words").alias("next_words"))
        both = state.join(found.withColumn("more", F.lit(True)), "source_key", "left").join(wanted.select("source_key", "after", "most"), "source_key", "left")
        passes = F.concat("passes", F.array(F.struct("after", F.col("cut").alias("upto"), "most")))
        state = both.select(
            *["source_key", "repeats", "target", F.coalesce("rest", "left").alias("left"), F.col("next").alias("boundary"), F.col("next_words").alias("words")],
            F.when(F.col("more"), passes).otherwise(F.col("passes")).alias("passes"),
        )
        k += 1
    if near is None:
        return state.select("source_key", "repeats", "passes", F.when(2 * F.col("left") >= F.col("words"), F.col("boundary")).alias("extra"))
    short = narrow.join(state.drop("words").where(off), "source_key")
    short = short.withColumn("extra", F.lit(None).cast("string")).where((F.col("size") < 2 * F.col("left")) & ~taken_once("passes", "extra"))
    last = short.groupBy("source_key", "left", "h").agg(F.sum("size").alias("words")).groupBy("source_key", "left").agg(F.min(F.struct("words", "h")).alias("last"))
    last = last.where("last.words < 2 * left").select("source_key", F.col("last.h").alias("extra"))
    return state.join(last, "source_key", "left").select("source_key", "repeats", "passes", "extra")


def mix(docs: DataFrame, scratch: Scratch, share: float = 1.0, near: float | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document a mix of ``share`` times all words takes.

    Returns ``doc_id, source, text_hash, size, source_size, target, taken``: ``taken`` is a whole number of times
    ``size``, three at most.  The threshold of a source for a larger share is never lower, so a larger share takes all
    that a smaller one takes; a source is off its target by half of the document at its threshold at most.  With
    ``near``, a source that is off by more than that share of its target also gets documents behind the threshold that
    fit the rest; these may differ between shares.

    A null text has no words and is never taken; a null source is a source of its own, last in the order.  Repeated
    rows share a hash and are taken together, or not; so are ties.  An empty table gives no rows.  Other columns are
    not read.  Only built-in functions are used.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.concat(F.lit("="), source_col), F.lit("")).alias("source_key"),
        F.xxhash64(text).alias("text_hash"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    ).withColumn("h", digits(F.xxhash64(F.lit("mix"), "doc_id", "text_hash")))
    rows = scratch.keep(rows, "rows")
    sizes = rows.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    sources = scratch.keep(ranked(scratch.keep(sizes, "sizes"), scratch), "ranked")
    sources = scratch.keep(targets(sources, share), "targets")
    cuts = scratch.keep(thresholds(rows, sources, scratch, near), "cuts")
    plan = sources.join(cuts, "source_key", "left").select("source_key", "source_size", "target", F.coalesce("repeats", F.lit(0)).alias("repeats"), "passes", "extra")
    plan = scratch.keep(plan, "plan")
    once = taken_once("passes", "extra").cast("long")
    # A source that takes three repeats of everything has no room for one more.
    times = F.least(F.lit(MOST_REPEATS), F.col("repeats") + once)
    return rows.join(plan, "source_key").select("doc_id", "source", "text_hash", "size", "source_size", "target", (times * F.col("size")).alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents in which the sources share all words."""
    mixed = mix(documents(spark, sf_dir), Scratch(spark, "mixing"), near=NEAR)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op2_mixing": query}
