"""Similarity join of documents on word shingles.

Documents are dealt into tiles of two neighbouring size bands; only such pairs can be similar enough.  Within a tile the
hash range of the shingles is cut into more parts than a linked pair can differ in, so a linked pair agrees on all
shingles of several parts and meets in as many cells, each the tile with the hash of a part.  A document leaves its most
frequent cells, one less than it must share, so that a passage of many documents does not bring them together.  In a cell,
hashed bitmaps bound the overlap of a pair from above; what passes is checked exactly by intersecting the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortry.llm.components import components, extended
from cohortry.llm.scratch import Scratch, documents

BITMAP = 16  # words of 64 bits
SPARE = 8  # a pair must share a cell more than one for so many shingles that it may differ in
BLOCK = 1_024  # documents of a cell that are compared with as many others in one group
ROWS_OUT = 1 << 10  # rows of an output batch
ROUNDS = 2  # in which another document of each open cell is compared with its members
SLICES = 6  # of the wide table of cells, which is narrowed to one row a class slice by slice, and of the cells, which are counted so


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit permutation."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``width`` words; of all words together where there are fewer."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        out = out * np.uint64(0x9E3779B97F4A7C15) + mixed(h[k : k + n])
    return np.unique(mixed(out + np.uint64(min(width, len(words)))))


@cache
def band_of(size: int, percent: int) -> tuple[int, int, int]:
    """The size's band and the largest sizes of this band and the next."""
    first, band = 1, 0
    while True:
        after = first * 100 // percent + 1
        if size < after:
            return band, after - 1, after * 100 // percent
        first, band = after, band + 1


def cells(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """The cells of a document with the shingles ``s``, and how many of them are to spare in its even and its odd tile.

    The lowest bit of a cell tells the tile's.  In a common tile, a linked pair shares more cells than either has to spare.
    """
    free = [0, 0]
    if not len(s):
        return np.zeros(0, np.uint64), free
    band, top, above = band_of(len(s), percent)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + np.uint64(1)))])
    out = []
    for tile, most in ((band, top), (band + 1, above)):
        apart = 2 * most * (100 - percent) // (100 + percent)
        # A pair agrees on more than ``spare`` parts; a document with no more empty parts than that can leave them out.
        # What is then left of ``spare`` it need not share; one that keeps its empty parts may share one with the other.
        spare = 1 + apart // SPARE
        parts = apart + 1 + spare
        at = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        edge = np.searchsorted(at, np.arange(parts + 1, dtype=np.uint64))
        filled = edge[1:] > edge[:-1]
        empty = parts - int(filled.sum())
        if empty > spare:
            filled[:] = True
        else:
            free[tile & 1] = spare - empty
        key = mixed(np.arange(parts, dtype=np.uint64) + np.uint64((tile + 1) << 32))
        hashed = mixed((sums[edge[1:]] - sums[edge[:-1]]) ^ key)[filled]
        out.append(hashed & ~np.uint64(1) | np.uint64(tile & 1))
    return np.concatenate(out), free


def bitmap(s: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each bit, so that what two documents share cancels out at any size."""
    hits = np.bincount((s & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP)
    return np.packbits((hits & 1).astype(np.uint8)).view(np.int64)


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n_shingles, set1, set2, cells, free0, free1, b0..``: the shingle set's size, hash, cells and bitmap."""
    schema = "doc_id long, n_shingles long, set1 long, set2 long, cells array<long>, free0 int, free1 int, " + ", ".join(f"b{i} long" for i in range(BITMAP))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, max(batch.num_rows, 1), ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                sizes, hashes, lists, spared, maps = [], [], [], [], []
                for text in utf8(part.column(1)):
                    s = shingles(text, width)
                    sizes.append(len(s))
                    hashes.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                    own, free = cells(s, percent)
                    lists.append(own.view(np.int64))
                    spared.append(free)
                    maps.append(bitmap(s))
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
                both = np.array(hashes, np.int64).reshape(-1, 2)
                spared = np.array(spared, np.int32).reshape(-1, 2)
                bits = np.array(maps, np.int64).reshape(-1, BITMAP)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
                    + [pa.array(spared[:, 0]), pa.array(spared[:, 1])]
                    + [pa.array(bits[:, i]) for i in range(BITMAP)],
                    ["doc_id", "n_shingles", "set1", "set2", "cells", "free0", "free1", *(f"b{i}" for i in range(BITMAP))],
                )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def may_link(percent: int, x: str = "x", y: str = "y") -> Column:
    """Whether sizes and bitmaps leave room for a link: differing bits bound the symmetric difference from below."""
    nx, ny = F.col(f"{x}.n_shingles"), F.col(f"{y}.n_shingles")
    apart = F.lit(0)
    for i in range(BITMAP):
        apart = apart + F.bit_count(F.col(f"{x}.b{i}").bitwiseXOR(F.col(f"{y}.b{i}")))
    # With d elements apart: intersection (nx + ny - d) / 2, union (nx + ny + d) / 2.
    apart = F.greatest(apart.cast("long"), F.abs(nx - ny))
    return 100 * (nx + ny - apart) >= percent * (nx + ny + apart)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs ``a, b`` that are linked, by exact intersection of the sorted shingle arrays."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                sets = [shingles(text, width).tobytes() for text in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["doc_id", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")  # merges two sorted runs
                shared = int((both[1:] == both[:-1]).sum())
                good.append(100 * shared >= percent * (len(x) + len(y) - shared) and shared > 0)
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    sets = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(arrays, "doc_id long, s binary")
    sets = scratch.keep(sets, f"{name}-sets")
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb")
    out = scratch.keep(both.mapInArrow(check, "a long, b long").distinct(), f"{name}-links")
    scratch.drop(f"{name}-sets")
    return out


def link(docs: DataFrame, scratch: Scratch, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that are linked, directly or through others: ``doc_id, n_shingles, component_id``.

    Two documents link when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    Documents with equal sets are one class and join its smallest id; links between classes are verified until no
    cell holds an unchecked pair of different components, so no link that could join two components is left out.

    Empty and null texts have no shingles and link with nothing.  Rows with the same id are one node.  Rows with a null
    id stay alone, with a null component.  Other columns are not read; an empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    described = describe(docs, width, percent).withColumn("slice", F.pmod("set1", F.lit(SLICES)).cast("int"))
    facts = scratch.keep(described, "facts", ("slice",))
    usable = facts.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    classes = scratch.keep(classes, "classes")
    copies = usable.join(classes.where("n > 1"), ["set1", "set2", "n_shingles"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    copies = scratch.keep(copies, "copies")
    sizes = scratch.keep(facts.select("doc_id", "n_shingles"), "sizes")
    same = [F.first(c).alias(c) for c in ("cells", "free0", "free1", *(f"b{i}" for i in range(BITMAP)))]  # they follow from the set
    for k in range(SLICES):  # a slice goes as soon as it is narrowed, so the cells do not lie on disk twice
        part = usable.where(F.col("slice") == k).groupBy("set1", "set2", "n_shingles").agg(F.min("doc_id").alias("doc_id"), *same)
        mine = scratch.keep(part.drop("set1", "set2"), f"mine{k}")
        scratch.drop(f"facts/slice={k}")
    mine = scratch.read_all([f"mine{k}" for k in range(SLICES)], mine)
    bits = ["n_shingles", *(f"b{i}" for i in range(BITMAP))]
    narrow = scratch.keep(mine.select("doc_id", *bits), "narrow")
    scratch.drop("facts")
    entries = mine.select("doc_id", F.explode("cells").alias("cell"))
    for k in range(SLICES):  # most cells hold one document; the shuffle files of a slice go before the next is dealt out
        part = entries.where(F.pmod(F.shiftright("cell", 1), F.lit(SLICES)) == k)
        shared = scratch.keep(part.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), f"shared{k}")
        scratch.release()
        common = scratch.keep(part.join(shared, "cell"), f"common{k}")
        scratch.drop(f"shared{k}")
    common = scratch.read_all([f"common{k}" for k in range(SLICES)], common)
    # Of a pair's cells the rarest stays on both sides: a document leaves fewer cells than it shares with any linked one.
    free = mine.select("doc_id", "free0", "free1")
    own = Window.partitionBy("doc_id", F.expr("cell & 1")).orderBy(F.desc("n"), "cell")
    entries = common.withColumn("place", F.row_number().over(own)).join(free, "doc_id")
    entries = entries.where("place > if(cell & 1 = 0, free0, free1)").select("cell", "doc_id")
    entries = scratch.keep(entries, "entries")
    scratch.drop(*(f"{name}{k}" for name in ("mine", "common") for k in range(SLICES)), "classes")
    groups = entries.groupBy("cell").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).where("leader < last").select("cell", "leader")
    groups = scratch.keep(groups, "groups")
    # Each member of a cell against the cell's first document.
    met = scratch.keep(entries.join(groups, "cell").select("cell", "doc_id", "leader"), "met")
    scratch.drop("groups", "entries")
    pairs = met.where("doc_id <> leader").groupBy(F.col("leader").alias("a"), F.col("doc_id").alias("b")).agg(F.count("*").alias("cells"))
    tried = scratch.keep(pairs, "pairs0")
    near = scratch.keep(filtered(tried, narrow, percent), "near0")
    # Arrays are wide: first each document with the one it shares most cells with, then what still joins components.
    best = near.groupBy("b").agg(F.max(F.struct("cells", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    best = scratch.keep(best, "best")
    found = components(copies.unionByName(verified(best, docs, width, percent, scratch, "first")), scratch, "c0")
    rest = scratch.keep(between(near.select("a", "b").join(best, ["a", "b"], "left_anti"), found), "rest")
    if not rest.isEmpty():
        found = extended(found, verified(rest, docs, width, percent, scratch, "rest"), scratch, "c1")
    # Near copies need not be linked with the first document of their cells: others of each cell, drawn anew in each round.
    for k in range(ROUNDS):
        placed = scratch.keep(place(met, found), f"placed{k}")
        drawn = F.struct(F.xxhash64("doc_id", F.lit(k)).alias("h"), F.col("doc_id").alias("first"), F.col("component").alias("of"))
        drawn = placed.groupBy("cell").agg(F.min(drawn).alias("l"), F.min("component").alias("lo"), F.max("component").alias("hi"))
        drawn = scratch.keep(drawn.where("lo < hi").select("cell", "l.first", "l.of"), f"drawn{k}")
        if drawn.isEmpty():
            break
        pairs = placed.join(drawn, "cell").where("component <> of").select(F.least("doc_id", "first").alias("a"), F.greatest("doc_id", "first").alias("b"))
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("cells")).join(tried.select("a", "b"), ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs, f"again{k}")
        near = scratch.keep(filtered(pairs, narrow, percent), f"nearer{k}")
        if not near.isEmpty():
            found = extended(found, verified(near.select("a", "b"), docs, width, percent, scratch, f"drawn{k}"), scratch, f"d{k}")
        tried = tried.unionByName(pairs)
        scratch.drop(f"placed{k}", f"drawn{k}", f"nearer{k}")
    # Cells whose members are in different components still: all remaining pairs of different components.
    placed = scratch.keep(place(met, found), "placed")
    split = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("n > 2 and lo < hi")
    split = split.select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = placed.join(split, "cell").join(narrow, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tile = [F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    open_ = scratch.keep(open_.select("cell", *tile, "block", "doc_id", "component", *bits), "open")
    # Both sides are read alike, so that they are shuffled once; pairs with the cell's first document come up again here.
    x, y = open_.alias("x"), open_.alias("y")
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("cell", "lo", "hi")]
    apart = (F.col("x.doc_id") < F.col("y.doc_id")) & (F.col("x.component") != F.col("y.component"))
    crossing = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.block") != F.col("y.block"))
    more = x.join(y, [*same, apart, crossing, may_link(percent)]).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    more = scratch.keep(more.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs1")
    if not more.isEmpty():
        found = extended(found, verified(more, docs, width, percent, scratch, "second"), scratch, "c2")
    scratch.drop("met", "placed", "open", "pairs0", "pairs1", "near0", "best", "rest", "narrow", *(f"{name}{k}" for name in ("again", "placed", "drawn") for k in range(ROUNDS)))
    out = sizes.join(found, F.col("doc_id") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def filtered(pairs: DataFrame, narrow: DataFrame, percent: int) -> DataFrame:
    x, y = narrow.alias("x"), narrow.alias("y")
    both = pairs.join(x, F.col("a") == F.col("x.doc_id")).join(y, F.col("b") == F.col("y.doc_id"))
    return both.where(may_link(percent)).select("a", "b", "cells")


def place(met: DataFrame, found: DataFrame) -> DataFrame:
    """The members of the cells with their components."""
    both = met.join(found, F.col("doc_id") == F.col("node"), "left")
    return both.select("cell", "doc_id", F.coalesce("component", "doc_id").alias("component"))


def between(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose documents are in different components."""
    one = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = found.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(one, "a", "left").join(two, "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents at three-word shingles and a similarity of 0.9."""
    return link(documents(spark, sf_dir), Scratch(spark, "jaccard"), 3, 90)


QUERIES = {"op6_ngram_jaccard": query}
ORACLES = {
    "op6_ngram_jaccard": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
sets as (
  select doc_id, list_distinct(case
    when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]))
    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as s
  from words),
each as (select doc_id, len(s) as n, unnest(s) as shingle from sets),
links as (
  select x.doc_id as a, y.doc_id as b from each x join each y on x.shingle = y.shingle and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(doc_id, other) as (
  select doc_id, doc_id from sets union select r.doc_id, l.b from reach r join links l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.component_id
from sets s join (select doc_id, min(other) as component_id from reach group by doc_id) m on m.doc_id = s.doc_id"""
}
