"""Best-fit packing planned on the histogram of lengths.

Documents become token ids, long ones are cut.  Best fit decreasing then runs over the counts of pieces per length: bins
of equal content are one group, and a length is put into a group as often as it fits.  The plan is a list of slots, a
range of ranks within a length for each; the pieces, ranked within their length, take their slots by a join on the rank.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from cohortry.llm.scratch import Scratch, documents
from cohortry.llm.tokens import byte_letters

LENGTH = 2048
SEPARATOR = 0
SALTS = 16
ROWS_A_SALT = 20_000
RANKS_A_BLOCK = 1_024
#: Below this character, the two libraries know the same letters and digits; other texts are left to the vocabulary's own.
KNOWN = "ɐ"


class ByteCoder:
    """Token ids of a byte-level vocabulary file, without added special tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        byte = {c: b for b, c in enumerate(byte_letters())}
        special = {t["content"]: t["id"] for t in model["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.library = Tokenizer.from_file(path)

    def encode(self, text: str) -> np.ndarray:
        if text and max(text) < KNOWN:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # a very long run of white space is beyond its pattern matcher
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")


@cache
def byte_coder(path: str) -> ByteCoder:
    """One per worker and vocabulary file."""
    return ByteCoder(path)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """``bins, ((length, pieces), ...)``: best fit decreasing, bins of equal content together.

    The same as placing piece after piece, the longest first, into the fullest bin that has room: once a piece is in
    a bin, this bin is the fullest for the next of its length.  A length splits a group at most once, so there are a
    few groups for each length.
    """
    groups: list[list[tuple[int, tuple]]] = [[] for _ in range(capacity + 1)]  # by the room that is left
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in range(length, capacity + 1):
            while left and (groups[room] or room == capacity):
                bins, content = groups[room].pop() if groups[room] else (left, ())
                most = room // length
                full = min(bins, left // most)
                for n, times in ((full, most), (1, left - full * most)) if full < bins else ((full, most),):
                    if n and times:
                        groups[room - times * length].append((n, (*content, (length, times))))
                        bins, left = bins - n, left - n * times
                if bins and content:
                    groups[room].append((bins, content))
    return [g for same in groups for g in same]


def cut(docs: DataFrame, vocabulary: str, length: int, ids: bool, id_col: str, text_col: str) -> DataFrame:
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, end = byte_coder(vocabulary), np.array([SEPARATOR], "<u4").tobytes()
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = mine.encode(text or "").tobytes() + end
                first = (len(coded) // 4 - 1) % length + 1  # what does not fill a sequence comes first
                for k, at in enumerate([0, *range(4 * first, len(coded), 4 * length)]):
                    part = coded[at : at + 4 * (length if k else first)]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if ids else ()))
            columns = zip(*rows) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def ranked(pieces: DataFrame, most: int) -> DataFrame:
    """Adds ``rank``, from 0 within ``length``: counted in salted parts and shifted by the parts before."""
    salts = SALTS + most // ROWS_A_SALT
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")) - 1
    both = salted.withColumn("inside", inside).join(sums.select("length", "salt", before.alias("before")), ["length", "salt"])
    return both.withColumn("rank", F.col("inside") + F.col("before")).drop("salt", "inside", "before")


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, length: int = LENGTH, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay the token ids of all texts, each closed by the separator, into sequences of at most ``length`` ids.

    Only longer documents are cut, into pieces of ``length`` ids, the first of which may be shorter.  Returns a row per
    piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with ``ids``, the piece's ids as
    little-endian unsigned 32-bit numbers.

    Null and empty texts are the separator alone.  Repeated rows, ties and null ids are packed each; other columns are
    not read; an empty table gives no rows.  To the driver go a count per length and the plan, a few groups per length.
    """
    pieces = cut(docs, vocabulary, length, ids, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    # Numbers of rows are fixed once written, whatever is computed again later.
    pieces = scratch.keep(pieces, "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    slots, dealt, sequence = [], dict.fromkeys(counts, 0), 0
    for bins, content in best_fit(counts, length):
        offset = 0
        for kind, n in content:
            slots.append((kind, dealt[kind], dealt[kind] + bins * n, n, sequence, offset))
            dealt[kind] += bins * n
            offset += kind * n
        sequence += bins
    slots = scratch.spark.createDataFrame(slots, "length long, first long, last long, each long, sequence long, at long")
    # A slot range in the blocks of ranks that it touches, so that the join has small keys and each piece meets few slots.
    block = lambda c: F.floor(c / RANKS_A_BLOCK).cast("long")
    slots = scratch.keep(slots.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("last") - 1)))), "slots")
    slim = ranked(pieces.drop("ids"), max(counts.values(), default=0)).withColumn("block", block(F.col("rank")))
    placed = slim.join(slots, ["length", "block"]).where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    nth = F.col("rank") - F.col("first")
    placed = placed.withColumns(
        {"sequence_id": F.col("sequence") + F.floor(nth / F.col("each")).cast("long"), "offset": F.col("at") + nth % F.col("each") * F.col("length")}
    )
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if not ids:
        return placed.select(*columns)
    return placed.join(pieces.select("uid", "ids"), "uid").select(*columns, "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids."""
    return pack(documents(spark, sf_dir), Scratch(spark, "bestfit"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op13_bestfit_packing": query}
