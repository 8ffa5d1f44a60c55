"""Removal of long repeated byte strings, from a parse into phrases that rolling-hash triggers cut.

A string of ``length`` bytes is known by its trigger, the position in it whose gram of ``gram`` bytes has the least
rolling hash.  Neighbouring strings with the same trigger form a phrase, so equal text is parsed into equal phrases
wherever it stands, but for its ends.  Equal phrases that follow each other, as in periodic text, are one row with their
number, so that a few such texts do not make one key hot.  Phrases whose trigger gram occurs once are unique.  In the
dictionary of the others, a phrase that occurs twice is repeated as a whole; phrases that share their trigger gram only
are compared string by string.  Strings are told apart by two rolling hashes of 64 bits each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.llm.jaccard import mixed, utf8
from cohortry.llm.scratch import Scratch, documents

LENGTH = 400
GRAM = 200
PIECE = 1 << 18  # strings of a long text that are parsed at a time
POSITION = 20  # bits of a position within a piece
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LETTERS = [np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64) for seed in (11, 12)]
POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, modulo 2^64."""
    if which not in POWERS or len(POWERS[which][0]) < n:
        size = max(n, 1 << 12)
        out = []
        for x in (BASES[which], pow(BASES[which], -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        POWERS[which] = (out[0], out[1])
    return POWERS[which]


class Rolling:
    """Hashes of any stretches of a byte string."""

    def __init__(self, data: np.ndarray, which: int):
        self.up, self.down = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LETTERS[which][data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, first, last) -> np.ndarray:
        """Of the stretches from ``first`` up to but without ``last``."""
        return (self.sums[last] - self.sums[first]) * self.down[first]

    def grams(self, n: int) -> np.ndarray:
        return (self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n]


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, from running minima within blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def phrases(text: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each run of equal phrases: trigger gram, hash, the starts of its first and last string, and how many phrases it has."""
    out = []
    for at in range(0, len(text) - length + 1, PIECE):
        data = np.frombuffer(text, np.uint8)[at : at + PIECE + length - 1]
        one, two = Rolling(data, 0), Rolling(data, 1)
        grams = mixed(one.grams(gram))
        place = np.uint64((1 << POSITION) - 1)
        least = sliding_least((grams & ~place) | np.arange(len(grams), dtype=np.uint64), length - gram + 1)
        trigger = (least & place).astype(np.int64)
        first = np.flatnonzero(np.diff(trigger, prepend=-1))
        last = np.append(first[1:], len(trigger)) - 1
        mine = trigger[first]
        shape = ((mine - first) * length + last - first).astype(np.uint64)
        out.append((grams[mine].view(np.int64), mixed(two.of(first, last + length) ^ mixed(shape)).view(np.int64), first + at, last + at))
    if not out:
        return (np.zeros(0, np.int64),) * 5
    gram, phrase, first, last = (np.concatenate(c) for c in zip(*out))
    head = np.flatnonzero(np.append(True, (gram[1:] != gram[:-1]) | (phrase[1:] != phrase[:-1])))
    tail = np.append(head[1:], len(gram)) - 1
    return gram[head], phrase[head], first[head], last[tail], tail - head + 1


def parse(docs: DataFrame, length: int, gram: int) -> DataFrame:
    schema = "doc long, text_hash long, gram array<long>, phrase array<long>, first array<long>, last array<long>, n array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [phrases(text, length, gram) for text in utf8(batch.column(2))]
            ends = pa.array(np.cumsum([0, *(len(p[0]) for p in parts)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64))) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["doc", "text_hash", "gram", "phrase", "first", "last", "n"])

    return docs.select("doc", "text_hash", "text").mapInArrow(run, schema)


def strings(docs: DataFrame, length: int) -> DataFrame:
    """Hashes of all strings of the listed phrases (``runs``) of each document."""
    schema = "gram long, phrase long, strings array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for text, runs in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                two = Rolling(np.frombuffer(text, np.uint8), 1)
                for r in runs:
                    at = np.arange(r["first"], r["last"] + 1)
                    keys.append((r["gram"], r["phrase"]))
                    lists.append(two.of(at, at + length).view(np.int64))
            ends = pa.array(np.cumsum([0, *map(len, lists)], dtype=np.int32))
            flat = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
            columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], ["gram", "phrase", "strings"])

    return docs.select("text", "runs").mapInArrow(run, schema)


def remove(docs: DataFrame, length: int, id_name: str) -> DataFrame:
    schema = f"{id_name} long, n_bytes long, n_removed long, n_spans long, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(utf8(batch.column(1)), batch.column(2).to_pylist()):
                if not spans:
                    rows.append((len(text), 0, 0, text))
                    continue
                step = np.zeros(len(text) + 1, np.int64)
                for s in spans:
                    at = np.array(s["offsets"]) + s["first"] if s["offsets"] is not None else np.array([s["first"]])
                    np.add.at(step, at, 1)
                    np.add.at(step, at + length if s["offsets"] is not None else [s["last"] + length], -1)
                gone = np.cumsum(step[:-1]) > 0
                rows.append((len(text), int(gone.sum()), int(np.diff(gone.astype(np.int8), prepend=0).clip(0).sum()), np.frombuffer(text, np.uint8)[~gone].tobytes()))
            kinds = [pa.int64()] * 3 + [pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_name, "n_bytes", "n_removed", "n_spans", "kept"])

    return docs.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else, here or in another text.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes; a cut may fall within a character).
    All occurrences go, the first included; strings are judged on the input.

    Null texts are empty; texts shorter than ``length`` stay whole.  A repeated row is another place of its text.  Null
    ids are kept.  Other columns are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(-(1 << 63))), "text_hash": F.xxhash64("text")})
    parsed = scratch.keep(parse(docs, length, gram), "parsed")
    runs = parsed.select("doc", "text_hash", F.explode(F.arrays_zip("gram", "phrase", "first", "last", "n")).alias("r")).select("doc", "text_hash", "r.*")
    grams = runs.groupBy("gram").agg(F.sum("n").alias("n"), F.min("phrase").alias("lo"), F.max("phrase").alias("hi")).where("n > 1")
    grams = scratch.keep(grams.select("gram", (F.col("lo") == F.col("hi")).alias("pure")), "grams")
    again = scratch.keep(runs.join(grams, "gram"), "again")
    scratch.drop("parsed", "grams")
    mixed_up = again.where("not pure")
    one = (F.col("first") + F.expr("(last - first + 1) div n") - 1).alias("last")  # of the first phrase of a run
    place = F.struct("doc", "text_hash", "first", one)
    dictionary = scratch.keep(mixed_up.groupBy("gram", "phrase").agg(F.sum("n").alias("n"), F.min(place).alias("at")), "dictionary")
    wanted = dictionary.groupBy("at.doc", "at.text_hash").agg(F.collect_list(F.struct("gram", "phrase", "at.first", "at.last")).alias("runs"))
    hashed = scratch.keep(strings(docs.join(wanted, ["doc", "text_hash"]), length).dropDuplicates(["gram", "phrase"]), "strings")
    each = hashed.select("gram", "phrase", F.posexplode("strings").alias("offset", "string"))
    shared = each.groupBy("gram", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "string")
    shared = scratch.keep(shared, "shared")
    scratch.release()
    offsets = each.join(shared, ["gram", "string"]).groupBy("gram", "phrase").agg(F.collect_list("offset").alias("offsets"))
    partly = dictionary.where("n = 1").select("gram", "phrase", "at").join(offsets, ["gram", "phrase"])
    partly = partly.select("at.doc", "at.text_hash", "at.first", "at.last", "offsets")
    whole = again.where("pure").select("doc", "text_hash", "first", "last")
    whole = whole.unionByName(mixed_up.join(dictionary.where("n > 1").select("gram", "phrase"), ["gram", "phrase"]).select("doc", "text_hash", "first", "last"))
    spans = scratch.keep(whole.withColumn("offsets", F.lit(None).cast("array<int>")).unionByName(partly), "spans")
    scratch.drop("again", "dictionary", "strings", "shared")
    # One row for each text, with its spans in order; neighbouring phrases overlap.
    spans = spans.distinct().groupBy("doc", "text_hash").agg(F.collect_list(F.struct("first", "last", "offsets")).alias("spans"))
    return remove(docs.join(spans, ["doc", "text_hash"], "left").select("doc_id", "text", "spans"), length, "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated strings of 400 bytes."""
    kept = remove_repeats(documents(spark, sf_dir), Scratch(spark, "repeats"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op7_suffix_dedup": query}
