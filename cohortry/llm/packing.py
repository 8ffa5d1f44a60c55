"""Packing by cutting-stock column generation.

Documents are cut at the sequence length; what is left of each is rounded up to a class of lengths.  From the
histogram of classes a linear program chooses patterns (how many pieces of each class share a sequence); a knapsack
dynamic program prices new patterns until none would shorten the packing.  The patterns' counts are rounded down, the
rest is filled greedily by class, and the pieces of each class, ranked, are dealt out to the patterns.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from tokenizers import Tokenizer

from cohortry.llm.scratch import Scratch, documents
from cohortry.llm.tokens import END, LONGEST_CACHED, PIECES as SPLIT, PLAIN, byte_letters, utf8

LENGTH = 4096
GRAIN = 16
SEPARATOR = 2
#: The linear program ends when no pattern is worth more than this; its optimum is then at most 0.05 % better.
WORTH = 1.0005
SALTS = 64
ROWS_A_SALT = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Chunks whose ids a worker keeps; a full store starts anew, which changes the speed only.
CHUNKS = 1_000_000
TEXTS = 256  # whose new chunks are encoded together


WORD_END = b"\xff"  # stands for the end of a word; no byte of UTF-8


def merge_ranks(model: dict) -> tuple[dict[bytes, int], np.ndarray]:
    """The vocabulary's merges for a byte-pair encoder, with the end of a word as a byte, and the id of each rank.

    Joining a word's last byte with its end comes before all merges, since the vocabulary starts from such pairs.
    """
    byte, vocab = {c: bytes([b]) for b, c in enumerate(byte_letters())}, model["vocab"]

    def raw(token: str) -> bytes:
        inner = token.removesuffix(END)
        return b"".join(byte[c] for c in inner) + WORD_END * (inner != token)

    ids = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
    ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + WORD_END: 256 + b for b in range(256) if bytes([b]) + WORD_END in ids}
    for m in model["merges"]:
        left, right = m.split(" ") if isinstance(m, str) else m
        ranks.setdefault(raw(left) + raw(right), 512 + len(ranks))
    of = np.zeros(max(ranks.values()) + 1, "<u4")
    for word, rank in ranks.items():
        of[rank] = ids.get(word, 0)
    return ranks, of


class ChunkCoder:
    """Token ids of texts.  Tokens never span white space, so a text's ids are those of its chunks between white space.

    Chunks of plain letters are split into words here and encoded by the faster library; others by the vocabulary's own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            ranks, self.id_of = merge_ranks(json.load(f)["model"])
        self.words = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[bytes, bytes] = {}

    def plain(self, chunk: str) -> bytes:
        ranks: list[int] = []
        for piece in SPLIT.findall(chunk.lower()):
            ranks += self.words._encode_single_piece(piece.encode() + WORD_END)
        return self.id_of[ranks].tobytes()

    def coded(self, chunks: list[bytes]) -> Iterator[bytes]:
        texts = [c.decode() for c in chunks]
        plain = [len(t) <= LONGEST_CACHED and PLAIN.fullmatch(t) and "<|" not in t for t in texts]
        rest = iter(self.library.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        for t, p in zip(texts, plain):
            yield self.plain(t) if p else array("I", next(rest).ids).tobytes()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        chunks = [t.split() for t in texts]  # bytes: the six ASCII white-space characters
        here = set().union(*chunks)
        new = list(here.difference(self.known))
        if len(self.known) + len(new) > CHUNKS:
            self.known, new = {}, list(here)
        self.known.update(zip(new, self.coded(new)))
        out = [b"".join(map(self.known.__getitem__, x)) for x in chunks]
        for c in new:
            if len(c) > LONGEST_CACHED:
                del self.known[c]
        return out


CODERS: dict[str, ChunkCoder] = {}


def chunk_coder(path: str) -> ChunkCoder:
    """One per worker and vocabulary file."""
    if path not in CODERS:
        CODERS[path] = ChunkCoder(path)
    return CODERS[path]


def price(weights: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best pattern: unbounded knapsack by dynamic programming over the capacity."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(1, capacity + 1):
        n = np.searchsorted(weights, c, "right")
        best[c], choice[c] = best[c - 1], -1
        if n:
            worth = best[c - weights[:n]] + values[:n]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], choice[c] = worth[k], k
    pattern, c = np.zeros(len(weights)), capacity
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            pattern[choice[c]] += 1
            c -= int(weights[choice[c]])
    return float(best[capacity]), pattern


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with row exchange, without LAPACK: its threads can block for good in a driver beside Spark."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        best = k + int(np.abs(both[k:, k]).argmax())
        both[[k, best]] = both[[best, k]]
        both[k] /= both[k, k]
        factor = both[:, k].copy()
        factor[k] = 0
        both -= np.multiply.outer(factor, both[k])
    return both[:, n:]


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """``uses, {class: pieces}`` so that every piece of every class has a place."""
    weights = np.array(sorted(counts))
    need = np.array([counts[w] for w in weights], float)
    if not len(weights):
        return []
    basis = np.diag((capacity // weights).astype(float))  # a column for each pattern
    inverse = np.diag(1 / np.diag(basis))
    for k in range(50 * len(weights)):
        value, column = price(weights, inverse.sum(axis=0), capacity)
        if value <= WORTH:
            break
        uses, change = times(inverse, need), times(inverse, column)
        ratio = np.where(change > 1e-9, uses / np.where(change > 1e-9, change, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = column
        if k % 100 == 99:
            inverse = inverted(basis)
        else:
            row = inverse[out] / change[out]
            inverse = inverse - np.outer(change, row)
            inverse[out] = row
    uses = np.floor(times(inverted(basis), need) + 1e-6).astype(int).clip(0)
    left, out = need.astype(int), []
    for k in np.argsort(-uses):
        column = basis[:, k].astype(int)
        n = int(min([uses[k], *(left[column > 0] // column[column > 0])]))
        if n:
            out.append((n, {int(w): int(c) for w, c in zip(weights, column) if c}))
            left -= n * column
    while left.any():  # the rest: largest class first
        column, room = np.zeros(len(weights), int), capacity
        for k in range(len(weights) - 1, -1, -1):
            column[k] = min(left[k], room // weights[k])
            room -= column[k] * weights[k]
        n = int((left[column > 0] // column[column > 0]).min())
        out.append((n, {int(w): int(c) for w, c in zip(weights, column) if c}))
        left -= n * column
    return out


def cut(docs: DataFrame, vocabulary: str, length: int, ids: bool, id_col: str, text_col: str) -> DataFrame:
    schema = PIECES + ", ids binary" * ids
    kinds = [pa.int64()] * 5 + [pa.binary()] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, end = chunk_coder(vocabulary), np.array([SEPARATOR], "<u4").tobytes()
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for first in range(0, batch.num_rows, TEXTS):
                some, rows = batch.slice(first, TEXTS), []
                for doc, coded in zip(some.column(0).to_pylist(), mine.encode(utf8(some.column(1)))):
                    coded += end
                    for at in range(0, len(coded), 4 * length):
                        part = coded[at : at + 4 * length]
                        rows.append((doc, at // 4, len(part) // 4, zlib.crc32(part), len(coded) // 4) + ((part,) if ids else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack(docs: DataFrame, scratch: Scratch, vocabulary: str, length: int = LENGTH, ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lay the token ids of all texts, each closed by the separator, into sequences of at most ``length`` ids.

    Returns a row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, with ``ids``,
    the piece's ids as little-endian unsigned 32-bit numbers.

    Null and empty texts are the separator alone.  Repeated rows and null ids are packed each; other columns are not
    read; an empty table gives no rows.  A row per length class (257 at most) goes to the driver.
    """
    capacity = length // GRAIN
    pieces = cut(docs, vocabulary, length, ids, id_col, text_col).withColumn("uid", F.monotonically_increasing_id())
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / GRAIN).cast("int"))
    # Numbers of rows are fixed once written, whatever is computed again later.
    pieces = scratch.keep(pieces, "pieces")
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}
    plan, sequence, dealt = [], 0, dict.fromkeys(counts, 0)
    for uses, pattern in patterns(counts, capacity):
        for kind, n in pattern.items():
            plan.append((kind, dealt[kind], dealt[kind] + uses * n, n, sequence))
            dealt[kind] += uses * n
        sequence += uses
    plan = scratch.spark.createDataFrame(plan, "class int, first long, last long, pieces long, sequence long")
    plan = scratch.keep(plan.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("first", "last", "pieces", "sequence"))).alias("plan")), "plan")
    # Ranks within a class, counted in salted parts and shifted by the parts before.
    salts = max(SALTS, sum(counts.values()) // (ROWS_A_SALT * max(1, len(counts))))
    slim = pieces.drop("ids").withColumn("salt", F.pmod(F.xxhash64("uid"), F.lit(salts)).cast("int"))
    sums = slim.groupBy("class", "salt").agg(F.count("*").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).drop("n")
    rank = F.row_number().over(Window.partitionBy("class", "salt").orderBy("uid")) - 1
    ranked = slim.withColumn("rank", rank).join(sums, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    # At most 257 rows, one for each class.
    ranked = ranked.join(F.broadcast(plan), "class")
    mine = F.get(F.filter("plan", lambda p: (F.col("rank") >= p["first"]) & (F.col("rank") < p["last"])), F.lit(0))
    ranked = ranked.withColumn("mine", mine).drop("plan", "salt", "before")
    ranked = ranked.withColumn("sequence_id", F.col("mine.sequence") + F.floor((F.col("rank") - F.col("mine.first")) / F.col("mine.pieces")).cast("long"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, 0)
    packed = ranked.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not ids:
        return packed.select(*columns)
    return packed.join(pieces.select("uid", "ids"), "uid").select(*columns, "ids")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4,096 ids."""
    return pack(documents(spark, sf_dir), Scratch(spark, "packing"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op3_packing": query}
