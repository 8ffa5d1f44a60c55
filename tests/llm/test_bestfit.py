"""Best-fit packing against the tokenizer library and against placing one piece at a time."""

import json
import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortry.llm import bestfit
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import SCHEMA, frame, rows, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(library):
    coder, rng = bestfit.byte_coder(PATH), random.Random(7)
    vocab = json.load(open(PATH, encoding="utf-8"))["model"]["vocab"]
    alphabet = "aZé ß\t\n\r\x0b\x0c\x1c\x1f\x85\xa0'stredlvm09²½ªº!?<|>endoftextİǅɏ 　あ́😀"
    strings = ["", " ", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", " " * 70_000 + "x", "\n" * 5_000, "xq" * 30_000, *texts()]
    strings = [s or "" for s in strings] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(4_000)]
    strings += [t.replace("Ġ", " ").replace("Ċ", "\n") for t in vocab]
    for s in strings:
        assert coder.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids, repr(s)


def one_by_one(counts, capacity):
    """Rooms left by best fit decreasing."""
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect_left(rooms, length)
            room = rooms.pop(k) if k < len(rooms) else capacity
            insort(rooms, room - length)
    return Counter(rooms)


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 400])
    counts = {n: rng.choice([1, 2, 3, 40, 300]) for n in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 40)))}
    plan = bestfit.best_fit(counts, capacity)
    placed, rooms = Counter(), Counter()
    for bins, content in plan:
        rooms[capacity - sum(length * n for length, n in content)] += bins
        for length, n in content:
            placed[length] += bins * n
    assert placed == counts and rooms == one_by_one(counts, capacity)


def test_plan_stays_small():
    """Counts of any size and all lengths give a few groups for each length."""
    rng = random.Random(1)
    counts = {n: rng.randrange(1, 10**9) for n in range(1, 2049)}
    plan = bestfit.best_fit(counts, 2048)
    assert len(plan) < 4 * 2048 and sum(bins * n for bins, content in plan for _, n in content) == sum(counts.values())


def check(got, docs, library, length):
    of = defaultdict(list)
    for r in got:
        of[r["doc_id"]].append(r)
    for doc, some in Counter((r[0], r[1]) for r in docs).items():
        coded = np.array([*library.encode(doc[1] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(coded) % length or length
        edges = [0, *range(first, len(coded) + 1, length)]
        want = [(k, a, b - a, zlib.crc32(coded[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        mine = Counter((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in of[doc[0]])
        assert all(mine[w] >= some for w in want), doc[0]
    assert len(got) == sum(-(-(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1) // length) for r in docs)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= length
    counts = Counter(r["length"] for r in got)
    assert len(by) == sum(one_by_one(counts, length).values())


@pytest.mark.parametrize("length", [64, 2048])
def test_packing(spark, library, length, monkeypatch):
    monkeypatch.setattr(bestfit, "RANKS_A_BLOCK", 8)
    out = bestfit.pack(frame(spark), Scratch(spark, "t"), PATH, length, ids=True)
    got = out.collect()
    check(got, rows(), library, length)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)


def test_equal_lengths_nulls_and_nothing(spark, library):
    """A third of the rows of one length; null ids; no rows."""
    docs = [(None if k % 9 == 0 else k, "same words here" if k % 3 else f"text number {k} " * (k % 50)) for k in range(3_000)]
    got = bestfit.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), Scratch(spark, "t"), PATH).collect()
    check(got, docs, library, 2048)
    assert bestfit.pack(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), PATH).count() == 0


def test_query(spark, library):
    got = bestfit.query(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    check(got, docs, library, 2048)
