"""Links and components against all pairs, on a small fixture."""

import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from cohortry.llm import jaccard
from cohortry.llm.components import components, extended
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import SCHEMA, frame, rows, texts


def brute(docs, width, percent):
    sets = {}
    for r in docs:
        words = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return Counter((r[0], len(sets[r[0]]), root(r[0])) for r in docs)


def chained(n=60, seed=5):
    """Texts in which each differs a little from the one before, and groups that share long passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    words, out = [word() for _ in range(90)], []
    for _ in range(n):
        words = list(words)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = word()
        out.append(" ".join(words))
    passage = [word() for _ in range(60)]
    for _ in range(40):
        out.append(" ".join([*passage, *(word() for _ in range(rng.randint(1, 9)))]))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components_like_all_pairs(spark, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    values = [*texts(), *chained()]
    got = jaccard.link(frame(spark, values), Scratch(spark, "t"), width, percent)
    assert Counter(map(tuple, got.collect())) == brute(rows(values), width, percent)


def test_linked_sets_share_more_cells_than_they_leave():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for size in (1, 2, 5, 9, 19, 40, 100, 400, 2000):
            for _ in range(40):
                x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
                out = rng.integers(0, len(x) // 5 + 1)
                y = np.unique(np.concatenate([x[rng.permutation(len(x))[out:]], rng.integers(0, 2**64, rng.integers(0, size // 5 + 1), dtype=np.uint64)]))
                both = len(np.intersect1d(x, y))
                if both and 100 * both >= percent * (len(x) + len(y) - both):
                    (cx, fx), (cy, fy) = jaccard.cells(x, percent), jaccard.cells(y, percent)
                    same = np.intersect1d(cx, cy)
                    tiles = [{jaccard.band_of(len(s), percent)[0] + k for k in (0, 1)} for s in (x, y)]
                    for tile in set.intersection(*tiles):
                        assert (same % 2 == tile % 2).sum() > max(fx[tile % 2], fy[tile % 2])


def test_bitmaps_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    for size in (1, 30, 800, 20_000):
        for out in (0, 1, size // 10, size):
            x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
            y = np.unique(np.concatenate([x[out:], rng.integers(0, 2**64, out, dtype=np.uint64)]))
            seen = int(np.bitwise_count((jaccard.bitmap(x) ^ jaccard.bitmap(y)).view(np.uint64)).sum())
            assert seen <= len(np.setxor1d(x, y))
            assert seen > 0 or not out


def test_nothing_to_link(spark):
    assert jaccard.link(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    assert [r["component_id"] for r in jaccard.link(frame(spark, [None, ""]), Scratch(spark, "t")).sort("doc_id").collect()] == [0, 1]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 95)], "a long, b long")
    got = dict(map(tuple, components(edges, Scratch(spark, "t"), "c").collect()))
    assert got == {**dict.fromkeys(range(41), 0), 100: 90, 90: 90, 95: 90}


def test_the_cells_do_not_lie_on_disk_twice(spark, monkeypatch):
    rng = random.Random(8)
    data = [(i, " ".join(rng.choices("abcdefghijklmnop", k=150))) for i in range(1200)]
    data += [(5000 + i, data[i][1]) for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    scratch, keep, bytes_at = Scratch(spark, "t"), Scratch.keep, {}

    def kept(self, df, name, *more):
        out = keep(self, df, name, *more)
        folder = self.root.removeprefix("file:")
        bytes_at[name] = sum((Path(at) / f).stat().st_size for at, _, files in os.walk(folder) for f in files)
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    got = jaccard.link(docs, scratch, 5, 80)
    assert Counter(map(tuple, got.collect())) == Counter((i, n, i % 5000) for i, n in ((r[0], len({tuple(r[1].split()[k : k + 5]) for k in range(146)})) for r in data))
    assert max(bytes_at.values()) < 1.6 * bytes_at["facts"]


def test_the_cells_are_not_shuffled_all_at_once(spark, monkeypatch):
    rng = random.Random(9)
    data = [(i, " ".join(rng.choices("abcdefghijklmnop", k=150))) for i in range(1200)]
    data += [(5000 + i, data[i][1] + " end") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    keep, sent, cells = Scratch.keep, {}, []

    def shuffled():
        found = {}
        for d in folders:
            found |= {p: p.stat().st_size for p in Path(d).glob("*/shuffle_*.data")}
        return found

    def kept(self, df, name, *more):
        before = shuffled()
        out = keep(self, df, name, *more)
        sent[name] = sum(size for p, size in shuffled().items() if p not in before)
        if name == "facts":
            cells.append(8 * out.selectExpr("sum(size(cells))").first()[0])
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard.link(docs, Scratch(spark, "t"), 5, 80).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 5000 for i, _ in data}
    assert 0 < max(sent.values()) < 0.5 * cells[0]


def test_near_copies_are_not_all_compared(spark, monkeypatch):
    """Copies of a text that differ in a word or two: few are linked with any one of them, all are with some."""
    rng = random.Random(10)
    base, docs = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for _ in range(240):
        words = list(base)
        for _ in range(rng.choice((1, 2, 2))):
            words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        docs.append(" ".join(words))
    keep, found = Scratch.keep, {}

    def kept(self, df, name, *more):
        out = keep(self, df, name, *more)
        if name == "pairs1":
            found[name] = out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", kept)
    data = [(i, x) for i, x in enumerate(docs)]
    got = jaccard.link(spark.createDataFrame(data, "doc_id long, text string"), Scratch(spark, "t"), 5, 80)
    assert Counter(map(tuple, got.collect())) == brute(data, 5, 80)
    assert found["pairs1"] < len(docs)


def test_components_extended_by_links(spark):
    rng = random.Random(11)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(240)]
    frames = [spark.createDataFrame(part, "a long, b long") for part in (links[:160], links[160:])]
    scratch = Scratch(spark, "t")
    found = components(frames[0], scratch, "x")
    want = dict(map(tuple, components(frames[0].union(frames[1]), scratch, "y").collect()))
    got = extended(found, frames[1], scratch, "z").collect()
    assert {n: c for n, c in got if n != c} == {n: c for n, c in want.items() if n != c}
    assert len(got) == len({n for n, _ in got})
    assert extended(found, frames[0], scratch, "v") is found
    assert extended(found, frames[0].limit(0), scratch, "w") is found


def test_links_within_components_start_no_rounds(spark, monkeypatch):
    """Every table is some hundred tasks where there are as many partitions: components are found once, then extended."""
    rng = random.Random(12)
    base, docs = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for k in range(120):
        words = list(base)
        words[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        docs.append((k, " ".join(words)))
    keep, names = Scratch.keep, []

    def kept(self, df, name, *more):
        names.append(name)
        return keep(self, df, name, *more)

    monkeypatch.setattr(Scratch, "keep", kept)
    got = jaccard.link(spark.createDataFrame(docs, "doc_id long, text string"), Scratch(spark, "t"), 3, 90)
    assert Counter(map(tuple, got.collect())) == brute(docs, 3, 90)
    assert sum(name.endswith("-nodes0") for name in names) <= 1 + sum(name.endswith("-across") for name in names)
