"""Mixing, line dedup, sharding and quality rules against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cohortry.llm import linededup, mixing, quality, sharding
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import SCHEMA, frame, rows, sha, texts

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SPACE = " \t\n\x0b\f\r"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def water(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in full else weight[s] * level for s in order}
        full |= over


def check_mix(got, docs):
    size = Counter()
    for r in docs:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken, largest = water(size), Counter(), Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert r["size"] == 0 or r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert len(got) == len(docs)
    for s in size:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] / 2 + 1, s  # half of the row at the threshold, or of a repeated one
    return taken


def test_mixing(spark):
    df = frame(spark)
    first = mixing.mix(df, Scratch(spark, "t")).collect()
    check_mix(first, rows())
    again = mixing.mix(df.repartition(3), Scratch(spark, "t")).collect()
    assert Counter(map(tuple, first)) == Counter(map(tuple, again))
    half = {(r["doc_id"], r["source"]): r["taken"] for r in mixing.mix(df, Scratch(spark, "t"), share=0.4).collect()}
    assert all(half[r["doc_id"], r["source"]] <= r["taken"] for r in first)
    assert mixing.mix(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_mixing_fills_the_gap_behind_a_large_document(spark):
    """Where one document is larger than the rest of the source, smaller ones behind it close the gap."""
    sizes = {"a": [2770, 16, 47, 71, 275, 350, 619, 665], "b": [5] * 40, "c": [400] * 30, None: [9000, 1], "d": [0, 0], "e": [700, 3, 2]}
    docs = [(i, " ".join(["w"] * n) + f" {i}" * bool(n), s) for i, (s, n) in enumerate((s, n) for s, v in sizes.items() for n in v)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    for share in (0.3, 1.0):
        got = mixing.mix(df, Scratch(spark, "t"), share, near=mixing.NEAR).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(5), Scratch(spark, "t"), share, near=mixing.NEAR).collect()))
        taken, target, free = Counter(), {}, defaultdict(list)
        for r in got:
            assert r["size"] == 0 or r["taken"] % r["size"] == 0 and 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
            target[r["source"]] = r["target"]
            if r["size"] and r["taken"] // r["size"] == r["target"] // r["source_size"]:
                free[r["source"]].append(r["size"])  # not taken once more
        for s, t in target.items():
            under = t - taken[s]
            assert -under <= max(sizes[s]) / 2 + 1, (s, share)
            assert under <= mixing.NEAR * t + 1 or all(f >= 2 * under for f in free[s]), (s, share)


def test_mixing_narrows_down_to_one_hash(spark, monkeypatch):
    """With few bits a round, several rounds are needed, and the result is the same."""
    whole = Counter(map(tuple, mixing.mix(frame(spark), Scratch(spark, "t")).collect()))
    monkeypatch.setattr(mixing, "BITS", 11)
    few = Counter(map(tuple, mixing.mix(frame(spark), Scratch(spark, "t")).collect()))
    assert whole == few


def brute_lines(docs):
    holders = defaultdict(set)
    key = lambda x: lower(x.strip(SPACE))
    for r in docs:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(r[0])
    out = []
    for r in docs:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) > 1 and min(holders[key(x)]) < r[0])]
        out.append((r[0], len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return Counter(out)


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_line_dedup(spark, batches):
    out = linededup.dedup_lines(frame(spark), Scratch(spark, "t"), batches)
    got = Counter((r["doc_id"], *r["line_dedup"], sha(r["text"])) for r in out.collect())
    assert got == brute_lines(rows()) and out.columns[: len(SCHEMA)] == SCHEMA.names
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run")]


def test_line_dedup_keeps_columns_of_any_name(spark):
    """Names that the operator or its callers use; long text, repeated rows and null ids (one document) among the rows."""
    names = ["doc", "text_hash", "rest", "out", "lines", "__doc", "__text", "__hash", "pos", "a.b"]
    long = "\n".join(f"line number {i} of a long text" for i in range(20_000))
    data = [(1, "the very same line\nown line of one"), (2, "The very same line \nx"), (2, "The very same line \nx"), (None, "shared by nulls"), (None, "shared by nulls"), (3, long), (4, long + "\nnew at the end")]
    df = spark.createDataFrame([(*r, 0, *[f"{n}{i}" for n in names]) for i, r in enumerate(data)], ["doc_id", "text", "line_dedup", *names])
    out = linededup.dedup_lines(df, Scratch(spark, "t"))
    assert out.columns == ["doc_id", "text", *names, "line_dedup"]
    got = sorted((int(r["doc"][3:]), r["doc_id"], r["text"], r["line_dedup"]["n_dropped"], [r[n] for n in names]) for r in out.collect())
    kept = ["the very same line\nown line of one", "x", "x", "shared by nulls", "shared by nulls", long, "new at the end"]
    dropped = [0, 1, 1, 0, 0, 0, 20_000]
    assert got == [(i, data[i][0], kept[i], dropped[i], [f"{n}{i}" for n in names]) for i in range(len(data))]


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_resharding(spark, tmp_path):
    short = [t for t in texts() if len(t or "") < 1500]  # no document is a large part of a shard
    df = frame(spark, short)
    moved = sharding.reshard(df, F.pmod(F.xxhash64("doc_id"), F.lit(5)), 7, Scratch(spark, "t"))
    got = moved.collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows(short))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(7)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    sizes = {s: sum(r["size"] for r in v) for s, v in by.items()}
    mean = sum(sizes.values()) / 7
    assert max(abs(x - mean) for x in sizes.values()) < 0.08 * mean
    old = Counter()
    for r in got:
        old[r["old"]] += r["size"]
    stay = sum(r["size"] for r in got if r["old"] == r["shard"])
    assert stay >= sum(min(old[s], mean) for s in old) - 0.08 * mean  # no fewer bytes could move
    sharding.rewrite(df, moved, f"{tmp_path}/out").collect()
    assert spark.read.parquet(f"{tmp_path}/out").count() == sum(len(v) for v in by.values())
    assert sharding.reshard(spark.createDataFrame([], SCHEMA), F.lit(0), 4, Scratch(spark, "t")).count() == 0


def test_resharding_moves_whole_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LEAST_BLOCKS", 16)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lpad(F.lit(""), 20, "x").alias("text"))
    old = F.pmod("doc_id", F.lit(4))
    got = sharding.reshard(df, old, 5, Scratch(spark, "t")).collect()
    block = F.pmod(F.xxhash64("doc_id", F.crc32(F.encode("text", "UTF-8"))), F.lit(16))
    where, shards = {r[0]: (r[1], r[2]) for r in df.select("doc_id", old, block).collect()}, defaultdict(set)
    for r in got:
        shards[where[r["doc_id"]]].add(r["shard"])
    assert len(got) == 3000 and len(shards) == 64 and all(len(s) == 1 for s in shards.values())
    largest = max(Counter(where[r["doc_id"]] for r in got).values())
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(5)) and max(abs(n - 600) for n in counts.values()) <= 2 * largest  # at most four ends, half a block each
    assert sum(r["old"] != r["shard"] for r in got) <= 600 + 2 * largest


def test_cheapest_flow_moves_the_least():
    assert sum(u for (i, j), u in sharding.cheapest_flow([10, 4, 7], [7, 7, 7], lambda i, j: int(i != j)).items() if i != j) == 3
    costs = [[4, 1, 3], [2, 0, 5], [3, 2, 2]]
    flow = sharding.cheapest_flow([1, 1, 1], [1, 1, 1], lambda i, j: costs[i][j])
    assert sum(costs[i][j] * u for (i, j), u in flow.items()) == 5


def test_common_words_are_found_without_a_search_per_list_entry(spark):
    listed = ["the", "é", "0", "t", "ab c".replace(" ", "\u00a0"), "the,", "😀"]
    texts = ["the the, t 0 e é éé 0 th he the\n😀 😀😀 ab\u00a0c ab", "1 2 ,", ""]
    docs = spark.createDataFrame([(i, t, "=x", i) for i, t in enumerate(texts)], "doc_id long, text string, lang_key string, text_key long")
    common = spark.createDataFrame([("=x", listed)], "lang_key string, common array<string>")
    measured = quality.measure(docs, common)
    for r in measured.collect():
        words = texts[r["doc_id"]].replace("\n", " ").split(" ") if texts[r["doc_id"]] else []
        want = [sum(w not in listed for w in words)] + [words.count(w) for w in listed]
        assert r["bins"] == want + [0] * (quality.COMMON + 1 - len(want))
    assert "array_position" not in measured._jdf.queryExecution().toString()


def brute_quality(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def test_quality_counts(spark):
    out = quality.judge(frame(spark), Scratch(spark, "t")).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert Counter((r["doc_id"], *(r[c] for c in names)) for r in out) == Counter((r[0], *brute_quality(r[1] or "")) for r in rows())
    assert quality.judge(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_quality_rejects_other_writing_and_keeps_clean_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    junk = docs.where("doc_id % 40 = 0").select((F.col("doc_id") + 10**6).alias("doc_id"), F.regexp_replace("text", " ", " %%% ").alias("text"), "lang")
    got = quality.judge(docs.select("doc_id", "text", "lang").union(junk), Scratch(spark, "t")).where("not base_failed and n_words >= 50")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    assert got.where("doc_id >= 1000000").where("kept").count() == 0
    assert got.join(labels.where("quality = 1"), "doc_id").where("not kept").count() == 0


def judged_with(spark, added):
    """The given documents of at least 50 words that pass the simple rules, judged beside ``added`` (text, language, times)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame(added, "text string, lang string, times int")
    more = more.select(F.explode(F.sequence(F.lit(1), "times")).alias("k"), "text", "lang").select((-F.col("k")).cast("long").alias("doc_id"), "text", "lang")
    got = quality.judge(docs.union(more), Scratch(spark, "t")).where("not base_failed and n_words >= 50")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "quality")
    return got.join(labels, "doc_id", "left").collect()


def test_quality_with_one_huge_table(spark):
    rng = random.Random(4)
    n = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select(F.sum(F.size(F.split("text", " ")))).first()[0]
    got = judged_with(spark, [(" ".join(str(rng.randrange(10**6)) for _ in range(n)), "en", 1)])
    assert [r["kept"] for r in got if r["doc_id"] == -1] == [False]
    assert {r["kept"] for r in got if r["quality"] == 1} == {True}


def test_quality_with_one_junk_text_in_a_third_of_the_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    n = docs.where("lang = 'en'").count()
    alone = {r["doc_id"]: r["kept"] for r in judged_with(spark, [("none", "en", 1)])}
    rng = random.Random(5)
    junk = " ".join(f"{rng.choice('#|%<&')}{rng.randrange(10**4)} {rng.choice('|$*')}" for _ in range(121))
    got = judged_with(spark, [(junk, "en", n // 2)])
    assert {r["kept"] for r in got if r["doc_id"] < 0} == {False}
    assert {r["doc_id"]: r["kept"] for r in got if r["doc_id"] >= 0} == alone
