"""Each stage of the pipeline on all its predecessor kept, against plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from cohortry.llm import QUERIES, quality
from tests.check import compare, connect
from tests.llm.fixtures import SCHEMA, frame
from tests.llm.test_jaccard import brute
from tests.llm.test_native import brute_quality, lower, water

SMALL = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def key(r):
    return tuple(r[c] for c in COLUMNS)


def distance(a, b):
    p, q = ([x / max(sum(v), 1) for x in v] for v in (a, b))
    part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0.0
    return math.sqrt(max(0.0, sum((part(x, y) + part(y, x)) / 2 for x, y in zip(p, q))))


def classes(text):
    out = [0] * 6
    for c in text:
        kind = 5 if ord(c) > 126 or ord(c) < 33 and c not in " \t\n\x0b\f\r" else 4
        kind = 0 if "a" <= c <= "z" else 1 if c in " \t\n\x0b\f\r" else 2 if "A" <= c <= "Z" else 3 if "0" <= c <= "9" else kind
        out[kind] += 1
    return out


def brute_verdicts(docs):
    """``doc_id, text, lang`` and whether the rules and the distances keep it."""
    copies = Counter((r["lang"], r["text"] or "") for r in docs)
    weights, unit = defaultdict(Counter), quality.UNIT
    for r in docs:
        words = WORD.findall(r["text"] or "")
        for w in words:
            weights[r["lang"]][w] += int(unit / (max(len(words), quality.MIN_WORDS) * copies[r["lang"], r["text"] or ""]))
    common = {k: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0].encode()))[: quality.COMMON]] for k, c in weights.items()}
    facts, refs = [], defaultdict(lambda: ([0] * 6, [0] * (quality.COMMON + 1)))
    for r in docs:
        words = WORD.findall(r["text"] or "")
        place = {w: i + 1 for i, w in enumerate(common.get(r["lang"], []))}
        bins = [0] * (quality.COMMON + 1)
        for w in words:
            bins[place.get(w, 0)] += 1
        failed = brute_quality(r["text"] or "")[-1]
        facts.append((r, len(words), (classes(r["text"] or ""), bins), failed))
        if not failed:
            for ref, mine in zip(refs[r["lang"]], facts[-1][2]):
                part = unit / (max(sum(mine), 1) * copies[r["lang"], r["text"] or ""])
                ref[:] = [a + int(b * part) for a, b in zip(ref, mine)]
    pools = [[sum(x) for x in zip(*v)] for v in zip(*refs.values())]
    blend = {k: [[a + b / max(sum(p), 1) * quality.POOLED * unit for a, b in zip(x, p)] for x, p in zip(v, pools)] for k, v in refs.items()}
    for r, n, mine, failed in facts:
        far = n >= quality.GUARD_WORDS and not failed
        far = far and any(distance(a, b) > most for a, b, most in zip(mine, blend[r["lang"]], (quality.MOST_CLASS, quality.MOST_WORD)))
        yield r, not failed and not far


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    steps = [docs.collect()]
    for name, stage in pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(steps[-1], docs.schema), SMALL)
        steps.append(docs.collect())
        if name != "packing":
            assert docs.columns == COLUMNS
    first, good, lines, single, mixed, packed = steps
    assert Counter(map(key, good)) == Counter(key(r) for r, kept in brute_verdicts(first) if kept)
    assert 0 < len(good) < len(first)

    holders = defaultdict(set)
    line_key = lambda x: lower(x.strip(" \t\n\x0b\f\r"))
    for r in good:
        for x in r["text"].split("\n"):
            holders[line_key(x)].add(r["doc_id"])
    want = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if len(line_key(x)) < 10 or min(holders[line_key(x)]) == r["doc_id"]) for r in good}
    assert {r["doc_id"]: r["text"] for r in lines} == want

    groups = {doc: group for doc, _, group in brute([(r["doc_id"], r["text"]) for r in lines], 5, 80)}
    assert {r["doc_id"] for r in single} == {d for d, g in groups.items() if d == g}

    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in single:
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        largest[r["source"]] = max(largest[r["source"]], len(WORD.findall(r["text"])))
    assert {key(r) for r in mixed} <= {key(r) for r in single} and max(Counter(map(key, mixed)).values()) <= 3
    for source, target in water(sizes).items():
        assert abs(taken[source] - target) <= max(largest[source], target * 0.02) + 1, source
    assert sum(r["length"] for r in packed) == sum(r["doc_tokens"] for r in packed if r["start"] == 0)
    assert Counter(r["doc_id"] for r in packed if r["start"] == 0) == Counter(r["doc_id"] for r in mixed)


def test_near_duplicates_by_row(spark):
    """Repeated rows, null ids, and one id with two texts."""
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(5))
    docs = [(1, a), (1, a), (2, a + " end"), (3, b), (3, c), (0, b), (None, d), (None, d), (None, d + " end"), (4, e), (None, e), (5, ""), (5, "")]
    df = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"].removesuffix(" end")) for r in pipeline.near_duplicates(spark, df, SMALL).collect())
    assert got == Counter({(1, a): 1, (0, b): 1, (3, c): 1, (None, d): 1, (4, e): 1, (5, ""): 2})


def test_run_gives_pieces(spark):
    assert pipeline.run(spark, SMALL).where("length < 1 or offset + length > 4096").count() == 0


def test_stages_on_awkward_rows(spark):
    docs = frame(spark).select(*COLUMNS, F.lit("x").alias("text_hash"))
    for frame_, want in ((docs, None), (spark.createDataFrame([], SCHEMA), 0)):
        out = frame_
        for _, stage in pipeline.STAGES:
            out = stage(spark, out, SMALL)
        assert out.count() == want if want is not None else out.count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_registered_queries(spark, name):
    """With its counterpart where there is one; else it gives rows."""
    folder = "/root/testdata/sf0.01" if name in entry.oracle_sql() else SMALL
    ok, note = compare(spark, connect(folder), name, folder)
    assert ok and not note.endswith("empty"), note
