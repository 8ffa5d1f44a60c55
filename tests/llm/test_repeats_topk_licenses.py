"""Repeated strings, exact search and license scans against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortry.llm import license_texts, licenses, repeats, topk
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import SCHEMA, frame, rows, texts


def brute_repeats(values, length):
    count = Counter(v[i : i + length] for v in values for i in range(len(v) - length + 1))
    out = []
    for v in values:
        gone = [False] * len(v)
        for i in range(len(v) - length + 1):
            if count[v[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(v), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(v, gone) if not g)).hexdigest()))
    return out


def overlapping(seed=8):
    """Texts made of a few long passages, cut and joined at random places, and periodic ones."""
    rng = random.Random(seed)
    long = ["".join(rng.choices("abcd é", k=500)) for _ in range(3)]
    out = ["ab" * 300, "xyz" * 100 + "ab" * 70, "q" * 90, "q" * 60]
    for _ in range(40):
        parts = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice(long)
            at = rng.randrange(400)
            parts += [p[at : at + rng.randint(20, 200)], "".join(rng.choices("efgh", k=rng.randint(0, 40)))]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("length", "gram", "piece"), [(40, 20, 1 << 18), (40, 12, 64), (90, 45, 1 << 18)])
def test_repeats_like_counting_all_strings(spark, monkeypatch, length, gram, piece):
    monkeypatch.setattr(repeats, "PIECE", piece)
    values = [*texts(60), *overlapping()]
    out = repeats.remove_repeats(frame(spark, values), Scratch(spark, "t"), length, gram)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out.collect())
    docs = rows(values)
    want = brute_repeats([(r[1] or "").encode() for r in docs], length)
    assert got == Counter((r[0], *w) for r, w in zip(docs, want))


def test_no_repeats(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    out = repeats.remove_repeats(frame(spark, [None, "short"]), Scratch(spark, "t")).sort("doc_id").collect()
    assert [bytes(r["kept"]) for r in out] == [b"", b"short"]


def brute_top(vectors, every, k):
    ids = {i: [int(256 * x // 1) for x in v] for i, v in vectors}
    out = set()
    for q in ids:
        if q % every == 0:
            dot = lambda v: sum(a * b for a, b in zip(ids[q], v))
            best = sorted(((-dot(v), i) for i, v in ids.items() if i != q))[:k]
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("large", [1.0, 1e6])
def test_search(spark, monkeypatch, large):
    monkeypatch.setattr(topk, "SHARDS", 3)
    rng = random.Random(6)
    vectors = [(i, [rng.gauss(0, 1) * large for _ in range(12)]) for i in range(400)]
    vectors += [(400 + i, list(vectors[i % 5][1])) for i in range(200)]  # copies: ties
    bad = [(600, None), (650, [1.0, None]), (700, [float("nan")] * 12), (750, [float("inf")] * 12), (None, [1.0] * 12)]
    df = spark.createDataFrame([*vectors, *bad, vectors[0]], "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {tuple(r) for r in topk.top_k(df, Scratch(spark, "t"), 5, 50).collect()}
    assert got == brute_top(vectors, 50, 5)


def test_search_in_a_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (7, [2.0]), (9, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, Scratch(spark, "t")).collect())) == [(0, 1, 7, 131072), (0, 2, 9, 0)]
    assert topk.top_k(df.limit(0), Scratch(spark, "t")).count() == 0


def test_licenses(spark):
    rng = random.Random(1)
    filler = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    values: list = [None, "", "two words"]
    want = set()
    for name, text in licenses.TEMPLATES.items():
        for shown in (text, text.upper(), text.replace(" ", "\n")):
            want.add((len(values), name))
            values.append(f"{filler(rng.randint(0, 70))} {shown} {filler(rng.randint(0, 70))}")
    values += [filler(50), "this work is licensed under nothing at all", "under the terms of the house"]
    out = licenses.scan(frame(spark, values), Scratch(spark, "t"))
    got = {(r["doc_id"], r["license"]) for r in out.where("containment = 1").collect()}
    assert got == want
    assert licenses.scan(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_licenses_of_the_given_documents(spark, small):
    """Every notice that a plain search for the line finds is found, and no other."""
    docs = spark.read.parquet(f"{small}/documents.parquet".replace("sf0.001", "sf0.01"))
    got = licenses.scan(docs, Scratch(spark, "t"))
    for name in ("MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0"):
        plain = docs.where(F.col("text").contains(licenses.TEMPLATES[name])).select("doc_id").distinct()
        found = got.where(F.col("license") == name).select("doc_id")
        assert plain.count() and {r[0] for r in plain.collect()} == {r[0] for r in found.collect()}


def found(spark, values, ids=None):
    docs = spark.createDataFrame([(i if ids is None else ids[i], v) for i, v in enumerate(values)], "doc_id long, text string")
    return Counter((r["doc_id"], r["license"]) for r in licenses.scan(docs, Scratch(spark, "t")).collect())


def test_each_short_notice_is_of_one_license(spark):
    """All returned rows, also those with a containment below 1."""
    names = list(licenses.TEMPLATES)
    values = [f"some words before it {licenses.TEMPLATES[n]} and some words after" for n in names]
    values.append(f"{licenses.TEMPLATES['GPL-3.0']} {licenses.TEMPLATES['GPL-2.0']}")
    values.append("Released under the old MIT License.")  # altered and short: not found
    values.append(licenses.TEMPLATES["GPL-2.0"].replace("This work", "The work"))
    n = len(names)
    assert found(spark, values) == Counter([*enumerate(names), (n, "GPL-3.0"), (n, "GPL-2.0"), (n + 2, "GPL-2.0")])


def test_license_texts_and_headers(spark):
    texts = license_texts.texts()
    values = [f"{'lorem ipsum dolor ' * 40} {text} {'sit amet ' * 30}" for _, _, text in texts]
    got = found(spark, values)
    assert [x for i, (name, own, _) in enumerate(texts) if name != "MIT grant" for x in [(name, sorted(k for d, k in got if d == i))] if x[1] != [own]] == []


def test_altered_header_and_rows_without_an_id(spark):
    header = license_texts.gnu("", "3").replace("This program", "Frobnicator").replace("this program", "Frobnicator")
    mit = license_texts.MIT.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "Jane Doe")
    values = [header, mit, licenses.TEMPLATES["MIT"], licenses.TEMPLATES["MIT"], licenses.TEMPLATES["CC0-1.0"]]
    got = found(spark, values, [0, 1, None, None, None])
    assert got == Counter([(0, "GPL-3.0"), (1, "MIT"), (None, "MIT"), (None, "CC0-1.0")])
