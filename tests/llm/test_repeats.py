"""The query on repeated strings of 400 bytes, and phrases that recur within a text."""

import hashlib
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cohortry.llm import repeats
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import frame, rows
from tests.llm.test_repeats_topk_licenses import brute_repeats


def test_equal_phrases_in_a_row_are_one(monkeypatch):
    """Periodic text gives a row or two at each end, not one for each period; all strings stay covered in order."""
    for piece in (1 << 18, 700):
        monkeypatch.setattr(repeats, "PIECE", piece)
        text = b"left " * 30 + b"ninebytes" * 600 + b"q" * 900 + bytes(random.Random(2).choices(b"abcd", k=900))
        gram, phrase, first, last, n = repeats.phrases(text, 400, 200)
        assert first[0] == 0 and last[-1] == len(text) - 400 and (first[1:] == last[:-1] + 1).all()
        assert n.max() > 50 and n.sum() > 10 * len(n)
        assert ((last - first + 1) % n == 0).all()
        assert not ((gram[1:] == gram[:-1]) & (phrase[1:] == phrase[:-1])).any()


def test_periodic_texts_do_not_fill_the_table_of_phrases(spark):
    docs = spark.createDataFrame([(i, i, "ninebytes" * 600) for i in range(20)], "doc long, text_hash long, text string")
    assert repeats.parse(docs, 400, 200).select(F.explode("gram")).count() <= 60


def test_periodic_texts_like_counting_all_strings(spark, monkeypatch):
    """Periods at other places, of other lengths, once or twice, within one text or several."""
    rng = random.Random(4)
    filler = lambda n: "".join(rng.choices("efgh", k=n))
    values = [filler(rng.randrange(30)) + ("abc de fg" * 40)[: rng.randint(30, 200)] + filler(rng.randrange(60)) for _ in range(30)]
    values += ["é" * rng.randint(15, 60) for _ in range(5)]
    values += ["once upon" * 12, filler(50) + "z" * 90, "y" * 41, "pq" * 20]
    for piece in (1 << 18, 64):
        monkeypatch.setattr(repeats, "PIECE", piece)
        out = repeats.remove_repeats(frame(spark, values), Scratch(spark, "t"), 40, 20).collect()
        got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in out)
        docs = rows(values)
        want = brute_repeats([r[1].encode() for r in docs], 40)
        assert got == Counter((r[0], *w) for r, w in zip(docs, want))


def test_query_on_planted_passages(spark, tmp_path):
    """Passages of over 50 words go where they have 400 bytes and stand twice; shorter ones and other text stay."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 8))) for _ in range(4000)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    long, short = [text(120) for _ in range(5)], [" ".join(rng.choices([w for w in words if len(w) < 4], k=55)) for _ in range(5)]
    assert all(len(p.split()) > 50 and len(p.encode()) < 400 for p in short)
    with_long = [f"{text(40)} {p} {text(40)}" for p in long for _ in range(3)]
    with_short = [f"{text(40)}\x01{p}\x02{text(40)}" for p in short]
    with_short += [f"{text(40)}\x03{p}\x04{text(40)}" for p in short]
    other = [text(200) for _ in range(15)]
    values = [*with_long, *with_short, *other, "ninebytes" * 300, None]
    spark.createDataFrame([(i, t) for i, t in enumerate(values)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in repeats.query(spark, str(tmp_path)).collect()}
    want = brute_repeats([(t or "").encode() for t in values], 400)
    assert got == dict(enumerate(want))
    removed = np.array([got[i][1] for i in range(len(values))])
    assert (removed[:15] >= 400).all() and not removed[15:40].any() and removed[40] == 2700


def test_query_on_given_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")))
    values = [(r[0], r[1].encode()) for r in docs.collect()]
    got = Counter(tuple(r) for r in repeats.query(spark, small).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(values, brute_repeats([v for _, v in values], 400)))
    assert any(r[2] for r in got)
