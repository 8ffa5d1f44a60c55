"""Prefix counts and packing against the tokenizer library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cohortry.llm import packing, tokens
from cohortry.llm.scratch import Scratch
from tests.llm.fixtures import SCHEMA, frame, rows, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


ODD = ["a\x1cb \xa0x", "'recall  ''s", "<|endoftext| '", "don't", "I'Ll", "é́é é", "ΑΣ ΑΣΑ", "กัข", "12a3", "x" * 300, "!" * 200, "ǅ ﬁ ²³½ ª", "﻿ a"]


def test_every_prefix_like_the_library(library):
    coder = tokens.PrefixCoder(PATH)
    rng = random.Random(2)
    for text in [*ODD, *rng.sample([t for t in texts() if t], 12)]:
        text = text[:300]
        counts = np.cumsum(coder.text_steps(text.encode()), dtype=int)
        assert len(counts) == len(text)
        for k in range(1, len(text) + 1):
            assert counts[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids), text[:k]
        assert np.frombuffer(coder.text_ids(text.encode()), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_full_caches_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    coder = tokens.PrefixCoder(PATH)
    for text in texts()[5:40]:
        assert len(coder.text_ids(text.encode())) // 4 == coder.text_steps(text.encode()).sum(dtype=int) == len(library.encode(text, add_special_tokens=False).ids)


def test_a_piece_is_encoded_once(library, monkeypatch):
    coder = tokens.PrefixCoder(PATH)
    asked, table = [], coder.table
    monkeypatch.setattr(coder, "table", lambda word: asked.append(word) or table(word))
    text = "hello Hello, (hello) hello.\nhello\n\thello's été,été hello\nhello.\n"
    steps = coder.text_steps(text.encode())
    assert np.cumsum(steps, dtype=int)[-1] == len(library.encode(text, add_special_tokens=False).ids) and len(steps) == len(text)
    assert asked.count("hello") == 1 and asked.count(coder.shown("été")) == 1


def test_prefix_table_answers_questions(spark, library):
    out = tokens.prefix_counts(frame(spark), PATH, 50).collect()
    assert len(out) == len(rows())
    text = {r[0]: r[1] or "" for r in rows()}
    for r in out:
        whole = text[r["doc_id"]]
        steps = np.frombuffer(r["prefix_steps"], np.dtype(f"i{r['step_bytes']}"))
        assert (r["n_bytes"], r["n_tokens"]) == (len(whole.encode()), len(library.encode(whole, add_special_tokens=False).ids))
        assert r["fit_chars"] == tokens.longest_within(steps, 50)
        assert tokens.count_at(steps, r["fit_chars"]) <= 50
        assert r["fit_chars"] == len(whole) or len(library.encode(whole[: r["fit_chars"] + 1], add_special_tokens=False).ids) > 50
    assert tokens.prefix_counts(spark.createDataFrame([], SCHEMA), PATH, 9).count() == 0


@pytest.mark.parametrize("length", [256, 4096])
def test_packing(spark, library, length):
    out = packing.pack(frame(spark), Scratch(spark, "t"), PATH, length, ids=True).collect()
    want = Counter((r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for r in rows())
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in out:
        assert (len(r["ids"]), zlib.crc32(r["ids"])) == (4 * r["length"], r["ids_crc32"])
        docs[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc, pieces in docs.items():
        copies = sum(n for (d, _), n in want.items() if d == doc)
        ids = next(x for d, x in want if d == doc)
        pieces.sort(key=lambda r: r["start"])
        assert b"".join(r["ids"] for r in pieces[::copies]) == ids and all(r["doc_tokens"] == len(ids) // 4 for r in pieces)
        assert [r["start"] for r in pieces[::copies]] == list(np.cumsum([0, *(r["length"] for r in pieces[::copies])])[:-1])
    total = 0
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
        total += at
    assert len(seqs) * length < 1.12 * total + length
    assert packing.pack(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"), PATH).count() == 0


def test_chunk_ids_are_the_library_s(library):
    """Every entry of the vocabulary as a text, random words, long runs, special strings and other scripts."""
    rng = random.Random(9)
    letters = {c: b for b, c in enumerate(tokens.byte_letters())}
    raw = [bytes(letters[c] for c in t.removesuffix(tokens.END)) for t in library.get_vocab() if not t.startswith("<|")]
    words = [r.decode() for r in raw if not r.decode(errors="replace").count("\ufffd")]
    words += ["".join(rng.choices("abcdeghilmnorstuvé'ßİǅ09.,-!<|あ", k=rng.randint(1, 40))) for _ in range(5_000)]
    words += ["x" * 5_000, "<|endoftext|>", "a<|startoftext|>b", "don't", "I'LL", "É́"]
    coder = packing.ChunkCoder(PATH)
    many = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    for text, coded in zip(many, coder.encode([t.encode() for t in many])):
        assert np.frombuffer(coded, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_patterns_beside_spark(spark):
    """All classes of lengths, in a driver that has run a Spark job."""
    assert spark.range(1000).selectExpr("sum(id)").first()[0] == 499500
    counts = {w: 20_000 // w + 1 for w in range(1, 257)}
    placed = Counter()
    for uses, pattern in packing.patterns(counts, 256):
        for w, n in pattern.items():
            placed[w] += uses * n
    assert placed == counts
    rng = np.random.default_rng(2)
    m = rng.random((257, 257))
    assert np.abs(packing.times(packing.inverted(m), m @ np.arange(257.0)) - np.arange(257)).max() < 1e-6


def test_patterns_hold_every_piece_and_are_near_the_bound():
    rng = random.Random(4)
    counts = Counter(min(256, int(rng.paretovariate(1.1) * 20)) for _ in range(30_000))
    plan = packing.patterns(dict(counts), 256)
    placed = Counter()
    for uses, pattern in plan:
        assert sum(w * n for w, n in pattern.items()) <= 256
        for w, n in pattern.items():
            placed[w] += uses * n
    assert placed == counts
    whole = sum(w * n for w, n in counts.items()) / 256
    assert sum(uses for uses, _ in plan) <= 1.01 * whole + 30
