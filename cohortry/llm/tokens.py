"""Token counts at every prefix, and token ids, for a word-piece vocabulary with word ends.

A prefix dynamic program gives the encoding of every prefix of a word: the last token of a prefix is the one
vocabulary entry that ends there and forms a stable pair with the last token of what stands before it.  From the
last tokens follow the number of tokens of every prefix and, backwards, the ids of the whole word.  Words of a text
are independent of each other, so the counts at every prefix of a text are the words' own counts, one after another.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from cohortry.llm.scratch import documents

END = "</w>"
WORDS_AND_GAPS = re.compile(rb"[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
#: Characters that are in normal form, have a lower case of one character and belong to known classes.
PLAIN = re.compile("[!-~¡«»¿À-ÖØ-öø-įı-ɏ]+")
LETTERS = "a-zÀ-ÖØ-öø-įı-ɏ"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^0-9{LETTERS}]+")
#: Entries per cache and worker; a full cache starts anew, which changes the speed only.
CACHE = 600_000
LONGEST_CACHED = 40
SIGNED = 127


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else free))
        free += b not in shown
    return out


class PrefixCoder:
    """Exact encodings of the words of one vocabulary file, by their prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["model"]["vocab"]
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(END)}
        self.final = {t.removesuffix(END): i for t, i in vocab.items() if t.endswith(END)}
        self.longest = max(map(len, vocab))
        # Of each token: the rank of the merge that makes it (-1: a single character), and that merge's two sides.
        self.made, self.sides, self.ranks = [-1] * (max(vocab.values()) + 1), {}, {}
        for rank, m in enumerate(model["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            whole = vocab[left + right]
            self.made[whole], self.sides[whole] = rank, (vocab[left], vocab[right])
            self.ranks[vocab[left], vocab[right]] = rank
        self.bytes = {i: len(t.removesuffix(END)) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.special_rx = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.letters = byte_letters()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[str, tuple[int, int, int, int]] = {}
        self.steps = Cache(self.chunk_steps)
        self.plain = Cache(self.piece_steps)
        self.ids = Cache(self.chunk_ids)

    # -- one word -----------------------------------------------------------------------------------------------
    def stable(self, left: int, right: int) -> bool:
        """Whether the two tokens, written side by side, are encoded as just these two.

        Merges run by rank, leftmost first.  Undo the merges inside the two tokens from the last one on: at each
        moment the neighbours at the border must not merge before the side that was undone last came about.
        """
        key, limit = (left, right), 1 << 60
        known = self.pairs.get(key)
        if known is None:
            made, sides, ranks, tie = self.made, self.sides, self.ranks, 0
            while True:
                if ranks.get((left, right), 1 << 60) < limit + tie:
                    known = False
                    break
                if made[left] > made[right]:
                    limit, tie, left = made[left], 0, sides[left][1]
                elif made[right] >= 0:
                    limit, tie, right = made[right], 1, sides[right][0]
                else:
                    known = True
                    break
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def table(self, word: str) -> list[tuple[int, int, int, int]]:
        """For each prefix: last token and number of tokens where more follows; the same where the word ends there."""
        known, inner, final, stable = self.prefixes, self.inner, self.final, self.stable
        rows = [(-1, 0, -1, 0)]
        for k in range(1, len(word) + 1):
            row = known.get(word[:k]) if k <= LONGEST_CACHED else None
            if row is None:
                last = end = -1
                n = ended = 0
                for i in range(max(0, k - self.longest), k):
                    part, (before, m, _, _) = word[i:k], rows[i]
                    if not n and (token := inner.get(part, -1)) >= 0 and (before < 0 or stable(before, token)):
                        last, n = token, m + 1
                    if not ended and (token := final.get(part, -1)) >= 0 and (before < 0 or stable(before, token)):
                        end, ended = token, m + 1
                    if n and ended:
                        break
                row = (last, n, end, ended)
                if k <= LONGEST_CACHED:
                    if len(known) >= 2 * CACHE:
                        known.clear()
                    known[word[:k]] = row
            rows.append(row)
        return rows

    def word_ids(self, word: str) -> list[int]:
        rows, k = self.table(word), len(word)
        out = [rows[k][2]]
        k -= self.bytes[out[0]]
        while k:
            out.append(rows[k][0])
            k -= self.bytes[out[-1]]
        return out[::-1]

    # -- one run of characters between spaces ----------------------------------------------------------------
    def pieces(self, chunk: str) -> list[str]:
        """The pieces that the library splits a run into, each as its bytes' stand-ins."""
        if PLAIN.fullmatch(chunk):
            return [p if p.isascii() else self.shown(p) for p in PIECES.findall(chunk.lower())]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(chunk))]

    def shown(self, piece: str) -> str:
        return "".join([self.letters[b] for b in piece.encode()])

    def chunk_ids(self, raw: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        chunk, out, at = raw.decode(), [], 0
        for m in self.special_rx.finditer(chunk) if "<|" in chunk else ():
            for piece in self.pieces(chunk[at : m.start()]):
                out += self.word_ids(piece)
            out.append(self.special[m[0]])
            at = m.end()
        for piece in self.pieces(chunk[at:]):
            out += self.word_ids(piece)
        return np.array(out, "<u4").tobytes()

    def counts(self, chunk: str) -> list[int]:
        """Token counts at every prefix of a run, from one character on."""
        if not PLAIN.fullmatch(chunk) or "<|" in chunk:
            # Composed characters, other scripts, special strings: a prefix need not begin like the whole, so each
            # prefix is encoded.  The cost is the square of the length of the run, not of the text.
            return [len(self.chunk_ids(chunk[:k].encode())) // 4 for k in range(1, len(chunk) + 1)]
        out, before = [], 0
        for piece in PIECES.findall(chunk.lower()):
            out += [before + n for n in self.piece_counts(piece)]
            before = out[-1]
        return out

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts at every prefix of a plain piece, from one character on."""
        if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
            return [sum(self.table(p)[-1][3] for p in PIECES.findall(piece[:k])) for k in range(1, len(piece) + 1)]
        if piece.isascii():
            return [row[3] for row in self.table(piece)[1:]]
        rows, at, out = self.table(self.shown(piece)), 0, []
        for c in piece:
            at += len(c.encode())
            out.append(rows[at][3])
        return out

    def piece_steps(self, piece: str) -> bytes:
        return self.signed(self.piece_counts(piece))

    def chunk_steps(self, raw: bytes) -> bytes:
        """The change of the count at each character, as signed bytes (see ``text_steps`` for changes that do not fit).

        Texts are cut at spaces; a run that holds other white space is put together from its own runs.
        """
        parts = WORDS_AND_GAPS.findall(raw)
        if len(parts) != 1:
            return b"".join([bytes(len(p)) if p.isspace() else self.steps[p] for p in parts])
        chunk = raw.decode()
        if raw.isspace():
            return bytes(len(raw))
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.plain.__getitem__, PIECES.findall(chunk.lower())))
        return self.signed(self.counts(chunk))

    def signed(self, counts: list[int]) -> bytes:
        """The changes of the counts as signed bytes."""
        steps = [n - m for m, n in zip([0, *counts], counts)]
        if len(steps) > SIGNED and max(map(abs, steps)) > SIGNED:
            raise OverflowError
        return bytes([n & 255 for n in steps])

    # -- one text -----------------------------------------------------------------------------------------------
    def text_steps(self, text: bytes) -> np.ndarray:
        """Changes of the token count at each character of a text; their running sum is the count at every prefix."""
        try:
            return np.frombuffer(b"\0".join(map(self.steps.__getitem__, text.split(b" "))), np.int8)
        except OverflowError:
            parts = [np.zeros(len(c), int) if c.isspace() else np.diff(self.counts(c.decode()), prepend=0) for c in WORDS_AND_GAPS.findall(text)]
            return np.concatenate(parts)

    def text_ids(self, text: bytes) -> bytes:
        return b"".join(map(self.ids.__getitem__, text.split()))


class Cache(dict):
    """Values made on demand; when full it starts anew.  Very long keys are not kept."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: bytes) -> bytes:
        value = self.make(key)
        if len(key) <= LONGEST_CACHED:
            if len(self) >= CACHE:
                self.clear()
            self[key] = value
        return value


CODERS: dict[str, PrefixCoder] = {}


def coder(path: str) -> PrefixCoder:
    """One coder per worker and vocabulary file."""
    if path not in CODERS:
        CODERS[path] = PrefixCoder(path)
    return CODERS[path]


def count_at(steps: np.ndarray, characters: int) -> int:
    """Tokens of the first ``characters`` characters."""
    return int(steps[:characters].sum(dtype=np.int64))


def longest_within(steps: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    fits = np.flatnonzero(np.cumsum(steps, dtype=np.int64) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def utf8(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def prefix_counts(docs: DataFrame, vocabulary: str, budget: int, tables: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token counts of every prefix of every text.

    Returns per row: ``doc_id, n_bytes, n_tokens, fit_chars`` (characters of the longest prefix within ``budget``)
    and, with ``tables``, ``prefix_steps``: the change of the count at each character as little-endian signed
    numbers of ``step_bytes`` bytes, for ``count_at`` and ``longest_within``.

    Null and empty texts have no bytes, tokens or steps.  Special strings inside a text are single tokens, as the
    library has it.  Repeated rows are answered each; null ids stay null; other columns are not read.
    """
    schema = "doc_id long, n_bytes long, n_tokens long, fit_chars long" + ", prefix_steps binary, step_bytes int" * tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = coder(vocabulary)
        for batch in batches:
            out: list[tuple] = []
            for text in utf8(batch.column(1)):
                steps = mine.text_steps(text)
                n = int(steps.sum(dtype=np.int64))
                row = (len(text), n, longest_within(steps, budget) if n > budget else len(steps))
                out.append(row + (steps.tobytes(), steps.itemsize) if tables else row)
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * (5 if tables else 3), KINDS))]
            yield pa.RecordBatch.from_arrays(columns, schema_names(tables))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]


def schema_names(tables: bool) -> list[str]:
    return ["doc_id", "n_bytes", "n_tokens", "fit_chars", *(["prefix_steps", "step_bytes"] * tables)]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document against a limit of 2,048 tokens, read off the counts at its prefixes."""
    counted = prefix_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), LIMIT, tables=False)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fit_chars")


LIMIT = 2048
QUERIES = {"op1_token_counts": query}
