"""Small documents with the awkward cases, and helpers."""

import hashlib
import random

from pyspark.sql import Row, types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("size", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)


def texts(n: int = 120, seed: int = 3) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéßñ", k=rng.randint(2, 6))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(vocabulary, k=rng.randint(1, 25)))
    shared = [line() for _ in range(4)]
    passage = " ".join(rng.choices(vocabulary, k=120))
    out: list[str | None] = [None, "", "\n\n", " \t", "word", "two words", "A  " + shared[0].upper() + "\t", "don't I'LL <|endoftext|> x", "héllo İ ΣΑΣ あい 12ab"]
    while len(out) < n:
        parts = [rng.choice(shared) if rng.random() < 0.3 else line() for _ in range(rng.randint(1, 12))]
        if rng.random() < 0.25:
            parts.insert(rng.randint(0, len(parts)), passage)
        out.append("\n".join(parts))
    for k in range(15):  # copies, and copies with a change at one end
        base = out[20 + k] or ""
        out += [base, base + " " + rng.choice(vocabulary)]
    out.append(" ".join(rng.choices(vocabulary, k=6000)))
    out.append(("abc " * 400).strip())
    out.append("x" * 3000)
    return out


def rows(values=None) -> list[Row]:
    values = texts() if values is None else values
    sources = ["b", "a", None, "B", "ä"]
    out = [(i, t, [None, "en", "de"][i % 3], sources[i % 7 if i % 7 < 5 else 0], None, "size", "hash") for i, t in enumerate(values)]
    return [*out, out[12]] if len(out) > 12 else out  # a repeated row


def frame(spark, values=None):
    return spark.createDataFrame(rows(values), SCHEMA).repartition(5)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
