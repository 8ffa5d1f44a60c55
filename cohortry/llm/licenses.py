"""License scans: MinHash bands over overlapping windows of a text retrieve templates, containment verifies them.

A template of L words lies wholly within one of the windows of 2 L words that start every L words.  With three-word
shingles such a window and the template have a Jaccard similarity of 3/8 at least for five words and more for longer
ones, so with 32 bands of one value each a copy collides with a probability of 1 - (5/8)^32, over 0.9999996.

Templates of different licenses can share most of their shingles.  Of two such templates, one is reported for a window
only if the window has its distinguishing shingles, and no smaller share of them than of the other's; and a template
that is a part of another license's is not reported where that one is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.llm import license_texts
from cohortry.llm.scratch import Scratch, documents

SHINGLE = 3
BANDS = 32
LEAST = 0.8  # share of a template's shingles that a match contains
#: Short notices as authors write them.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
}


def words_of(text: Column) -> Column:
    inner = F.regexp_replace(F.lower(text), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, "[^a-z0-9]+"))


def shingles_of(words: str) -> Column:
    """A hash for each run of words, in order."""
    n = F.size(words)
    hashed = F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(SHINGLE)]))
    return F.when(n >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def bands_of(shingles: Column) -> Column:
    """The least value of the shingles under each of the permutations."""
    seeds = F.array(*[F.lit(k) for k in range(BANDS)])
    return F.transform(seeds, lambda k: F.xxhash64(k, F.array_min(F.transform(shingles, lambda h: F.xxhash64(k, h)))))


def template_table(spark: SparkSession, templates: list[tuple[str, str, str]], least: float) -> DataFrame:
    """``template, license, n_words, in_template, rivals``.  ``rivals`` holds, for each template of another license that
    contains ``least`` of this one's shingles, its name, what only this one has and what only the other has."""
    df = spark.createDataFrame(templates, "template string, license string, body string").withColumn("words", words_of(F.col("body")))
    df = df.withColumn("in_template", F.array_distinct(shingles_of("words"))).select("template", "license", F.size("words").alias("n_words"), "in_template")
    rows = [r for r in df.collect() if r["in_template"]]
    sets = {r["template"]: set(r["in_template"]) for r in rows}
    out = []
    for r in rows:
        mine = sets[r["template"]]
        others = [(o["template"], sets[o["template"]]) for o in rows if o["license"] != r["license"]]
        rivals = [(name, sorted(mine - other), sorted(other - mine)) for name, other in others if len(mine & other) >= least * len(mine)]
        out.append((*r, rivals))
    schema = "template string, license string, n_words int, in_template array<bigint>, rivals array<struct<rival: string, mine: array<bigint>, theirs: array<bigint>>>"
    return spark.createDataFrame(out, schema)


def told_apart(shingles: str = "shingles") -> Column:
    """Whether the window is no rival's rather than this template's."""
    share = lambda x: F.size(F.array_intersect(x, F.col(shingles))) / F.greatest(F.size(x), F.lit(1))
    own = lambda r: (share(r["mine"]) > 0) & (share(r["mine"]) >= share(r["theirs"]))
    return F.forall("rivals", lambda r: F.when(F.size(r["mine"]) == 0, share(r["theirs"]) < 0.5).otherwise(own(r)))


def scan(docs: DataFrame, scratch: Scratch, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The notices of each text: ``doc_id, license, containment, n_windows, first_word``.

    ``templates`` are texts by license; without them, the short notices and the texts and headers of ``license_texts``.
    ``containment`` is the largest share of a template's shingles in one window, ``n_windows`` the number of windows
    that contain at least ``least`` of them, ``first_word`` where the first of these starts.

    Notices of five or six words have three or four shingles, so a copy with one word changed is not found.  A notice
    whose version or name is changed is of no license.

    Null and empty texts and texts of fewer than three words have no notices; repeated rows count as one document;
    rows with a null id count as one document for each text; other columns are not read.  Templates of fewer than three
    words are left out.  Only built-in functions are used.
    """
    spark = scratch.spark
    given = [(k, k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    table = scratch.keep(template_table(spark, given + (license_texts.texts() if templates is None else []), least), "templates")
    # The templates are a parameter and stay small: a row for each, and a row for each template and band.
    bands = F.broadcast(table.select("template", "n_words", F.explode(bands_of(F.col("in_template"))).alias("band")))
    known = table.select(F.explode("in_template").alias("h")).agg(F.collect_set("h").alias("known"))
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Rows without an id are told apart by their text.
    df = df.withColumn("text_key", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.lit(0))).withColumn("words", words_of(F.col("text")))
    # Through the generator, so that the filters below are not pushed into the shingles' expression and computed per word.
    df = df.select("doc_id", "text_key", F.explode(F.array(shingles_of("words"))).alias("shingles"))
    df = df.withColumn("known", known.scalar()).select("doc_id", "text_key", "shingles", F.explode(F.array(F.array_intersect("shingles", "known"))).alias("hits")).where(F.size("hits") > 0)
    # A text that lacks more of a template's shingles than a window may has no window with enough of them.
    small = F.broadcast(table.select("n_words", "in_template"))
    enough = (F.size("hits") >= least * F.size("in_template")) & (F.size(F.array_intersect("in_template", "hits")) >= least * F.size("in_template"))
    df = scratch.keep(df.join(small, enough).select("doc_id", "text_key", "n_words", "shingles").distinct(), "texts")
    at = ["doc_id", "text_key", "n_words"]
    starts = F.sequence(F.lit(0), F.size("shingles") - 1, F.col("n_words"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("first_word"), F.slice("shingles", s + 1, 2 * F.col("n_words") - SHINGLE + 1).alias("shingles")))
    windows = df.select(*at, F.explode(cut).alias("w")).select(*at, "w.first_word", "w.shingles")
    windows = scratch.keep(windows.withColumn("bands", bands_of(F.col("shingles"))), "windows")
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("doc_id", "text_key")]
    met = windows.select(*at, "first_word", "shingles", F.explode("bands").alias("band")).join(bands, ["n_words", "band"])
    met = met.select(*at, "first_word", "shingles", "template").distinct()
    both = met.join(F.broadcast(table.drop("n_words")), "template")
    share = F.size(F.array_intersect("in_template", "shingles")) / F.size("in_template")
    sure = both.withColumn("containment", share).where((F.col("containment") >= least) & told_apart())
    sure = scratch.keep(sure.select(*at, "first_word", "template", "license", "containment", F.transform("rivals", lambda r: r["rival"]).alias("rivals")), "sure")
    x, y = sure.alias("x"), sure.alias("y")
    apart = (F.col("x.first_word") >= F.col("y.first_word") + 2 * F.col("y.n_words")) | (F.col("y.first_word") >= F.col("x.first_word") + 2 * F.col("x.n_words"))
    part_of = F.array_contains("x.rivals", F.col("y.template")) & (F.col("x.n_words") < F.col("y.n_words"))
    sure = x.join(y, [*same, part_of, ~apart], "left_anti")
    return sure.groupBy("doc_id", "text_key", "license").agg(F.max("containment").alias("containment"), F.count("*").alias("n_windows"), F.min("first_word").alias("first_word")).drop("text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license notices of all documents."""
    return scan(documents(spark, sf_dir), Scratch(spark, "licenses"))


QUERIES = {"op9_license_scan": query}
