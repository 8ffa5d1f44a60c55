"""Quality rules: simple counts of words, symbols, repeated lines and passages, and the distance of a document's
character classes and common words from its language's own (Jensen-Shannon distance).

The references come from the corpus: the most frequent words of each language and, over all documents that pass the
simple rules, the language's shares of character classes and of those words.  Shares are averaged over the distinct
texts, so that neither a long document nor one with many copies weighs more than another.  To each language's average
come a few texts' worth of the average of all languages, which stands in where a language has few texts of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortry.llm.scratch import Scratch, documents

SPACE = " \t\n\x0b\f\r"
SPACES = r"[ \t-\r]+"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED = 20  # percent of the words
#: Character classes in the order in which they are taken out of the text; what remains is the last class.
CLASSES = ("[a-z]+", SPACES, "[A-Z]+", "[0-9]+", r"[!-/:-@\[-`{-~]+")
COMMON = 32
LETTERS = [chr(48 + k) for k in range(COMMON + 1)]
GUARD_WORDS = 50  # shorter documents are not held against the references
POOLED = 20  # texts' worth of the average of all languages in each language's reference
MOST_CLASS = 0.29
MOST_WORD = 0.45
UNIT = 10**10  # weight of a text; whole numbers add up alike in any order


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACES))


def copied_texts(docs: DataFrame) -> DataFrame:
    """``lang_key, text_key, copies``: the texts that several rows of a language have."""
    return docs.groupBy("lang_key", "text_key").agg(F.count("*").alias("copies")).where("copies > 1")


def common_words(docs: DataFrame, copied: DataFrame) -> DataFrame:
    """``lang_key, common``: the words of each language with the largest average share of a distinct text, largest first,
    ties by word; a text of fewer than ``MIN_WORDS`` words counts less.
    """
    df = docs.withColumn("words", words_of(F.col("text"))).join(copied, ["lang_key", "text_key"], "left")
    weight = F.lit(UNIT) / (F.greatest(F.size("words"), F.lit(MIN_WORDS)) * F.coalesce("copies", F.lit(1)))
    words = df.select("lang_key", weight.cast("long").alias("weight"), F.explode("words").alias("word"))
    best = Window.partitionBy("lang_key").orderBy(F.desc("n"), "word")
    top = words.groupBy("lang_key", "word").agg(F.sum("weight").alias("n")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= COMMON)
    ranked = F.sort_array(F.collect_list(F.struct("rank", "word")))
    return top.groupBy("lang_key").agg(F.transform(ranked, lambda x: x["word"]).alias("common"))


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: words within a window of five words that occurs twice or more in ``words``."""
    n = F.size("words")
    at = lambda i: [F.get(F.col("words"), i + k) for k in range(WINDOW)]
    hashed = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*at(i)))
    df = df.withColumn("windows", F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")))
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    df = df.withColumn("ordered", F.when(repeats, pairs))
    same = lambda k, x: F.coalesce(F.get(F.col("ordered"), k)["h"] == x["h"], F.lit(False))
    again = F.filter("ordered", lambda x, k: same(k - 1, x) | same(k + 1, x))
    starts = F.sort_array(F.transform(again, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "ordered")


def class_counts(text: Column) -> Column:
    """Characters of each class.  Each class is taken out of what the classes before it left."""
    counts, left = [], text
    for pattern in CLASSES:
        rest = F.regexp_replace(left, pattern, "")
        counts.append(F.char_length(left) - F.char_length(rest))
        left = rest
    return F.array(*counts, F.char_length(left))


def distance(counts: str, reference: str) -> Column:
    """Jensen-Shannon distance (0 to 1) of two histograms of counts with equal bins."""

    def shares(name: str) -> Column:
        total = F.aggregate(name, F.lit(0.0), lambda a, x: a + x)
        return F.transform(name, lambda x: x / F.greatest(total, F.lit(1.0)))

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    terms = F.zip_with(shares(counts), shares(reference), lambda p, q: (part(p, q) + part(q, p)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def places(common: DataFrame) -> DataFrame:
    """Adds ``listed``, the common words between line breaks, and ``marks``, with a letter for each word where its line
    break stands in ``listed``, one character on; the first letter is for words that are not listed.
    """
    padded = F.transform("common", lambda w, k: F.rpad(F.get(F.array(*map(F.lit, LETTERS)), k + 1), F.char_length(w) + 1, F.lit(" ")))
    return common.withColumns(
        {
            "listed": F.concat(F.lit("\n"), F.array_join("common", "\n"), F.lit("\n")),
            "marks": F.concat(F.lit(LETTERS[0]), F.array_join(padded, "")),
            "longest": F.array_max(F.transform("common", lambda w: F.octet_length(w))),
        }
    )


def measure(docs: DataFrame, common: DataFrame) -> DataFrame:
    """One narrow row per document with its counts and histograms."""
    df = docs.join(places(common), "lang_key", "left").withColumn("words", words_of(F.col("text")))
    joined, n = F.array_join("words", ""), F.size("words").cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = df.withColumn("n_words", n).withColumn("lines", lines).withColumn("joined", joined)
    # A letter for each word: its place among the common words, or the first letter.
    mark = lambda w: F.when(F.octet_length(w) > F.col("longest"), LETTERS[0]).otherwise(
        F.substring("marks", F.instr("listed", F.concat(F.lit("\n"), w, F.lit("\n"))) + 1, F.lit(1))
    )
    df = repeated_words(df.withColumn("places", F.array_join(F.transform("words", mark), "")))
    bins = [F.octet_length("places") - F.octet_length(F.replace(F.col("places"), F.lit(x), F.lit(""))) for x in LETTERS]
    return df.select(
        *[c for c in docs.columns if c != "text"],
        "n_words",
        F.char_length("joined").cast("long").alias("word_chars"),
        F.regexp_count("joined", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
        class_counts(F.col("text")).cast("array<bigint>").alias("classes"),
        F.when(F.col("common").isNotNull(), F.array(*bins).cast("array<bigint>")).alias("bins"),
    )


def references(measured: DataFrame, copied: DataFrame) -> DataFrame:
    """Shares of each language, summed over its distinct texts that pass the simple rules, as whole numbers, and the
    pooled shares of all languages with the weight of ``POOLED`` texts."""
    df = measured.where(~F.col("base_failed")).join(copied, ["lang_key", "text_key"], "left")
    widths = {"classes": len(CLASSES) + 1, "bins": COMMON + 1}

    def sums(name: str) -> Column:
        total = F.greatest(F.aggregate(name, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(1))
        part = F.lit(UNIT) / (total * F.coalesce("copies", F.lit(1)))
        return F.array(*[F.sum((F.get(name, F.lit(i)) * part).cast("long")) for i in range(widths[name])]).alias(f"own_{name}")

    return df.groupBy("lang_key").agg(*[sums(name) for name in widths])


def pooled(refs: DataFrame) -> DataFrame:
    """Adds the pool, one row of sums over the languages, to each reference."""
    for name, width in (("classes", len(CLASSES) + 1), ("bins", COMMON + 1)):
        pool = refs.agg(F.array(*[F.sum(F.get(f"own_{name}", F.lit(i))) for i in range(width)]).alias("pool")).scalar()
        refs = refs.withColumn("pool", pool).withColumn("whole", F.aggregate("pool", F.lit(0).cast("long"), lambda a, x: a + x))
        share = F.transform("pool", lambda x: x / F.greatest("whole", F.lit(1)) * F.lit(POOLED * UNIT))
        refs = refs.withColumn(f"ref_{name}", F.zip_with(f"own_{name}", share, lambda a, b: a + b)).drop("pool", "whole")
    return refs.drop("own_classes", "own_bins")


def judge(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts, distances and verdict of every document.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept``.  A document is rejected if a simple rule fails or if it has at least ``GUARD_WORDS`` words
    and a distance from its language's reference is above its bound; for shorter ones the distances are null.

    Null texts count as empty and fail the simple rules.  A null language is a language of its own.  Repeated rows
    are judged each.  Other columns are not read.  Only built-in functions are used.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), lang_col), F.lit("")).alias("lang_key"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    copied = scratch.keep(copied_texts(docs), "copied")
    common = scratch.keep(common_words(docs, copied), "common")
    measured = scratch.keep(measure(docs, common), "measured")
    refs = scratch.keep(pooled(scratch.keep(references(measured, copied), "sums")), "references")
    guarded = F.col("n_words") >= GUARD_WORDS
    judged = measured.join(refs, "lang_key", "left").withColumns(
        {"class_distance": F.when(guarded, distance("classes", "ref_classes")), "word_distance": F.when(guarded, distance("bins", "ref_bins"))}
    )
    far = (F.col("class_distance") > MOST_CLASS) | (F.col("word_distance") > MOST_WORD)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance"]
    return judged.select(*columns, (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    judged = judge(documents(spark, sf_dir), Scratch(spark, "quality"))
    return judged.drop("class_distance", "word_distance")


QUERIES = {"op8_quality_rules": query}


WORD_SQL = r"[^\x20\x09-\x0D]+"
CLASS_SQL = ["[a-z]", r"[\x20\x09-\x0D]", "[A-Z]", "[0-9]", r"[!-/:-@\[-`{-~]"]
ORACLES = {
    "op8_quality_rules": f"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce('=' || lang, '') as lang_key,
    count(*) over (partition by coalesce('=' || lang, ''), coalesce(text, '')) as copies from documents),
w as (
  select rid, lang_key, unnest(ws) as word, generate_subscripts(ws, 1) as i
  from (select rid, lang_key, regexp_extract_all(text, '{WORD_SQL}') as ws from d)),
counted as (
  select rid, count(*) as n_words, sum(length(word)) as word_chars,
    sum(length(word) - length(regexp_replace(word, '[#*$%&|<>]', '', 'g'))) as n_symbols from w group by rid),
runs as (
  select rid, i, concat_ws(' ', word, {", ".join(f"lead(word, {k}) over o" for k in range(1, WINDOW))}) as run,
    lead(i, {WINDOW - 1}) over o as last
  from w window o as (partition by rid order by i)),
starts as (select rid, i from runs where last is not null qualify count(*) over (partition by rid, run) > 1),
repeated as (select rid, count(distinct i + k) as n from starts, range({WINDOW}) r(k) group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as line from d),
dup as (select rid, count(*) - count(distinct line) as n from lines where regexp_matches(line, '{WORD_SQL}') group by rid),
base as (
  select rid, doc_id, lang_key, copies, text, coalesce(n_words, 0) as n_words, cast(coalesce(word_chars, 0) as bigint) as word_chars,
    cast(coalesce(n_symbols, 0) as bigint) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words,
    coalesce(n_words, 0) < {MIN_WORDS} or 100 * coalesce(repeated.n, 0) > {MOST_REPEATED} * coalesce(n_words, 0) as base_failed
  from d left join counted using (rid) left join repeated using (rid) left join dup using (rid)),
common as (
  select w.lang_key, word, row_number() over (
      partition by w.lang_key order by sum(cast(floor({UNIT} / (greatest(n_words, {MIN_WORDS}) * copies)) as bigint)) desc, word) as bin
  from w join base using (rid) group by w.lang_key, word qualify bin <= {COMMON}),
found as (
  select rid, 'word' as kind, coalesce(bin, 0) as bin, count(*) as n from w left join common using (lang_key, word) group by rid, coalesce(bin, 0)
  union all select rid, 'class', bin, n from (
    {" union all ".join(f"select rid, {k} as bin, length(text) - length(regexp_replace(text, '{c}', '', 'g')) as n from d" for k, c in enumerate(CLASS_SQL))}
    union all select rid, {len(CLASS_SQL)}, length(regexp_replace(text, '{"|".join(CLASS_SQL)}', '', 'g')) from d)),
bins as (
  select 'word' as kind, b as bin from range({COMMON + 1}) r(b) union all select 'class', b from range({len(CLASS_SQL) + 1}) r(b)),
cells as (
  select b.rid, lang_key, copies, base_failed, n_words, bins.kind, bins.bin, coalesce(f.n, 0) as n,
    sum(coalesce(f.n, 0)) over (partition by b.rid, bins.kind) as total
  from base b cross join bins left join found f on f.rid = b.rid and f.kind = bins.kind and f.bin = bins.bin),
own as (
  select lang_key, kind, bin, sum(cast(floor(n * ({UNIT} / (greatest(total, 1) * copies))) as bigint)) as n
  from cells where not base_failed group by all),
pool as (select kind, bin, sum(n) / greatest(sum(sum(n)) over (partition by kind), 1) * {POOLED * UNIT} as n from own group by kind, bin),
refs as (select o.lang_key, o.kind, o.bin, o.n + p.n as n from own o join pool p using (kind, bin)),
shares as (
  select c.rid, c.kind, c.n / greatest(c.total, 1) as p, r.n / greatest(sum(r.n) over (partition by c.rid, c.kind), 1) as q
  from cells c join refs r using (lang_key, kind, bin) where c.n_words >= {GUARD_WORDS}),
far as (
  select rid, kind, sqrt(greatest(sum(
    (case when p > 0 then p * log2(2 * p / (p + q)) else 0 end + case when q > 0 then q * log2(2 * q / (p + q)) else 0 end) / 2), 0)) as apart
  from shares group by rid, kind)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not exists (
    select 1 from far where far.rid = base.rid and apart > case kind when 'class' then {MOST_CLASS} else {MOST_WORD} end) as kept
from base"""
}
