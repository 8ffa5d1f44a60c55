"""Landed JSON documents to typed tables.

Documents arrive as one text per row (a file per page, or a column).  Optional fields
use plain schemas.  Where a rule depends on a key being *present* rather than non-null,
the element is kept as a variant, which tells a missing key from a stored null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry.functions import scalar as fn
from cohortry.plans.tables import AWARD_TYPES

# The published shape of the pages, the marker for an unknown entity, and
# the keys a stat line must carry.
DRAFT_PAGE = (
    "metadata STRUCT<totalCount: BIGINT>, data ARRAY<STRUCT<player: STRUCT<id: BIGINT>, year: STRING, "
    "round: INT, overall: INT, team: STRUCT<name: STRING>>>"
)
MEMBERS_PAGE = "metadata STRUCT<totalCount: BIGINT>, data ARRAY<STRUCT<player: STRUCT<id: BIGINT>>>"
PLAYER_PAGE = (
    "data ARRAY<STRUCT<player: STRUCT<id: BIGINT, firstName: STRING, lastName: STRING, dateOfBirth: STRING, "
    "yearOfBirth: INT, country: STRUCT<name: STRING>, playerPositionDetailed: STRING, shoots: STRING, "
    "height: DOUBLE, weight: DOUBLE>>>"
)
AWARDS_PAGE = "data STRUCT<awards: ARRAY<STRUCT<awardType: STRUCT<id: BIGINT>>>>"
UNKNOWN_PLAYER = -1
REGULAR_SEASON = "REGULAR_SEASON"
COMMON_KEYS = {
    "player_id": ("$.player.id", "bigint"),
    "season": ("$.season.name", "string"),
    "team": ("$.team.name", "string"),
    "league_name": ("$.league.name", "string"),
    "league_id": ("$.league.id", "bigint"),
    "gp": ("$.GP", "int"),
}
SKATER_KEYS = {"g": ("$.G", "int"), "a": ("$.A", "int"), "p": ("$.TP", "int"), "pim": ("$.PIM", "int")}
SKATER_OPTIONAL = {"plus_minus": ("$.PM", "int")}
GOALIE_KEYS = {"gaa": ("$.GAA", "double"), "svp": ("$.SVP", "double")}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path, one document per file, as ``path, raw``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")
    )


def parse(docs: DataFrame, schema: str, raw: str = "raw") -> DataFrame:
    """Parse the text column; other columns are kept."""
    return docs.withColumn("doc", F.from_json(raw, schema)).drop(raw)


def draft_rows(pages: DataFrame, start_year: int | None = None, end_year: int | None = None) -> DataFrame:
    """Draft picks; a pick without a player gets the unknown marker."""
    rows = parse(pages, DRAFT_PAGE).select(F.explode("doc.data").alias("d")).select(
        F.coalesce("d.player.id", F.lit(UNKNOWN_PLAYER).cast("bigint")).alias("player_id"),
        fn.year_prefix("d.year").try_cast("int").alias("year"),
        F.col("d.round").alias("round"),
        F.col("d.overall").alias("ov"),
        F.col("d.team.name").alias("team"),
    )
    if start_year is not None:
        rows = rows.where(F.col("year") >= start_year)
    return rows if end_year is None else rows.where(F.col("year") <= end_year)


def bio_rows(docs: DataFrame) -> DataFrame:
    """One biography per document, from its first element."""
    player = F.get("doc.data", F.lit(0))["player"]
    first = parse(docs, PLAYER_PAGE).select(player.alias("q")).where(F.col("q.id").isNotNull())
    return first.select(
        F.col("q.id").alias("player_id"),
        F.col("q.firstName").alias("first_name"),
        F.col("q.lastName").alias("last_name"),
        F.coalesce("q.dateOfBirth", F.col("q.yearOfBirth").cast("string")).alias("dob"),
        F.col("q.country.name").alias("country"),
        F.col("q.playerPositionDetailed").alias("pos"),
        F.col("q.shoots").alias("shoots"),
        F.col("q.height").alias("height"),
        F.col("q.weight").alias("weight"),
        fn.position_class("q.playerPositionDetailed").alias("pos2"),
    )


def landed_bios(bios: DataFrame, after_year: int = 1969) -> DataFrame:
    """Biographies with a known birth year after the limit."""
    return bios.where(fn.birth_year("dob") > after_year)


def _stat_rows(docs: DataFrame, goalies: bool, strict: bool) -> DataFrame:
    keys = {**COMMON_KEYS, **(GOALIE_KEYS if goalies else SKATER_KEYS)}
    optional = {} if goalies else SKATER_OPTIONAL
    lines = docs.select(F.from_json("raw", "data ARRAY<VARIANT>")["data"].alias("data"))
    path, first = "$.player.playerPositionDetailed", F.get("data", F.lit(0))
    side = F.coalesce(F.try_variant_get(first, path, "string") == "G", F.lit(False))
    # A first record without the key carries no stat lines at all; a stored null is no goalie.
    wanted = F.try_variant_get(first, path, "variant").isNotNull() & (side if goalies else ~side)
    element = lines.where(wanted).select(F.explode("data").alias("e"))

    def value(path: str, kind: str) -> Column:
        return F.try_variant_get("e", path, kind)

    def present(path: str) -> Column:
        return F.try_variant_get("e", path, "variant").isNotNull()

    rows = element.where(value("$.gameType", "string") == REGULAR_SEASON)
    for path, _ in keys.values():
        rows = rows.where(present(path))
    out = rows.select(*[value(p, k).alias(n) for n, (p, k) in {**keys, **optional}.items()])
    return out.dropna(subset=list(keys)) if strict else out


def skater_rows(docs: DataFrame, strict: bool = False) -> DataFrame:
    """Regular-season skater lines that carry every required key.

    A key stored as null counts as present; ``strict`` drops such rows as well.
    """
    return _stat_rows(docs, goalies=False, strict=strict)


def goalie_rows(docs: DataFrame, strict: bool = False) -> DataFrame:
    """The same for documents whose first element is a goalie."""
    return _stat_rows(docs, goalies=True, strict=strict)


def member_rows(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Player ids listed on the pages, with chosen page columns."""
    return parse(pages, MEMBERS_PAGE).select(*keep, F.explode("doc.data").alias("d")).select(
        *keep, F.col("d.player.id").alias("player_id")
    )


def award_counts(docs: DataFrame) -> DataFrame:
    """Awards of each kind per document; a missing or empty document counts zeros."""
    found = F.from_json("raw", AWARDS_PAGE)["data"]["awards"]["awardType"]["id"]
    with_ids = docs.select("player_id", F.coalesce(found, F.array().cast("array<bigint>")).alias("ids"))

    def held(kind: int) -> Column:
        return F.size(F.filter("ids", lambda x: x == kind))

    return with_ids.select("player_id", *[held(k).alias(n) for k, n in AWARD_TYPES.items()])


def merge_pages(pages: DataFrame, keys: Sequence[str], schema: str = MEMBERS_PAGE, item: str = "player.id") -> DataFrame:
    """Completeness of offset pages: distinct items read per key against the announced total.

    A page that was landed twice adds to ``rows_read`` only.
    """
    parsed = parse(pages, schema).withColumn("page", F.monotonically_increasing_id())
    items = parsed.select(*keys, "page", F.col("doc.metadata.totalCount").alias("total"), F.explode_outer("doc.data").alias("d"))
    items = items.select(*keys, "page", "total", F.col("d").isNotNull().alias("there"), F.col(f"d.{item}").alias("item"))
    # First by item, combined map-side, so that a large key is no single task.
    by_item = items.groupBy(*keys, "item").agg(F.count_if("there").alias("n"), F.max("total").alias("total"))
    pages_read = parsed.groupBy(*keys).agg(F.count(F.lit(1)).alias("pages"))
    read = by_item.groupBy(*keys).agg(
        F.sum("n").alias("rows_read"), F.count("item").alias("distinct_rows"), F.max("total").alias("total_count")
    )
    both = pages_read.join(read, list(keys)) if keys else pages_read.join(read, F.lit(True))
    return both.select(*keys, "pages", "rows_read", "distinct_rows", "total_count", (F.col("distinct_rows") >= F.col("total_count")).alias("complete"))
