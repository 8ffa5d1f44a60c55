"""Derived tables: seasons with ages and rates, careers, era factors, awards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cohortry.functions import scalar as fn
from cohortry.operators.curves import agg_poly_fit, aging_curve_points
from cohortry.operators.graph import league_factor as factor_from_edges
from cohortry.operators.pairs import agg_rate_delta, agg_rate_ratio, join_consecutive
from cohortry.session import stage

# Award type identifiers and the output column each is counted in.
AWARD_TYPES = {
    7464: "hart",
    7467: "norris",
    7471: "vezina",
    230: "first_all_star",
    149: "second_all_star",
    223: "all_star",
}
# Tournament names and the age limit of the second one.
JUNIOR_TOURNAMENT = "WJC-18"
UNDER20_TOURNAMENT = "WJC-20"
UNDER20_MAX_AGE = 18
# Column orders of the two season tables.
SKATER_COLUMNS = [
    "player_id", "season", "team", "league_name", "league_id", "gp", "g", "a", "p", "pim", "plus_minus",
]
GOALIE_COLUMNS = ["player_id", "season", "team", "league_name", "league_id", "gp", "gaa", "svp"]


def _present(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if c in df.columns]


def season_enrich(stats: DataFrame, bios: DataFrame, month_day: str = fn.SEASON_CUTOFF) -> DataFrame:
    """Season rows of known entities with decimal age, whole age and per-exposure rates."""
    joined = stats.join(bios.select("player_id", "dob"), "player_id")
    return joined.select(
        *_present(stats, SKATER_COLUMNS),
        fn.season_age("season", "dob", month_day).alias("age"),
        fn.int_age("season", "dob").alias("age2"),
        fn.round_ratio("g", "gp").alias("g_gp"),
        fn.round_ratio("a", "gp").alias("a_gp"),
        fn.round_ratio("p", "gp").alias("p_gp"),
    )


def goalie_enrich(goalies: DataFrame, bios: DataFrame, month_day: str = fn.SEASON_CUTOFF) -> DataFrame:
    """Goalie season rows with ages; only entities with a complete birth date."""
    complete = bios.where(F.length("dob") > 4).select("player_id", "dob")
    return goalies.join(complete, "player_id").select(
        *_present(goalies, GOALIE_COLUMNS),
        fn.season_age("season", "dob", month_day).alias("age"),
        fn.int_age("season", "dob").alias("age2"),
    )


def agg_career(stats: DataFrame, bios: DataFrame) -> DataFrame:
    """Totals and rates per entity and category.

    Totals come first, so the join with the biographies moves one row per career line.
    The name is a grouping key of the first step and only reduced on its result: a
    minimum of text beside sums would make Spark sort the season rows.
    """
    sums = ("gp", "g", "a", "p")
    named = stats.groupBy("player_id", "league_id", "league_name").agg(*[F.sum(c).alias(c) for c in sums])
    totals = named.groupBy("player_id", "league_id").agg(
        F.min("league_name").alias("league_name"), *[F.sum(c).alias(c) for c in sums]
    )
    return totals.join(bios.select("player_id"), "player_id", "left_semi").select(
        "player_id", "league_name", "league_id", "gp", "g", "a", "p",
        fn.round_ratio("g", "gp").alias("g_gp"),
        fn.round_ratio("a", "gp").alias("a_gp"),
        fn.round_ratio("p", "gp").alias("p_gp"),
    )


def agg_era(season: DataFrame) -> DataFrame:
    """Rows, exposure and pooled rate per category and season."""
    sums = season.groupBy("league_name", "season").agg(
        F.count("player_id").alias("n"), F.sum("gp").alias("gp"), F.sum("p").alias("p")
    )
    return sums.select("season", "league_name", "n", "gp", fn.safe_div("p", "gp").alias("p_gp"))


def agg_alltime(season: DataFrame) -> DataFrame:
    """Pooled rate per category over all seasons."""
    sums = season.groupBy("league_name").agg(F.sum("gp").alias("gp"), F.sum("p").alias("p"))
    return sums.select("league_name", fn.safe_div("p", "gp").alias("p_gp"))


def agg_median(era: DataFrame) -> DataFrame:
    """Median season rate per category; a category has one row per season."""
    return era.groupBy("league_name").agg(F.median("p_gp").alias("p_gp"))


def era_adjust(season: DataFrame) -> DataFrame:
    """All-time rate over season rate per category and season.

    Season sums are computed once; the all-time sums are sums of those, taken as a
    window over the handful of seasons of each category.
    """
    sums = season.groupBy("league_name", "season").agg(F.sum("gp").alias("gp"), F.sum("p").alias("p"))
    every = Window.partitionBy("league_name")
    alltime = fn.safe_div(F.sum("p").over(every), F.sum("gp").over(every))
    ratio = fn.safe_div(alltime, fn.safe_div("p", "gp"))
    return sums.select("season", "league_name", ratio.alias("era_adj_p_gp"))


def rate_deltas(season: DataFrame, bios: DataFrame) -> DataFrame:
    """Change of the pooled rate per category, position and age step."""
    pairs = join_consecutive(season, same_category=True)
    placed = pairs.join(bios.select("player_id", F.col("pos2").alias("pos")), "player_id")
    named = placed.withColumnRenamed("category0", "league_name")
    return agg_rate_delta(named, ["league_name", "age0", "age1", "pos"])


def curve_points(season: DataFrame, bios: DataFrame, min_n: int = 10) -> DataFrame:
    """Cumulative change points of every category and position."""
    return aging_curve_points(rate_deltas(season, bios), min_n)


def aging_curve(season: DataFrame, bios: DataFrame, min_n: int = 10, positions=("F", "D")) -> DataFrame:
    """Fitted curve per category and position with more than one point."""
    points = curve_points(season, bios, min_n).where(F.col("pos").isin(*positions))
    return agg_poly_fit(points, ["league_name", "pos"], "age1", "delta_p_gp", min_points=2)


def league_edges(season: DataFrame, bios: DataFrame, min_gp: int = 20, min_n: int = 50) -> DataFrame:
    """Transition edges between categories with their size and rate ratio."""
    pairs = join_consecutive(season, min_exposure=min_gp)
    known = pairs.join(bios.select("player_id"), "player_id", "left_semi")
    edges = agg_rate_ratio(known, ("category0", "category1"), min_n)
    return edges.select(F.col("category0").alias("src"), F.col("category1").alias("dst"), "n", "le")


def league_factor(
    season: DataFrame, bios: DataFrame, anchor: str = "NHL", min_gp: int = 20, min_n: int = 50,
    anchor_cycles: bool = True,
) -> DataFrame:
    """Category strength relative to the anchor, from season rows.

    The edges (at most categories squared) are stored once; the path sums read them
    several times.
    """
    edges = stage(league_edges(season, bios, min_gp, min_n), "edges")
    return factor_from_edges(edges, anchor, anchor_cycles)


def award_roster(career: DataFrame, goalie_season: DataFrame, bios: DataFrame, league: str = "NHL") -> DataFrame:
    """Entities of the target category whose awards are looked up; skaters, then goalies."""
    skaters = career.where(F.col("league_name") == league).select("player_id")
    goalies = goalie_season.where(F.col("league_name") == league).select("player_id").distinct()
    keepers = bios.where(F.col("pos2") == "G").select("player_id")
    return skaters.unionByName(goalies.join(keepers, "player_id", "left_semi"))


def count_awards(awards: DataFrame) -> DataFrame:
    """Awards of each kind per entity from ``player_id, award_type`` rows."""
    return awards.groupBy("player_id").agg(
        *[F.count_if(F.col("award_type") == k).cast("int").alias(name) for k, name in AWARD_TYPES.items()]
    )


def agg_conditional_count(
    seasons: DataFrame, first: str = JUNIOR_TOURNAMENT, second: str = UNDER20_TOURNAMENT,
    max_age: int = UNDER20_MAX_AGE,
) -> DataFrame:
    """Appearances per entity in the two tournaments; no appearance gives NULL."""
    in_first = F.col("league_name") == first
    in_second = (F.col("league_name") == second) & (F.col("age2") <= max_age)
    counted = seasons.where(in_first | in_second).groupBy("player_id").agg(
        F.count_if(in_first).alias("wjc_18"), F.count_if(in_second).alias("wjc_20")
    )
    return counted.select("player_id", F.nullif("wjc_18", F.lit(0)).alias("wjc_18"), F.nullif("wjc_20", F.lit(0)).alias("wjc_20"))


def awards_table(
    skater_season: DataFrame,
    goalie_season: DataFrame,
    award_counts: DataFrame,
    *,
    strict: bool = False,
    first: str = JUNIOR_TOURNAMENT,
    second: str = UNDER20_TOURNAMENT,
    max_age: int = UNDER20_MAX_AGE,
) -> DataFrame:
    """Tournament and award counts of everyone with a season.

    Default: one row per entity, both season tables added up.  ``strict`` keeps the two
    tables apart: an entity in both is listed once per table, and once more for each
    table that has an appearance.
    """
    cols = ["player_id", "league_name", "age2"]
    skaters, goalies = skater_season.select(*cols), goalie_season.select(*cols)
    names = list(AWARD_TYPES.values())
    if not strict:
        both = skaters.unionByName(goalies)
        in_first = F.col("league_name") == first
        in_second = (F.col("league_name") == second) & (F.col("age2") <= max_age)
        roster = both.groupBy("player_id").agg(
            F.nullif(F.count_if(in_first), F.lit(0)).alias("wjc_18"),
            F.nullif(F.count_if(in_second), F.lit(0)).alias("wjc_20"),
        )
    else:
        parts = [agg_conditional_count(t, first, second, max_age) for t in (skaters, goalies)]
        roster = skaters.select("player_id").distinct().unionByName(goalies.select("player_id").distinct())
        for name in ("wjc_18", "wjc_20"):
            counted = [p.where(F.col(name).isNotNull()).select("player_id", name) for p in parts]
            roster = roster.join(counted[0].unionByName(counted[1]), "player_id", "left")
    return roster.join(award_counts, "player_id", "left").select("player_id", "wjc_18", "wjc_20", *names)
