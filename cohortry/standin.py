"""The domain's tables derived from the provided order and embedding tables.

Entities are customers, categories order priorities, periods order years, exposure the
number of lines, and outcomes come from return flags.  Every frame is computed by Spark
from the given files, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortry.plans import clusters, features, tables
from cohortry.session import apply_settings, stage

# Parameters under which the derived data gives non-empty results.
AGES = (20, 21)
MIN_GP = 3
MIN_N = 10
EDGE_MIN_N = 50
ANCHOR = "1-URGENT"
MAX_BIRTH_YEAR = 1981
LABEL_MIN_GP = 12
LABEL_MIN_RATE = 0.5
COHORT_DATE = "2001-09-15"
COHORT_AGE = (20, 25)


class StandIn:
    """Lazy frames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, str(sf_dir)
        self._staged: dict[str, DataFrame] = {}
        apply_settings(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def staged(self, name: str, build) -> DataFrame:
        """A table that several steps of one query share is written once; another query builds its own."""
        if name not in self._staged:
            self._staged[name] = stage(build(), name)
        return self._staged[name]

    def forget(self, keep: tuple[str, ...] = ()) -> None:
        """Build staged tables anew when they are next asked for, but for those to keep."""
        self._staged = {name: df for name, df in self._staged.items() if name in keep}

    def bios(self) -> DataFrame:
        key = F.col("c_custkey")
        year = (1976 + key % 6).cast("string")
        month = F.lpad((1 + key % 12).cast("string"), 2, "0")
        day = F.lpad((1 + key % 28).cast("string"), 2, "0")
        nations = self.table("nation").select("n_nationkey", "n_name")
        joined = self.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
        return joined.select(
            key.alias("player_id"),
            F.when(key % 10 == 0, "G").when(key % 3 == 0, "D").otherwise("F").alias("pos2"),
            F.col("n_name").alias("country"),
            F.when(key % 97 == 0, F.lit(None))
            .when(key % 41 == 0, year)
            .otherwise(F.concat_ws("-", year, month, day))
            .alias("dob"),
            (170 + key % 25).cast("double").alias("height"),
            (70 + key % 31).cast("double").alias("weight"),
        )

    def _stats(self) -> DataFrame:
        # Lines are added up per order before they meet the orders.
        flag = F.col("l_returnflag")
        lines = self.table("lineitem").groupBy("l_orderkey").agg(
            F.count(F.lit(1)).alias("gp"),
            F.count_if(flag == "R").alias("g"),
            F.count_if(flag == "A").alias("a"),
            F.count_if(flag != "N").alias("p"),
        )
        year = F.year("o_orderdate")
        orders = self.table("orders").select(
            "o_orderkey",
            F.col("o_custkey").alias("player_id"),
            F.concat_ws("-", (year - 1).cast("string"), year.cast("string")).alias("season"),
            F.col("o_orderpriority").alias("league_name"),
            F.left("o_orderpriority", F.lit(1)).cast("int").alias("league_id"),
            F.col("o_orderstatus").alias("team"),
        )
        return (
            orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
            .groupBy("player_id", "season", "league_name", "league_id", "team")
            .agg(*[F.sum(c).alias(c) for c in ("gp", "g", "a", "p")])
        )

    def stats(self) -> DataFrame:
        return self.staged("stats", self._stats)

    def goalie_stats(self) -> DataFrame:
        goalies = self.bios().where("pos2 = 'G'").select("player_id")
        rows = self.stats().join(goalies, "player_id", "left_semi")
        return rows.select(
            "player_id", "season", "team", "league_name", "league_id", "gp",
            F.round(F.col("p").cast("double") / F.col("gp"), 2).alias("gaa"),
            F.round(1 - F.col("g").cast("double") / F.col("gp"), 3).alias("svp"),
        )

    def season(self) -> DataFrame:
        return self.staged("season", lambda: tables.season_enrich(self.stats(), self.bios()))

    def goalie_season(self) -> DataFrame:
        return tables.goalie_enrich(self.goalie_stats(), self.bios())

    def career(self) -> DataFrame:
        return tables.agg_career(self.stats(), self.bios())

    def pos(self) -> DataFrame:
        return self.bios().select("player_id", "pos2")

    def draft(self) -> DataFrame:
        """Most entities once, every eleventh twice, every fourth not at all."""
        key = F.col("c_custkey")
        times = F.when(key % 4 == 3, F.array().cast("array<int>")).when(
            key % 11 == 0, F.array(F.lit(0), F.lit(1))
        ).otherwise(F.array(F.lit(0)))
        rows = self.table("customer").select("c_custkey", "c_mktsegment", F.explode(times).alias("again"))
        return rows.select(
            key.alias("player_id"),
            (2012 + key % 7 + F.col("again")).cast("int").alias("year"),
            (1 + key % 7).cast("int").alias("round"),
            (2 * key + F.col("again")).alias("ov"),
            F.col("c_mktsegment").alias("team"),
        )

    def height_weight(self) -> DataFrame:
        """Measurements at the draft: smaller and lighter than later in life."""
        bios = self.bios().select("player_id", "height", "weight", "pos2")
        rows = self.draft().join(bios, "player_id")
        key = F.col("player_id")
        return rows.select(
            "year", "ov",
            (F.col("height") - 1 - key % 3).cast("int").alias("height"),
            (F.col("weight") - 4 - key % 5).cast("int").alias("weight"),
            F.col("pos2").alias("pos"),
        )

    def edges(self) -> DataFrame:
        return self.staged("edges", lambda: tables.league_edges(self.season(), self.bios(), MIN_GP, EDGE_MIN_N))

    def league(self) -> DataFrame:
        return self.staged("league", lambda: tables.league_factor(self.season(), self.bios(), ANCHOR, MIN_GP, EDGE_MIN_N))

    def era(self) -> DataFrame:
        return self.staged("era", lambda: tables.era_adjust(self.season()))

    def rates(self, pos: str = "F") -> DataFrame:
        return self.staged(f"rates-{pos}", lambda: features.feat_frame_cluster(
            self.season(), self.bios(), self.league(), self.era(), pos=pos, ages=AGES, min_gp=MIN_GP, max_birth_year=MAX_BIRTH_YEAR
        ))

    def clusters(self, pos: str = "F") -> DataFrame:
        return self.staged(f"clusters-{pos}", lambda: clusters.player_clusters(self.rates(pos), pos, seed=1))

    def award_rows(self) -> DataFrame:
        """Award type rows: one per order of an entity."""
        kind = F.element_at(
            F.array(*[F.lit(k) for k in (*tables.AWARD_TYPES, 999)]), (F.col("o_orderkey") % 7 + 1).cast("int")
        )
        return self.table("orders").select(
            F.col("o_custkey").alias("player_id"), kind.alias("award_type")
        )

    def roster_counts(self) -> DataFrame:
        """Counts of everyone on the award roster, zeros included."""
        roster = tables.award_roster(self.career(), self.goalie_season(), self.bios(), ANCHOR).distinct()
        return roster.join(tables.count_awards(self.award_rows()), "player_id", "left").fillna(0)

    def awards(self) -> DataFrame:
        return tables.awards_table(
            self.season(), self.goalie_season(), self.roster_counts(),
            first="1-URGENT", second="2-HIGH", max_age=18,
        )

    def memberships(self) -> DataFrame:
        """Entities and the (supplier, year) groups they share."""
        orders = self.table("orders").select(
            "o_orderkey", F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season")
        )
        lines = self.table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("league_id"))
        return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("player_id", "league_id", "season")

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label"
        )
