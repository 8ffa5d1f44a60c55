"""The wide per-entity feature frame used for clustering, training and scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.functions import scalar as fn

# Thresholds of the labels and of the frames.
LABEL_MIN_GP = 164
LABEL_MIN_RATE = {"F": 0.33, "D": 0.25}
AGES = (17, 18)
MIN_GP = 20
MAX_BIRTH_YEAR = 1994
PROJECTION_DATE = "2019-09-15"
# Columns dropped by each variant flag.
RAW_RATES = ["g_gp17", "a_gp17", "g_gp18", "a_gp18"]
ADJUSTED_PARTS = ["adj_g_a17", "adj_g_a18", "adj_a_a17", "adj_a_a18"]
ADJUSTED_SUMS = ["adj_p_a17", "adj_p_a18"]
CLUSTER_COLUMNS = ["clusters50", "clusters100", "clusters200"]
LABEL_COLUMNS = ["classifier1", "classifier2", "classifier3"]
TARGET_COLUMNS = ["p_gp", "g_gp", "a_gp"]
FEATURE_COLUMNS = [
    "player_id", "height", "weight", "age", "pos", "country", "league_id17", "league_id18",
    "g_gp17", "a_gp17", "g_gp18", "a_gp18",
    "adj_g_a17", "adj_g_a18", "adj_a_a17", "adj_a_a18", "adj_p_a17", "adj_p_a18",
    "wjc_18", "wjc_20", "clusters50", "clusters100", "clusters200",
]
CATEGORICAL = ["league_id17", "league_id18", "pos", "country"]
SCALED_CLASS = [
    "height", "weight", "age", "adj_p_a17", "adj_p_a18", "adj_g_a17", "adj_g_a18", "adj_a_a17", "adj_a_a18",
    "g_gp17", "a_gp17", "g_gp18", "a_gp18", "wjc_18", "wjc_20",
]
SCALED_REGR = [c for c in SCALED_CLASS if c not in ADJUSTED_SUMS]


def join_composite_dim(season: DataFrame, league: DataFrame, era: DataFrame) -> DataFrame:
    """Season rows with the strength of their category and the factor of their season.

    The two factors are merged on the small side first, so the season rows meet one
    table of at most one row per category and season.
    """
    factors = era.join(league, "league_name").select(
        "league_name", "season", "le", "era_adj_p_gp"
    )
    return season.join(factors, ["league_name", "season"])


def agg_weighted_mean(adjusted: DataFrame, keys: Sequence[str] = ("player_id", "age2")) -> DataFrame:
    """Exposure-weighted mean of the adjusted rates per entity and age."""
    weight = F.col("era_adj_p_gp") * F.col("le") * F.col("gp")
    return adjusted.groupBy(*keys).agg(
        F.sum("gp").alias("gp"),
        fn.safe_div(F.sum(F.col("g_gp") * weight), F.sum("gp")).alias("normalized_g_gp"),
        fn.safe_div(F.sum(F.col("a_gp") * weight), F.sum("gp")).alias("normalized_a_gp"),
        F.max("age").alias("age"),
    )


def pivot_ages(
    rows: DataFrame, values: dict[str, str], ages: Sequence[int] = AGES, age: str = "age2", key: str = "player_id"
) -> DataFrame:
    """One column per value and age.  ``values`` maps a source column to an output stem.

    Output columns are numbered 17 and 18 after the default ages, whatever ages are given.
    """
    picks: list[Column] = []
    for at, mark in zip(ages, AGES):
        for source, stem in values.items():
            picks.append(F.max(F.when(F.col(age) == at, F.col(source))).alias(f"{stem}{mark}"))
    return rows.where(F.col(age).isin(*ages)).groupBy(key).agg(*picks)


def adjusted_pivot(season: DataFrame, league: DataFrame, era: DataFrame, ages: Sequence[int] = AGES) -> DataFrame:
    """Adjusted goal and assist rates at the two ages, with exposure and age at the second."""
    wanted = season.where(F.col("age2").isin(*ages))
    means = agg_weighted_mean(join_composite_dim(wanted, league, era))
    wide = pivot_ages(
        means,
        {"normalized_g_gp": "adj_g_a", "normalized_a_gp": "adj_a_a", "gp": "adj_gp_a", "age": "age_a"},
        ages,
    )
    return wide.withColumnRenamed("age_a18", "age").drop("age_a17")


def agg_argmax_row(
    season: DataFrame,
    keys: Sequence[str] = ("player_id", "age2"),
    by: str = "gp",
    cols: Sequence[str] = ("age2", "league_id", "g_gp", "a_gp"),
    tie: Sequence[str] = ("league_id", "team", "season"),
) -> DataFrame:
    """The row with the largest ``by`` per group.

    A rank limited to the first row before the shuffle as well as after it.  Rows without ``by`` never win; equal
    rows are decided by the smallest ``tie`` values, so the choice is reproducible.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc(by), *tie)
    first = season.where(F.col(by).isNotNull()).withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    return first.select(*keys, by, *[c for c in cols if c not in keys])


def raw_pivot(season: DataFrame, ages: Sequence[int] = AGES, group_key: str = "age2") -> DataFrame:
    """Category, exposure and raw rates of the main row at each of the two ages.

    ``group_key="age"`` groups by decimal age, where all seasons of an entity without a
    complete birth date form one group; ``"age2"`` groups by whole age.
    """
    rows = season if group_key == "age" else season.where(F.col("age2").isin(*ages))
    main = agg_argmax_row(rows, ("player_id", group_key))
    return pivot_ages(
        main, {"league_id": "league_id", "gp": "gp", "g_gp": "g_gp", "a_gp": "a_gp"}, ages
    )


def prj_labels(career: DataFrame, league: str, pos: str, min_gp: int = LABEL_MIN_GP, min_rate: float | None = None) -> DataFrame:
    """Class labels and target rates from the career in the target category.

    Written as the negated conditions: an unknown rate with enough exposure counts as 1.
    """
    rate = LABEL_MIN_RATE.get(pos, LABEL_MIN_RATE["D"]) if min_rate is None else min_rate
    few = F.col("gp") <= min_gp
    return career.where(F.col("league_name") == league).select(
        "player_id",
        F.when(F.col("gp") < 1, 0).otherwise(1).alias("classifier1"),
        F.when(few | (F.col("p_gp") < rate), 0).otherwise(1).alias("classifier2"),
        F.when(few, 0).otherwise(1).alias("classifier3"),
        "p_gp", "g_gp", "a_gp",
    )


def _people(bios: DataFrame, pos: str, max_birth_year: int | None, as_of: str) -> DataFrame:
    people = bios.where(F.col("pos2") == pos)
    if max_birth_year is not None:
        people = people.where(fn.birth_year("dob") <= max_birth_year)
    return people.select(
        "player_id", "height", "weight", F.col("pos" if "pos" in bios.columns else "pos2").alias("pos"), "country", "dob",
        fn.age_on(as_of, "dob").alias("age1"),
    )


def feat_frame(
    season: DataFrame,
    bios: DataFrame,
    league: DataFrame,
    era: DataFrame,
    awards: DataFrame,
    career: DataFrame,
    clusters: DataFrame | None = None,
    draft: DataFrame | None = None,
    *,
    pos: str,
    mode: str = "train",
    ages: Sequence[int] = AGES,
    min_gp: int = MIN_GP,
    max_birth_year: int | None = MAX_BIRTH_YEAR,
    target_league: str = "NHL",
    label_min_gp: int = LABEL_MIN_GP,
    label_min_rate: float | None = None,
    labelled_only: bool = False,
    group_key: str = "age2",
    dedupe_draft: bool = True,
    cohort_date: str | None = None,
    cohort_age: tuple[float, float] = (18, 19),
    projection_date: str = PROJECTION_DATE,
) -> DataFrame:
    """Feature frame of one position.

    ``mode="train"`` applies the birth-year cap and the exposure minimum at both ages.
    ``mode="cohort"`` takes the entities whose age on ``cohort_date`` lies in
    ``cohort_age``, asks for the exposure at the second age only, and leaves the summed
    rate of the first age empty where the exposure is too small.  ``labelled_only``
    keeps entities with label 3.  The draft adds no column; with
    ``dedupe_draft=False`` an entity drafted twice appears twice.
    """
    if mode not in ("train", "cohort"):
        raise ValueError("mode is 'train' or 'cohort'")
    cohort = mode == "cohort"
    people = _people(bios, pos, None if cohort else max_birth_year, projection_date)
    people = people.where(
        F.col("height").isNotNull() & F.col("weight").isNotNull()
        & F.col("pos").isNotNull() & F.col("country").isNotNull()
    )
    if cohort:
        at = fn.age_on(cohort_date or projection_date, "dob")
        people = people.where((F.length("dob") > 4) & (at >= cohort_age[0]) & (at < cohort_age[1]))

    adjusted = adjusted_pivot(season, league, era, ages).where(
        F.col("adj_g_a17").isNotNull() & fn.truthy("adj_g_a18")
        & F.col("adj_a_a17").isNotNull() & F.col("adj_a_a18").isNotNull() & F.col("age").isNotNull()
    )
    enough = F.col("gp18") >= min_gp
    if not cohort:
        enough = enough & (F.col("gp17") >= min_gp)
    raw = raw_pivot(season, ages, group_key).where(
        enough & F.col("league_id17").isNotNull() & F.col("league_id18").isNotNull()
    )
    labels = prj_labels(career, target_league, pos, label_min_gp, label_min_rate)
    frame = people.join(adjusted, "player_id").join(raw, "player_id")
    if labelled_only:
        frame = frame.join(labels.where("classifier3 = 1"), "player_id")
    else:
        frame = frame.join(labels, "player_id", "left")
    frame = frame.join(awards.select("player_id", "wjc_18", "wjc_20"), "player_id", "left")
    if clusters is not None:
        levels = clusters.where(F.col("pos") == pos) if "pos" in clusters.columns else clusters
        frame = frame.join(levels.select("player_id", *CLUSTER_COLUMNS), "player_id", "left")
    else:
        frame = frame.withColumns({c: F.lit(None).cast("int") for c in CLUSTER_COLUMNS})
    if draft is not None and not dedupe_draft:
        frame = frame.join(draft.select("player_id"), "player_id", "left")

    first = F.col("adj_g_a17") + F.col("adj_a_a17")
    frame = frame.withColumn("adj_p_a17", F.when(F.col("gp17") >= min_gp, first) if cohort else first)
    frame = frame.withColumn("adj_p_a18", F.col("adj_g_a18") + F.col("adj_a_a18"))
    filled = ["wjc_18", "wjc_20", *CLUSTER_COLUMNS, *LABEL_COLUMNS, *TARGET_COLUMNS]
    extra = ["age1"] if cohort else []
    return frame.fillna(0, subset=filled).select(*FEATURE_COLUMNS, *extra, *LABEL_COLUMNS, *TARGET_COLUMNS)


def feat_frame_cluster(
    season: DataFrame, bios: DataFrame, league: DataFrame, era: DataFrame, *, pos: str,
    ages: Sequence[int] = AGES, min_gp: int = MIN_GP, max_birth_year: int = MAX_BIRTH_YEAR,
) -> DataFrame:
    """Four adjusted rates per entity for clustering; exposure is that of the second age."""
    people = bios.where((F.col("pos2") == pos) & (fn.birth_year("dob") <= max_birth_year))
    rates = adjusted_pivot(season, league, era, ages).where(
        F.col("adj_g_a17").isNotNull() & fn.truthy("adj_g_a18")
        & F.col("adj_a_a17").isNotNull() & F.col("adj_a_a18").isNotNull() & (F.col("adj_gp_a18") >= min_gp)
    )
    return rates.join(people.select("player_id"), "player_id", "left_semi").select(
        "player_id",
        F.col("adj_g_a17").alias("g_a17"), F.col("adj_g_a18").alias("g_a18"),
        F.col("adj_a_a17").alias("a_a17"), F.col("adj_a_a18").alias("a_a18"),
    )


def variant_drop_list(adj: int = 1, clusters: int = 0, task: str = "class") -> list[str]:
    """Columns a model variant leaves out."""
    if adj == 1:
        dropped = list(RAW_RATES)
    elif task == "class":
        dropped = [*ADJUSTED_SUMS, *ADJUSTED_PARTS]
    else:
        dropped = list(ADJUSTED_PARTS)
    kept = {1: "clusters50", 2: "clusters100", 3: "clusters200"}.get(clusters)
    return dropped + [c for c in CLUSTER_COLUMNS if c != kept]


def prj_exclude(df: DataFrame, adj: int = 1, clusters: int = 0, task: str = "class") -> DataFrame:
    """The frame of a model variant."""
    return df.drop(*variant_drop_list(adj, clusters, task))
