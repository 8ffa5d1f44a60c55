"""Projections, filters, sorts and set operations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.registry import R, age_sql, query, rounded, sql
from cohortry.functions import scalar as fn
from cohortry.operators import graph
from cohortry.operators.pairs import join_consecutive
from cohortry.plans import features as ff, models, tables
from cohortry.sources import json_pages

ADJ = ["adj_g_a17", "adj_g_a18", "adj_a_a17", "adj_a_a18", "adj_p_a17", "adj_p_a18"]


def train_frame(s, clustered=False, **kw):
    options = dict(
        pos="F", ages=standin.AGES, min_gp=standin.MIN_GP, max_birth_year=standin.MAX_BIRTH_YEAR,
        target_league=standin.ANCHOR, label_min_gp=standin.LABEL_MIN_GP, label_min_rate=standin.LABEL_MIN_RATE,
        cohort_date=standin.COHORT_DATE, cohort_age=standin.COHORT_AGE,
    )
    options.update(kw)
    return ff.feat_frame(s.season(), s.bios(), s.league(), s.era(), s.awards(), s.career(), s.clusters() if clustered else None, s.draft(), **options)


def stored_frame(s, **kw):
    name = "frame-" + "-".join(f"{k}={v}" for k, v in sorted(kw.items()))
    return s.staged(name.replace("=", "_"), lambda: train_frame(s, **kw))


@query("prj_select_alias", sql(["sss"], "select player_id as entity, season as period, league_name as category, gp as exposure, p as outcome from sss"))
def _(s):
    names = {"player_id": "entity", "season": "period", "league_name": "category", "gp": "exposure", "p": "outcome"}
    return s.season().select(*[F.col(c).alias(n) for c, n in names.items()])


@query("prj_exclude", sql(["frame"], f"""
    select player_id, height, weight, age, pos, country, league_id17, league_id18, {', '.join(f'{R(c)} as {c}' for c in ADJ)}, wjc_18, wjc_20
    from frame"""))
def _(s):
    frame = ff.prj_exclude(stored_frame(s), adj=1, clusters=0)
    return rounded(frame.drop(*ff.LABEL_COLUMNS, *ff.TARGET_COLUMNS), *ADJ)


ORDER = ["weight", "age", "adj_p_a18", "height"]


@query("prj_feature_order", sql(["frame"], " union all ".join(
    f"select player_id, '{c}' as feature, {R(f'cast({c} as double)')} as value from frame" for c in ORDER)))
def _(s):
    model = Pipeline(stages=[VectorAssembler(inputCols=ORDER, outputCol="x")]).fit(stored_frame(s))
    recorded = model.stages[0].getInputCols()
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in recorded]).alias("feature"), vector_to_array("x").alias("value"))
    return rounded(model.transform(stored_frame(s)).select("player_id", F.inline(pairs)), "value")


@query("prj_position_class", """
    select p_partkey, case when contains(p_type, 'G') then 'G' when contains(p_type, 'D') then 'D' when p_type is not null then 'F' end as pos from part""")
def _(s):
    return s.table("part").select("p_partkey", fn.position_class("p_type").alias("pos"))


@query("prj_position_flag", sql(["bios"], "select player_id, case when pos2 = 'D' then 1 else 0 end as flag from bios"))
def _(s):
    return s.bios().select("player_id", fn.position_flag("pos2").alias("flag"))


@query("prj_labels", sql(["bios", "labels_f"], """
    select b.player_id, coalesce(classifier1, 0) as classifier1, coalesce(classifier2, 0) as classifier2, coalesce(classifier3, 0) as classifier3
    from bios b left join labels_f l on l.player_id = b.player_id"""))
def _(s):
    labels = ff.prj_labels(s.career(), standin.ANCHOR, "F", standin.LABEL_MIN_GP, standin.LABEL_MIN_RATE)
    joined = s.bios().select("player_id").join(labels.select("player_id", *ff.LABEL_COLUMNS), "player_id", "left")
    return joined.fillna(0, subset=ff.LABEL_COLUMNS)


@query("flt_notnull_truthy", sql(["sss"], "select player_id, season, team, league_name, g_gp from sss where g_gp is not null and g_gp <> 0"))
def _(s):
    return s.season().where(fn.truthy("g_gp")).select("player_id", "season", "team", "league_name", "g_gp")


@query("flt_threshold", sql(["deltas"], "select league_name, pos, age0, n from deltas where n >= 10"))
def _(s):
    deltas = tables.rate_deltas(s.season(), s.bios())
    return deltas.where(F.col("n") >= 10).select("league_name", "pos", "age0", "n")


@query("flt_birth_range", sql(["bios"], "select player_id, dob from bios where try_cast(left(dob, 4) as int) > 1977"))
def _(s):
    return json_pages.landed_bios(s.bios(), 1977).select("player_id", "dob")


@query("flt_age_window", sql(["bios"], f"""
    select player_id, age from (select player_id, {age_sql("'1998-09-15'")} as age from bios) t where age >= 18 and age < 19"""))
def _(s):
    aged = s.bios().select("player_id", fn.age_on("1998-09-15", "dob").alias("age"))
    return aged.where((F.col("age") >= 18) & (F.col("age") < 19))


@query("flt_between", sql(["draft"], "select player_id, year, ov from draft where year between 2014 and 2018"))
def _(s):
    return s.draft().where(F.col("year").between(2014, 2018)).select("player_id", "year", "ov")


@query("flt_same_category", sql(["pairs"], """
    select player_id, age0, l0 as category0, count(*) as pairs from pairs where l0 = l1 group by player_id, age0, l0"""))
def _(s):
    return join_consecutive(s.season(), same_category=True).select("player_id", "age0", "category0", "pairs")


@query("flt_stat_kind", sql(["bios", "stats"], """
    select s.player_id, season, team, league_name, gp from stats s join bios b on b.player_id = s.player_id where team <> 'P' and pos2 <> 'G'"""))
def _(s):
    skaters = s.bios().where("pos2 <> 'G'").select("player_id")
    return s.stats().where("team <> 'P'").join(skaters, "player_id", "left_semi").select("player_id", "season", "team", "league_name", "gp")


@query("flt_min_group", sql(["points"], "select league_name, pos, count(*) as points from points group by league_name, pos having count(*) > 1"))
def _(s):
    points = tables.curve_points(s.season(), s.bios(), standin.MIN_N)
    return points.groupBy("league_name", "pos").agg(F.count(F.lit(1)).alias("points")).where("points > 1")


@query("flt_labelled_only", sql(["frame"], "select player_id, p_gp, g_gp, a_gp from frame where classifier3 = 1"))
def _(s):
    return stored_frame(s, labelled_only=True).select("player_id", "p_gp", "g_gp", "a_gp")


@query("sort_curve", sql(["points"], f"select league_name, pos, age0, age1, n, {R('delta_p_gp')} as delta_p_gp from points order by league_name, pos, age0"))
def _(s):
    points = rounded(tables.curve_points(s.season(), s.bios(), standin.MIN_N), "delta_p_gp")
    return points.select("league_name", "pos", "age0", "age1", "n", "delta_p_gp").orderBy("league_name", "pos", "age0")


@query("sort_strength", sql(["league"], f"select league_name, {R('le')} as le from league order by le desc, league_name"))
def _(s):
    return rounded(s.league(), "le").orderBy(F.desc("le"), "league_name")


@query("rank_labels", sql(["frame"], f"""
    select player_id, classifier2 as prediction, {R('adj_p_a18')} as probability from frame order by prediction desc, probability desc, player_id"""))
def _(s):
    scored = stored_frame(s).select("player_id", F.col("classifier2").alias("prediction"), F.round("adj_p_a18", 6).alias("probability"))
    return models.rank_predictions(scored)


@query("set_union_all", sql(["sss", "gss"], "select distinct player_id from sss union all select distinct player_id from gss"))
def _(s):
    return s.season().select("player_id").distinct().unionByName(s.goalie_season().select("player_id").distinct())


@query("set_union_distinct_roster", sql(["sss", "gss"], "select player_id from sss union select player_id from gss"))
def _(s):
    return s.season().select("player_id").unionByName(s.goalie_season().select("player_id")).distinct()


@query("set_node_union", sql(["nodes"], "select node from nodes"))
def _(s):
    return graph.node_list(s.edges())


@query("set_concat_frames", sql(["stats", "goalies"], """
    select 'skater' as kind, player_id, season, team, league_name, gp from stats
    union all select 'goalie', player_id, season, team, league_name, gp from goalies"""))
def _(s):
    cols = ["player_id", "season", "team", "league_name", "gp"]
    skaters = s.stats().select(F.lit("skater").alias("kind"), *cols)
    return skaters.unionByName(s.goalie_stats().select(F.lit("goalie").alias("kind"), *cols))
