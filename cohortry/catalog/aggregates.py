"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.registry import R, div, query, rounded, sql
from cohortry.catalog.projections import stored_frame
from cohortry.operators import curves, graph
from cohortry.operators.metrics import agg_confusion, agg_r2
from cohortry.operators.pairs import agg_rate_ratio, join_consecutive
from cohortry.operators.prepare import agg_moments
from cohortry.plans import clusters, features as ff, tables


@query("agg_rate_delta", sql(["deltas"], "select league_name, age0, age1, pos, n, delta from deltas"))
def _(s):
    return tables.rate_deltas(s.season(), s.bios())


@query("agg_rate_ratio", sql(["edges"], "select src as category0, dst as category1, n, le from edges"))
def _(s):
    return agg_rate_ratio(join_consecutive(s.season(), min_exposure=standin.MIN_GP), min_n=standin.EDGE_MIN_N)


@query("agg_career", sql(["career"], "select player_id, league_name, league_id, gp, g, a, p, g_gp, a_gp, p_gp from career"))
def _(s):
    return s.career()


@query("agg_era", sql(["sss"], f"""
    select season, league_name, count(*) as n, cast(sum(gp) as bigint) as gp, {R(div('sum(p)', 'sum(gp)'))} as p_gp from sss group by league_name, season"""))
def _(s):
    return rounded(tables.agg_era(s.season()), "p_gp")


@query("agg_alltime", sql(["sss"], f"select league_name, {R(div('sum(p)', 'sum(gp)'))} as p_gp from sss group by league_name"))
def _(s):
    return rounded(tables.agg_alltime(s.season()), "p_gp")


@query("agg_median", sql(["sss"], f"""
    select league_name, {R('median(r)')} as p_gp from (select league_name, season, {div('sum(p)', 'sum(gp)')} as r from sss group by league_name, season) t
    group by league_name"""))
def _(s):
    return rounded(tables.agg_median(tables.agg_era(s.season())), "p_gp")


@query("agg_weighted_mean", sql(["weighted"], f"""
    select player_id, age2, gp, age, {R('ng')} as normalized_g_gp, {R('na')} as normalized_a_gp from weighted"""))
def _(s):
    means = ff.agg_weighted_mean(ff.join_composite_dim(s.season(), s.league(), s.era()))
    return rounded(means, "normalized_g_gp", "normalized_a_gp")


@query("agg_pivot_age", sql(["adj_wide"], f"""
    select player_id, {R('adj_g_a17')} as adj_g_a17, {R('adj_g_a18')} as adj_g_a18, {R('adj_a_a17')} as adj_a_a17, {R('adj_a_a18')} as adj_a_a18,
      adj_gp_a17, adj_gp_a18, age from adj_wide"""))
def _(s):
    return rounded(ff.adjusted_pivot(s.season(), s.league(), s.era(), standin.AGES), *ff.ADJUSTED_PARTS)


@query("agg_argmax_row", sql(["main_row"], "select player_id, age2, gp, league_id, g_gp, a_gp from main_row"))
def _(s):
    return ff.agg_argmax_row(s.season())


@query("agg_bare_any", sql(["bios", "sss"], """
    select b.player_id, height, weight, pos2, country, count(*) as seasons, max(age) as age
    from sss s join bios b on b.player_id = s.player_id group by b.player_id, height, weight, pos2, country"""))
def _(s):
    per_player = s.season().groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"), F.max("age").alias("age"))
    return per_player.join(s.bios().select("player_id", "height", "weight", "pos2", "country"), "player_id").select(
        "player_id", "height", "weight", "pos2", "country", "seasons", "age"
    )


@query("agg_conditional_count", sql(["sss", "gss"], """
    select * from (
      select player_id, nullif(count(*) filter (league_name = '1-URGENT'), 0) as wjc_18, nullif(count(*) filter (league_name = '2-HIGH' and age2 <= 18), 0) as wjc_20
      from (select player_id, league_name, age2 from sss union all select player_id, league_name, age2 from gss) r group by player_id) t
    where wjc_18 is not null or wjc_20 is not null"""))
def _(s):
    cols = ["player_id", "league_name", "age2"]
    both = s.season().select(*cols).unionByName(s.goalie_season().select(*cols))
    return tables.agg_conditional_count(both, "1-URGENT", "2-HIGH", 18)


@query("agg_distinct", sql(["stats"], "select distinct player_id, league_name from stats"))
def _(s):
    return s.stats().select("player_id", "league_name").distinct()


@query("agg_path_score", sql(["scores"], f"select node, {R('score')} as score from scores"))
def _(s):
    return rounded(graph.path_scores(s.edges(), standin.ANCHOR), "score")


MOMENTS = ["height", "weight", "age", "adj_p_a17", "adj_p_a18"]


@query("agg_moments", sql(["frame"], " union all ".join(
    f"select '{c}' as feature, {R(f'avg({c})')} as mean, {R(f'stddev_pop({c})')} as deviation from frame" for c in MOMENTS)))
def _(s):
    return rounded(agg_moments(stored_frame(s), MOMENTS), "mean", "deviation")


# The counterpart solves the normal equations on the raw ages by elimination.
POLY = f"""
    , sums as (select league_name, pos, cast(count(*) as double) as n, sum(x) as s1, sum(x*x) as s2, sum(x*x*x) as s3, sum(x*x*x*x) as s4,
        sum(y) as t0, sum(x*y) as t1, sum(x*x*y) as t2, count(distinct x) as k
      from (select league_name, pos, cast(age1 as double) - 20 as x, delta_p_gp as y from points where pos in ('F', 'D')) p
      group by league_name, pos having count(*) > 1),
    step as (select *, n*s2 - s1*s1 as d11, n*s3 - s1*s2 as d12, n*s4 - s2*s2 as d22, n*t1 - s1*t0 as e1, n*t2 - s2*t0 as e2 from sums),
    quad as (select *, case when k >= 3 then (d11*e2 - d12*e1) / (d11*d22 - d12*d12) else 0 end as q from step),
    line as (select *, (e1 - q*d12) / d11 as l from quad),
    fit as (select league_name, pos, q as x2, l - 40*q as x1, (t0 - l*s1 - q*s2) / n - 20*l + 400*q as x0 from line)"""


def poly_sql(body: str) -> str:
    head = sql(["points"], "")
    return head + POLY + " " + body


@query("agg_poly_fit", poly_sql(f"select league_name, pos, {R('x2', 5)} as x2, {R('x1', 5)} as x1, {R('x0', 5)} as x0 from fit"))
def _(s):
    points = tables.curve_points(s.season(), s.bios(), standin.MIN_N).where(F.col("pos").isin("F", "D"))
    fit = curves.agg_poly_fit(points, ["league_name", "pos"], "age1", "delta_p_gp")
    return fit.withColumns({c: F.round(c, 5) for c in ("x2", "x1", "x0")})


@query("agg_confusion", sql(["marked"], f"""
    , c as (select lang, count(*) filter (quality = 1 and pred = 1) as tp, count(*) filter (quality = 0 and pred = 1) as fp,
        count(*) filter (quality = 1 and pred = 0) as fn, count(*) filter (quality = 0 and pred = 0) as tn
      from (select *, case when n_chars > 1000 then 1 else 0 end as pred from marked) m group by lang)
    select lang, tp, fp, fn, tn, {R('coalesce(' + div('(tp + tn)', '(tp + fp + fn + tn)') + ', 0)')} as accuracy,
      {R('coalesce(' + div('tp', '(tp + fp)') + ', 0)')} as precision, {R('coalesce(' + div('tp', '(tp + fn)') + ', 0)')} as recall,
      {R('coalesce(' + div('2 * tp', '(2 * tp + fp + fn)') + ', 0)')} as f1 from c"""))
def _(s):
    docs = s.table("documents").select("doc_id", "lang", (F.col("n_chars") > 1000).cast("int").alias("prediction"))
    rows = s.table("labels").join(docs, "doc_id")
    return rounded(agg_confusion(rows, "quality", "prediction", by=["lang"]), "accuracy", "precision", "recall", "f1")


@query("agg_r2", sql(["sss"], f"""
    select league_name, count(*) as n,
      {R('1 - sum((p_gp - (g_gp + a_gp)) * (p_gp - (g_gp + a_gp))) / (var_pop(p_gp) * count(*))')} as r2
    from sss where p_gp is not null group by league_name"""))
def _(s):
    rows = s.season().select("league_name", "p_gp", (F.col("g_gp") + F.col("a_gp")).alias("guess"))
    return rounded(agg_r2(rows, "p_gp", "guess", by=["league_name"]), "r2")


def _groups(s):
    return s.bios().select("player_id", (F.col("player_id") % 20).alias("cluster"))


OUTCOMES = f"""
    , o as (select b.player_id, b.player_id % 20 as cluster, coalesce(gp, 0) as gp, coalesce(g, 0) as g, coalesce(p, 0) as p
      from bios b left join (select * from career where league_name = '{standin.ANCHOR}') c on c.player_id = b.player_id)"""


@query("agg_cluster_profile", sql(["bios", "career"], OUTCOMES + f"""
    select cluster, count(*) as n, {R('avg(gp)')} as gp, {R('avg(g)')} as g, {R('avg(p)')} as p from o group by cluster"""))
def _(s):
    return rounded(clusters.agg_cluster_profile(_groups(s), s.career(), standin.ANCHOR), "gp", "g", "p")


@query("agg_cluster_value", sql(["bios", "career"], OUTCOMES + f""",
    v as (select x.player_id, x.cluster, {div(f'count(*) filter (y.gp > {standin.LABEL_MIN_GP})', 'count(*)')} as pr,
        82 * {div(f'sum(y.p) filter (y.gp > {standin.LABEL_MIN_GP})', f'sum(y.gp) filter (y.gp > {standin.LABEL_MIN_GP})')} as xp
      from o x join o y on x.cluster = y.cluster and x.player_id <> y.player_id group by x.player_id, x.cluster)
    select player_id, cluster, {R('pr')} as pr, {R('xp')} as xp, {R('pr * xp')} as xv from v"""))
def _(s):
    value = clusters.agg_cluster_value(_groups(s), s.career(), standin.ANCHOR, min_gp=standin.LABEL_MIN_GP)
    return rounded(value, "pr", "xp", "xv")


@query("rank_expected_value", sql(["bios", "career", "draft"], OUTCOMES + f""",
    v as (select x.player_id, x.cluster, {div(f'count(*) filter (y.gp > {standin.LABEL_MIN_GP})', 'count(*)')} as pr,
        82 * {div(f'sum(y.p) filter (y.gp > {standin.LABEL_MIN_GP})', f'sum(y.gp) filter (y.gp > {standin.LABEL_MIN_GP})')} as xp
      from o x join o y on x.cluster = y.cluster and x.player_id <> y.player_id group by x.player_id, x.cluster)
    select player_id, cluster, {R('pr')} as pr, {R('xp')} as xp, {R('pr * xp')} as xv from v
    where player_id in (select d.player_id from draft d join bios b on b.player_id = d.player_id where year = 2017 and pos2 = 'F')
    order by xv desc, player_id"""))
def _(s):
    value = clusters.agg_cluster_value(_groups(s), s.career(), standin.ANCHOR, min_gp=standin.LABEL_MIN_GP)
    forwards = s.bios().where("pos2 = 'F'").select("player_id")
    cohort = s.draft().where("year = 2017").join(forwards, "player_id", "left_semi").select("player_id").distinct()
    return clusters.rank_expected_value(rounded(value, "pr", "xp", "xv"), cohort)
