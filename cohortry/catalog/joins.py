"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.projections import stored_frame, train_frame
from cohortry.catalog.registry import R, query, r6, rounded, sql
from cohortry.functions import scalar as fn
from cohortry.operators import curves, graph
from cohortry.operators.knn import join_knn
from cohortry.operators.pairs import join_consecutive
from cohortry.operators.prepare import OneHot
from cohortry.plans import body, clusters, features as ff, tables


def binary_vectors(s):
    """Embeddings with one label against the rest."""
    return s.staged("binary", lambda: s.vectors().withColumn("label", (F.col("label") == 3).cast("int")))


@query("join_consecutive", sql(["pairs"], """
    select player_id, age0, age1, l0 as category0, l1 as category1, count(*) as pairs, cast(sum(gp0) as bigint) as exposure0,
      cast(sum(p0) as bigint) as outcome0, cast(sum(gp1) as bigint) as exposure1, cast(sum(p1) as bigint) as outcome1
    from pairs group by player_id, age0, age1, l0, l1"""))
def _(s):
    return join_consecutive(s.season())


@query("join_bios", sql(["bios", "stats"], """
    select s.player_id, season, team, league_name, gp, pos2, country from stats s join bios b on b.player_id = s.player_id"""))
def _(s):
    people = s.bios().select("player_id", "pos2", "country")
    return s.stats().join(people, "player_id").select("player_id", "season", "team", "league_name", "gp", "pos2", "country")


@query("join_cumulative_theta", sql(["deltas"], f"""
    select hi.league_name, hi.pos, hi.age0, hi.n, {R('sum(lo.delta)')} as running from deltas hi join deltas lo
      on hi.league_name = lo.league_name and hi.pos = lo.pos and hi.age0 >= lo.age0
    group by hi.league_name, hi.pos, hi.age0, hi.n"""))
def _(s):
    total = curves.running_total(tables.rate_deltas(s.season(), s.bios()), ["league_name", "pos"], "age0", "delta", "running")
    return rounded(total.select("league_name", "pos", "age0", "n", "running"), "running")


@query("join_composite_dim", sql(["adjusted"], f"""
    select player_id, season, team, league_name, {R('le')} as le, {R('era_adj_p_gp')} as era_adj_p_gp from adjusted"""))
def _(s):
    joined = ff.join_composite_dim(s.season(), s.league(), s.era())
    return rounded(joined.select("player_id", "season", "team", "league_name", "le", "era_adj_p_gp"), "le", "era_adj_p_gp")


@query("join_feature_left", sql(["frame_k", "draft"], f"""
    select f.player_id, {R('adj_p_a18')} as adj_p_a18, wjc_18, classifier1, clusters50, clusters100, clusters200
    from frame_k f left join draft d on d.player_id = f.player_id"""))
def _(s):
    frame = train_frame(s, clustered=True, dedupe_draft=False)
    return rounded(frame.select("player_id", "adj_p_a18", "wjc_18", "classifier1", *ff.CLUSTER_COLUMNS), "adj_p_a18")


@query("join_filtered_right", sql(["bios", "career"], f"""
    select b.player_id, gp, p_gp from bios b left join (select * from career where league_name = '{standin.ANCHOR}') c on c.player_id = b.player_id"""))
def _(s):
    target = s.career().where(F.col("league_name") == standin.ANCHOR).select("player_id", "gp", "p_gp")
    return s.bios().select("player_id").join(target, "player_id", "left")


@query("join_draft_measure", sql(["draft", "bios", "hw"], """
    select d.player_id, d.year, d.ov, h.height as height0, h.weight as weight0, b.height as height1, b.weight as weight1, pos2 as pos
    from draft d join bios b on b.player_id = d.player_id join hw h on h.year = d.year and h.ov = d.ov"""))
def _(s):
    return body.join_draft_measure(s.draft(), s.bios(), s.height_weight()).drop("dob")


@query("join_cluster_levels", sql(["bios"], """
    select player_id, player_id % 5 as clusters50, case when player_id % 2 = 0 then player_id % 10 end as clusters100,
      case when player_id % 3 = 0 then player_id % 20 end as clusters200 from bios"""))
def _(s):
    ids = s.bios().select("player_id")
    levels = [
        ids.where(F.col("player_id") % every == 0).withColumn(f"clusters{k}", F.col("player_id") % size)
        for every, k, size in ((1, 50, 5), (2, 100, 10), (3, 200, 20))
    ]
    return clusters.join_cluster_levels(*levels)


@query("join_onehot_merge", sql(["bios"], """
    select player_id, cast(country = c.name as int) as hot, c.name as category, 'country' as feature
    from bios, (select distinct country as name from bios) c"""))
def _(s):
    people = s.bios().select("player_id", "country")
    return OneHot(["country"]).fit(people).long_form(people, "player_id")


@query("join_scalar_norm", sql(["scores"], f"""
    select node, {R(f"score / (select score from scores where node = '{standin.ANCHOR}')")} as score from scores"""))
def _(s):
    return rounded(graph.scalar_norm(graph.path_scores(s.edges(), standin.ANCHOR), "node", standin.ANCHOR, "score"), "score")


@query("join_paths", sql(["paths"], f"select start, path, nodes, {R('product')} as product from paths"))
def _(s):
    paths = graph.join_paths(s.edges(), standin.ANCHOR)
    return paths.select("start", F.concat_ws(">", "path").alias("path"), "nodes", r6("product").alias("product"))


FRONTIER = """
    with recursive links as (
      select distinct o_custkey as player_id, l_suppkey as league_id, year(o_orderdate) as season from orders join lineitem on l_orderkey = o_orderkey),
    opens as (select l.* from links l join bios b on b.player_id = l.player_id where pos2 <> 'G' and try_cast(left(dob, 4) as int) > 1977),
    reach as (
      select player_id from draft where year = (select max(year) from draft)
      union
      select m.player_id from reach r join opens o on o.player_id = r.player_id join links m on m.league_id = o.league_id and m.season = o.season)
    select player_id from reach"""


@query("join_frontier", "with recursive bios as (" + sql(["bios"], "select * from bios") + "), draft as (" + sql(["draft"], "select * from draft") + "), " + FRONTIER.strip()[len("with recursive "):])
def _(s):
    draft = s.draft()
    last = draft.agg(F.max("year").alias("m")).scalar()
    seeds = draft.where(F.col("year") == last).select("player_id")
    people = s.bios().select("player_id", ((F.col("pos2") != "G") & (fn.birth_year("dob") > 1977)).alias("open"))
    links = s.memberships().distinct().join(people, "player_id", "left")
    return graph.join_frontier(links, seeds, expandable=F.coalesce("open", F.lit(False))).select("player_id")


@query("join_visited_anti", sql(["bios", "draft"], "select player_id from bios where player_id not in (select player_id from draft)"))
def _(s):
    return s.bios().select("player_id").join(s.draft().select("player_id"), "player_id", "left_anti")


@query("join_knn", sql(["knn_far"], "select left_id, right_id, distance, cast(rank as int) as rank from knn_far where rank <= 3"))
def _(s):
    rows = binary_vectors(s)
    return join_knn(rows.where("label = 0"), rows.where("label = 1"), 3)


@query("join_peers_except_self", sql(["bios", "career"], f"""
    select b.player_id, b.player_id % 20 as cluster, coalesce(gp, 0) as gp, coalesce(g, 0) as g, coalesce(p, 0) as p
    from bios b left join (select * from career where league_name = '{standin.ANCHOR}') c on c.player_id = b.player_id
    where b.player_id % 20 = 7 and b.player_id <> 27 order by p desc, player_id"""))
def _(s):
    groups = s.bios().select("player_id", (F.col("player_id") % 20).alias("cluster"))
    return clusters.join_peers_except_self(groups, s.career(), standin.ANCHOR, 7, 27)
