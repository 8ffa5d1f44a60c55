"""Hand-computed answers for expressions and operators."""

import pytest
from pyspark.sql import functions as F

from cohortry.functions import scalar as fn
from cohortry.operators import curves, graph, metrics, ordering, pairs, prepare
from cohortry.plans import clusters, features as ff, tables
from cohortry.sources import html_tables, json_pages


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("dob, year", [("1994-05-06", 1994), ("1994", 1994), (None, None), ("19x4", None)])
def test_birth_year(spark, dob, year):
    assert one(spark, fn.birth_year(F.lit(dob).cast("string"))) == year


@pytest.mark.parametrize(
    "dob, age",
    [("2000-09-16", 19.0), ("1990", None), ("1990-00-00", None), (None, None), ("1990-02-30", None), ("2001-09-15", 18.0)],
)
def test_decimal_age(spark, dob, age):
    assert one(spark, fn.age_on("2019-09-15", F.lit(dob).cast("string"))) == age


def test_int_age(spark):
    assert one(spark, fn.int_age(F.lit("2016-2017"), F.lit("1994-05-06"))) == 23


@pytest.mark.parametrize("text, cm", [("6' 2\"", 187), ("5' 11\"", 180), ("6-2", None)])
def test_height(spark, text, cm):
    assert one(spark, fn.height_cm(F.lit(text))) == cm


def test_weight(spark):
    assert one(spark, fn.weight_kg(F.lit("190"))) == 86


def test_ratios(spark):
    assert one(spark, fn.round_ratio(F.lit(5), F.lit(0))) is None
    assert one(spark, fn.round_ratio(F.lit(1), F.lit(8))) == 0.13
    assert one(spark, fn.safe_div(F.lit(1), F.lit(0))) is None


@pytest.mark.parametrize("detail, pos", [("LW/C", "F"), ("D/RW", "D"), ("G", "G"), (None, None)])
def test_position(spark, detail, pos):
    assert one(spark, fn.position_class(F.lit(detail).cast("string"))) == pos


@pytest.mark.parametrize("value, kept", [(0.0, False), (0.3, True), (None, False)])
def test_truthy(spark, value, kept):
    assert one(spark, fn.truthy(F.lit(value).cast("double"))) in ([kept] if kept else [False, None])


def test_labels(spark):
    rows = [(1, "N", 164, 1.0), (2, "N", 165, 0.32), (3, "N", 165, 0.33), (4, "N", 165, None), (5, "N", 0, None)]
    career = spark.createDataFrame(rows, "player_id int, league_name string, gp int, p_gp double").withColumns(
        {"g_gp": F.lit(0.0), "a_gp": F.lit(0.0)}
    )
    got = {r.player_id: (r.classifier1, r.classifier2, r.classifier3) for r in ff.prj_labels(career, "N", "F").collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 1), 3: (1, 1, 1), 4: (1, 1, 1), 5: (0, 0, 0)}


SEASON = "player_id int, age double, age2 int, season string, team string, league_name string, league_id int, gp int, g_gp double, a_gp double"


def test_argmax_row(spark):
    rows = [
        (1, 17.1, 17, "s", "A", "x", 1, 10, 0.1, 0.1), (1, 17.1, 17, "s", "B", "x", 2, 20, 0.2, 0.2),
        (2, None, 17, "s", "A", "x", 1, 10, 0.1, 0.1), (2, None, 18, "s", "A", "x", 1, 30, 0.3, 0.3),
        (2, None, 19, "s", "A", "x", 1, 5, 0.5, 0.5), (3, 17.0, 17, "s", "A", "x", 1, None, 0.1, 0.1),
    ]
    season = spark.createDataFrame(rows, SEASON)
    by_age2 = {(r.player_id, r.age2): (r.gp, r.league_id) for r in ff.agg_argmax_row(season).collect()}
    assert by_age2 == {(1, 17): (20, 2), (2, 17): (10, 1), (2, 18): (30, 1), (2, 19): (5, 1)}
    by_age = {r.player_id: (r.age2, r.gp) for r in ff.agg_argmax_row(season, ("player_id", "age")).collect()}
    assert by_age == {1: (17, 20), 2: (18, 30)}
    # Without a full birth date all seasons are one group, so only one age survives the pivot.
    wide = {r.player_id: (r.gp17, r.gp18) for r in ff.raw_pivot(season, (17, 18), "age").collect()}
    assert wide[2] == (None, 30)
    assert {r.player_id: (r.gp17, r.gp18) for r in ff.raw_pivot(season).collect()}[2] == (10, 30)


def pair_frame(spark, rows):
    return spark.createDataFrame(rows, "player_id int, age2 int, league_name string, gp int, p int")


def test_rate_delta(spark):
    season = pair_frame(spark, [(1, 17, "x", 20, 10), (1, 18, "x", 20, 15), (2, 17, "y", 20, 0), (2, 18, "y", 20, 5)])
    got = pairs.agg_rate_delta(pairs.join_consecutive(season, same_category=True), ["category0", "age0", "age1"])
    assert {r.category0: (r.n, r.delta) for r in got.collect()} == {"x": (1, 0.5), "y": (1, 0.0)}


def test_weighted_mean(spark):
    rows = [(1, 17, 0.5, 10), (1, 17, 1.0, 30)]
    frame = spark.createDataFrame(rows, "player_id int, age2 int, g_gp double, gp int").withColumns(
        {"a_gp": F.lit(0.0), "le": F.lit(1.0), "era_adj_p_gp": F.lit(1.0), "age": F.lit(17.5)}
    )
    assert ff.agg_weighted_mean(frame).first().normalized_g_gp == 0.875


def test_poly_fit(spark):
    rows = [("a", 17, 0.2), ("a", 18, 0.1), ("a", 19, 0.05), ("b", 17, 0.2), ("b", 18, 0.1),
            ("c", 17, 0.0), ("c", 18, 0.0), ("c", 19, 0.0), ("d", 17, 1.0), ("d", 17, 3.0), ("e", 17, 1.0)]
    fit = curves.agg_poly_fit(spark.createDataFrame(rows, "k string, x int, y double"), ["k"], "x", "y")
    got = {r.k: (round(r.x2, 6), round(r.x1, 6), round(r.x0, 6)) for r in fit.collect()}
    assert got == {"a": (0.025, -0.975, 9.55), "b": (0, -0.1, 1.9), "c": (0, 0, 0), "d": (0, 0, 2.0)}


EDGES = "src string, dst string, le double"


def test_paths_on_a_complete_graph(spark):
    nodes = "NABCD"
    edges = spark.createDataFrame([(a, b, 1.0) for a in nodes for b in nodes], EDGES)
    counts = {r.start: r["count"] for r in graph.join_paths(edges, "N").groupBy("start").count().collect()}
    assert counts == {"N": 17, "A": 10, "B": 10, "C": 10, "D": 10}
    plain = graph.join_paths(edges, "N", anchor_cycles=False)
    assert plain.where("start = 'N'").count() == 0


def test_league_factor(spark):
    edges = spark.createDataFrame([("N", "N", 1.0), ("N", "B", 0.8), ("B", "N", 0.5), ("B", "B", 1.0), ("Q", "R", 1.0)], EDGES)
    raw = {r.node: round(r.score, 6) for r in graph.path_scores(edges, "N").collect()}
    assert raw == {"N": 0.147222, "B": 0.125, "Q": 0.0, "R": 0.0}
    normed = {r.league_name: round(r.le, 6) for r in graph.league_factor(edges, "N").collect()}
    assert normed == {"N": 1.0, "B": 0.849057, "Q": 0.0, "R": 0.0}


@pytest.mark.parametrize("keep", [3, 2, 5])
@pytest.mark.parametrize("cycles", [True, False])
def test_path_sums_agree_with_path_lists(spark, keep, cycles):
    nodes = "NABCDE"
    listed = [(a, b, 0.1 + ((i * 7 + j * 3) % 10) / 10) for i, a in enumerate(nodes) for j, b in enumerate(nodes) if (i * 5 + j * 11) % keep != 1]
    edges = spark.createDataFrame(listed, EDGES)
    long_way = graph.agg_path_score(graph.join_paths(edges, "N", 3, cycles), graph.node_list(edges))
    want = {r.node: r.score for r in long_way.collect()}
    got = {r.node: r.score for r in graph.path_scores(edges, "N", cycles).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_era(spark):
    season = spark.createDataFrame([(1, "s1", "x", 10, 5), (2, "s2", "x", 30, 30)], "player_id int, season string, league_name string, gp int, p int")
    assert tables.agg_alltime(season).first().p_gp == 0.875
    assert {r.season: r.era_adj_p_gp for r in tables.era_adjust(season).collect()} == {"s1": 1.75, "s2": 0.875}


def test_median(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 10.0, 20.0])], "id int, v double")
    assert ordering.exact_median(rows, "v", "id").first()["median"] == 6.0
    odd = rows.union(spark.createDataFrame([(9, 3.0), (10, None)], "id int, v double"))
    assert ordering.exact_median(odd, "v", "id").first()["median"] == 3.0


def test_standardise(spark):
    rows = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (4.0, 5.0)], "x double, flat double")
    scaler = prepare.Standardiser.fit(rows, ["x", "flat"])
    assert round(scaler.means[0], 6) == 2.333333 and round(scaler.deviations[0], 6) == 1.247219
    assert {r.flat for r in scaler.transform(rows).collect()} == {0.0}


def test_split_size(spark):
    parts = prepare.ml_split(spark.range(11), "id").groupBy("is_test").count().collect()
    assert {r.is_test: r["count"] for r in parts} == {True: 4, False: 7}


def test_confusion(spark):
    rows = [(1, 1)] * 3 + [(0, 1)] + [(1, 0)] * 2 + [(0, 0)] * 4
    got = metrics.agg_confusion(spark.createDataFrame(rows, "label int, prediction int")).first()
    assert (got.precision, got.recall, round(got.f1, 6), got.accuracy) == (0.75, 0.6, 0.666667, 0.7)


def test_cluster_value_leaves_the_entity_out(spark):
    members = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1)], "player_id int, cluster int")
    career = spark.createDataFrame([(1, "N", 200, 10, 100), (2, "N", 300, 10, 150), (3, "N", 10, 1, 1)],
                                   "player_id int, league_name string, gp int, g int, p int")
    got = {r.player_id: (r.pr, r.xp) for r in clusters.agg_cluster_value(members, career, "N").collect()}
    assert got == {1: (0.5, 41.0), 2: (0.5, 41.0), 3: (1.0, 41.0), 4: (None, None)}


def test_awards_of_an_entity_in_both_tables(spark):
    cols = "player_id int, league_name string, age2 int"
    skaters = spark.createDataFrame([(1, "WJC-18", 17), (1, "WJC-20", 18), (2, "X", 20)], cols)
    goalies = spark.createDataFrame([(1, "WJC-18", 17), (1, "WJC-20", 19)], cols)
    counts = spark.createDataFrame([(1, 7464), (1, 7464)], "player_id int, award_type int")
    plain = {r.player_id: (r.wjc_18, r.wjc_20, r.hart) for r in tables.awards_table(skaters, goalies, tables.count_awards(counts)).collect()}
    assert plain == {1: (2, 1, 2), 2: (None, None, None)}
    strict = tables.awards_table(skaters, goalies, tables.count_awards(counts), strict=True)
    # Listed twice, and each listing meets two tournament counts.
    assert strict.where("player_id = 1").count() == 4


def test_json_presence(spark):
    head = '{"player":{"id":1,"playerPositionDetailed":"C"},"gameType":"REGULAR_SEASON","season":{"name":"2001-2002"},"team":{"name":"T"},"league":{"id":5,"name":"L"},'
    docs = spark.createDataFrame(
        [(f'{{"data":[{head}"GP":1,"G":2,"A":3,"TP":null,"PIM":0}},{head}"GP":1,"A":3,"TP":4,"PIM":0}},{head}"GP":2,"G":2,"A":3,"TP":5,"PIM":0,"PM":-1}}]}}',)],
        "raw string",
    )
    got = sorted((r.gp, r.p, r.plus_minus) for r in json_pages.skater_rows(docs).collect())
    assert got == [(1, None, None), (2, 5, -1)]
    assert json_pages.skater_rows(docs, strict=True).count() == 1
    assert json_pages.goalie_rows(docs).count() == 0


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"metadata":{"totalCount":3},\n "data":[{"player":{"id":1}},{"player":{"id":2}}]}')
    (tmp_path / "b.json").write_text('{"metadata":{"totalCount":3},"data":[{"player":{"id":3}}]}')
    pages = json_pages.read_documents(spark, str(tmp_path))
    assert sorted(r.player_id for r in json_pages.member_rows(pages).collect()) == [1, 2, 3]
    assert json_pages.merge_pages(pages, []).first().complete is True


def test_html_picks_the_right_table(spark):
    html = '<table class="x"><tbody><tr><td>no</td></tr></tbody></table><table class="data"><tbody><tr><td>Round 1</td></tr>\n<tr><td> 1 </td><td><b>a</b></td></tr><tr></tr></tbody></table>'
    got = html_tables.table_cells(spark.createDataFrame([(html,)], "html string")).collect()
    assert [r.cells for r in got] == [["1", "a"]]
