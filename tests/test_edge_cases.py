"""Cases in which an earlier version gave wrong or stale answers."""

import shutil

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cohortry.catalog import QUERIES
from cohortry.operators import leastsq, ordering, pairs, prepare
from cohortry.plans import features, models, tables
from cohortry.sources import html_tables, json_pages, tables as store


def test_a_replaced_table_gives_new_rows(spark, small, tmp_path):
    folder = tmp_path / "data"
    shutil.copytree(small, folder)
    for name in folder.iterdir():
        name.chmod(0o644)
    first = QUERIES["agg_distinct"](spark, str(folder)).count()
    orders = pq.read_table(f"{small}/orders.parquet")
    pq.write_table(orders.slice(0, orders.num_rows // 4), folder / "orders.parquet")
    spark.catalog.clearCache()
    assert 0 < QUERIES["agg_distinct"](spark, str(folder)).count() < first


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.createDataFrame([(i, None if i % 3 == 0 else i % 2) for i in range(90)], "id int, label int")


def test_null_is_a_stratum_of_its_own(labelled):
    split = prepare.ml_split(labelled, "id", 0.3, by=["label"])
    counts = {r.label: r.n for r in split.where("is_test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    assert counts == {None: 9, 0: 9, 1: 9}
    folds = {(r.label, r.fold): r["count"] for r in prepare.ml_folds(labelled, "id", "label").groupBy("label", "fold").count().collect()}
    assert set(folds.values()) == {10} and len(folds) == 9


def test_folds_of_many_classes(spark):
    rows = spark.createDataFrame([(i, i // 3) for i in range(4500)], "id int, label int")
    got = prepare.ml_folds(rows, "id", "label").groupBy("label").agg(F.count_distinct("fold").alias("n"))
    assert got.where("n = 3").count() == 1500


def test_not_a_number_and_infinities(spark):
    rows = [(i, v) for i, v in enumerate([float("nan"), float("-inf"), float("inf"), 1.0, 2.0, 3.0, None])]
    df = spark.createDataFrame(rows, "id int, v double")
    assert ordering.exact_median(df, "v", "id").first()["median"] == 2.0


def test_a_stored_null_position_is_no_goalie(spark):
    line = '"gameType":"REGULAR_SEASON","season":{"name":"2018-2019"},"team":{"name":"t"},"league":{"name":"l","id":1},"GP":1,"G":1,"A":1,"TP":2,"PIM":0'
    docs = [
        ('{"data":[{"player":{"id":1,"playerPositionDetailed":null},' + line + "}]}",),
        ('{"data":[{"player":{"id":2},' + line + "}]}",),
        ('{"data":[{"player":{"id":3,"playerPositionDetailed":"C"},' + line + "}]}",),
    ]
    frame = spark.createDataFrame(docs, "raw string")
    assert sorted(r.player_id for r in json_pages.skater_rows(frame).collect()) == [1, 3]


def test_html_entities_class_tokens_and_case(spark):
    html = """<TABLE border=0 CLASS='wide data sortable'><TBODY><TR><TD>O&#39;Neil &amp; Co</TD><TD>6&#x27; 2&quot;</TD><TD>&amp;lt; &#233;</TD></TR></TBODY></TABLE>"""
    got = html_tables.table_cells(spark.createDataFrame([(html,)], "html string")).first().cells
    assert got == ["O'Neil & Co", "6' 2\"", "&lt; é"]
    other = html.replace("data", "database")
    assert html_tables.table_cells(spark.createDataFrame([(other,)], "html string")).count() == 0


def test_a_repeated_page_does_not_hide_a_missing_one(spark):
    page = '{"metadata":{"totalCount":4},"data":[{"player":{"id":1}},{"player":{"id":2}}]}'
    rest = '{"metadata":{"totalCount":4},"data":[{"player":{"id":3}},{"player":{"id":4}}]}'
    empty = '{"metadata":{"totalCount":0},"data":[]}'
    rows = [("a", page), ("a", page), ("b", page), ("b", rest), ("b", page), ("c", empty)]
    got = {r.k: tuple(r)[1:] for r in json_pages.merge_pages(spark.createDataFrame(rows, "k string, raw string"), ["k"]).collect()}
    assert got == {"a": (2, 4, 2, 4, False), "b": (3, 6, 4, 4, True), "c": (1, 0, 0, 0, True)}


def test_dependent_inputs_have_no_p_value(spark):
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), 0.0, float(a + b), float(2 * a - b + rng.normal())) for a, b in rng.normal(size=(60, 2))]
    got = {r.feature: r for r in models.ml_ols_pvalues(spark.createDataFrame(rows, "a double, b double, z double, s double, y double"), ["a", "b", "z", "s"], "y").collect()}
    assert got["z"].p_value is None and got["s"].p_value is None and got["a"].p_value < 0.01
    want = np.linalg.lstsq(np.array([r[:2] for r in rows]), np.array([r[4] for r in rows]), rcond=None)[0]
    assert np.allclose([got["a"].coefficient, got["b"].coefficient], want)


def test_plans_neither_sort_twice_nor_double_rows(spark):
    season = spark.createDataFrame([(1, 20, "A", 1, "t", "s", 5, 1, 0.2, 0.1)], "player_id int, age2 int, league_name string, league_id int, team string, season string, gp int, p int, g_gp double, a_gp double")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    best = plan(features.agg_argmax_row(season))
    assert "SortAggregate" not in best and "WindowGroupLimit" in best
    assert "Generate" not in plan(pairs.join_consecutive(season, same_category=True))


def test_roster_members_without_awards_have_zeros(spark, small):
    rows = {r.player_id: r for r in QUERIES["awards_table"](spark, small).collect()}
    roster = {r.player_id for r in QUERIES["award_roster"](spark, small).collect()}
    assert roster and all((r.hart is None) == (p not in roster) for p, r in rows.items())
    assert tables.AWARD_TYPES


def test_least_squares_against_elimination_by_hand(spark):
    """Copies of inputs, indicator columns that add up to one, unknown numbers, and known tail probabilities."""
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, (400, 3))
    kind = rng.integers(0, 3, 400)
    y = 2 + x @ [1.0, -2.0, 0.0] + kind * 0.5 + rng.normal(0, 0.3, 400)
    names = ["a", "b", "c", "a again", "kind 0", "kind 1", "kind 2"]
    design = np.column_stack([x, x[:, 0] * 2 - 1, kind == 0, kind == 1, kind == 2]).astype(float)
    rows = [([float(v) for v in u], float(t)) for u, t in zip(design, y)] + [([None] + [1.0] * 6, 3.0), ([1.0] * 7, None), ([float("nan")] * 7, 1.0)]
    frame = spark.createDataFrame(rows, "x array<double>, y double").repartition(6)
    fit = leastsq.LeastSquares.fit(frame, names, F.col("x"), F.col("y"))
    used = [0, 1, 2, 4, 5]
    assert [c is not None for c in fit.coefficients] == [i in used for i in range(7)]
    m = np.column_stack([np.ones(400), design[:, used]])
    want = np.linalg.solve(m.T @ m, m.T @ y)
    rest = ((y - m @ want) ** 2).sum() / (400 - 6)
    errors = np.sqrt(rest * np.diag(np.linalg.inv(m.T @ m)))
    assert np.allclose([fit.intercept, *(fit.coefficients[i] for i in used)], want, atol=1e-7)
    assert np.allclose([fit.t_values[i] for i in used], (want / errors)[1:], rtol=1e-5)
    assert leastsq.LeastSquares.fit(frame.limit(0), names, F.col("x"), F.col("y")).coefficients == (None,) * 7
    for t, freedom, p in ((2.0, 10, 0.07338803477074), (0.0, 5, 1.0), (12.706204736, 1, 0.05), (-1.0, 1, 0.5), (2.228138852, 10, 0.05), (1.96, 1e6, 0.0499958)):
        assert leastsq.two_sided(t, freedom) == pytest.approx(p, rel=2e-4)


def test_parts_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(i, "FD"[i % 2], 2010 + i % 3) for i in range(60)], "id int, pos string, year int")
    store.sink_parts(rows, path, ["pos", "year"])
    store.sink_parts(rows.where("year = 2011 and pos = 'F'").limit(1).withColumn("id", F.col("id") + 1000), path, ["pos", "year"])
    store.sink_parts(rows.where("false"), path, ["pos", "year"])
    got = {(r.pos, r.year): r.n for r in spark.read.parquet(path).groupBy("pos", "year").agg(F.count("*").alias("n")).collect()}
    assert got == {(p, y): 1 if (p, y) == ("F", 2011) else 10 for p in "FD" for y in (2010, 2011, 2012)}
    store.sink_replace(rows.where("year = 2010"), path, ["pos", "year"])
    assert spark.read.parquet(path).count() == 20
