"""Time the headline queries and print one JSON line.

Each query is run once to warm up and then three times (``BENCH_RUNS``); the median
counts.  Results go to a no-op sink.  The stand-in tables that several queries start from
are built once and timed by themselves (``inputs``); everything else is built within each
timed run.  ``literal`` holds the same questions asked the
long way round on the same Spark: theta self-join, a query per group, path lists per
node, window and filter, a lookup per round, all pairs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.registry import BUILDERS
from cohortry.catalog.joins import binary_vectors
from cohortry.operators import curves, graph
from cohortry.plans import tables
from cohortry.session import local_session, stage
from cohortry.standin import StandIn

HEADLINE = [
    "season_enrich", "agg_career", "era_adjust", "awards_table", "aging_curve_points", "aging_curve",
    "league_factor", "agg_argmax_row", "feat_frame_train", "src_json_skater", "src_html_table",
    "ml_split_stratified", "ml_impute_median", "agg_cluster_value", "join_frontier", "join_knn", "ml_nearmiss",
]


INPUTS = ("stats", "season", "edges", "league", "era", "rates", "clusters")


def literal_points(s: StandIn):
    s.season().createOrReplaceTempView("b_season")
    s.bios().createOrReplaceTempView("b_bios")
    step = """select a.league_name, pos2, a.age2 as age0, b.age2 as age1, count(*) as n,
        coalesce(round((sum(b.p) / sum(b.gp) - sum(a.p) / sum(a.gp)) / nullif(sum(a.p) / sum(a.gp), 0), 2), 0) as delta
      from b_season a cross join b_season b join b_bios c on c.player_id = a.player_id
      where a.player_id = b.player_id and a.age2 = b.age2 - 1 and a.league_name = b.league_name
      group by a.league_name, pos2, a.age2, b.age2"""
    return s.spark.sql(
        f"""select x.league_name, x.pos2 as pos, x.n, x.age0, x.age1, sum(y.delta) as delta_p_gp from ({step}) x join ({step}) y
        on x.league_name = y.league_name and x.pos2 = y.pos2 and x.age0 >= y.age0 where x.n >= {standin.MIN_N} group by all"""
    )


def literal_curve(s: StandIn):
    points = literal_points(s)
    points.write.format("noop").mode("overwrite").save()
    fits = []
    for league in [r[0] for r in points.select("league_name").distinct().collect()]:
        for pos in ("F", "D"):
            one = points.where((F.col("league_name") == league) & (F.col("pos") == pos))
            fits += curves.agg_poly_fit(one, ["league_name", "pos"], "age1", "delta_p_gp").collect()
    return s.spark.createDataFrame(fits)


def literal_factor(s: StandIn):
    scores = []
    edges = stage(tables.league_edges(s.season(), s.bios(), standin.MIN_GP, standin.EDGE_MIN_N), "edges")
    for node in [r[0] for r in graph.node_list(edges).collect()]:
        for path in graph.join_paths(edges, standin.ANCHOR).where(F.col("start") == node).toLocalIterator():
            scores.append((node, path.product / path.nodes**2))
    return s.spark.createDataFrame(scores, "node string, part double").groupBy("node").agg(F.avg("part"))


def literal_argmax(s: StandIn):
    s.season().createOrReplaceTempView("b_season")
    return s.spark.sql(
        """select player_id, age2, gp, league_id, g_gp, a_gp from (select *, row_number() over (
        partition by player_id, age2 order by gp desc, league_id, team, season) as rn from b_season where gp is not null) where rn = 1"""
    )


def literal_knn(s: StandIn):
    binary_vectors(s).createOrReplaceTempView("b_vectors")
    return s.spark.sql(
        """select * from (select *, row_number() over (partition by left_id order by distance, right_id) as rank from (
        select l.id as left_id, r.id as right_id, round(sqrt(aggregate(zip_with(l.vec, r.vec, (p, q) -> (p - q) * (p - q)), 0D, (a, v) -> a + v)), 6) as distance
        from b_vectors l cross join b_vectors r where l.label = 0 and r.label = 1)) where rank <= 3"""
    )


LITERAL = {
    "aging_curve_points": literal_points,
    "aging_curve": literal_curve,
    "league_factor": literal_factor,
    "agg_argmax_row": literal_argmax,
    "join_knn": literal_knn,
}


def timed(build, runs: int) -> float:
    spent = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        spent.append(time.perf_counter() - start)
    return round(statistics.median(spent[1:]), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    data, inputs = StandIn(spark, folder), {}
    for name in INPUTS:
        start = time.perf_counter()
        getattr(data, name)()
        inputs[name] = round(time.perf_counter() - start, 3)

    def fresh(name: str):
        data.forget((*INPUTS, "rates-F", "clusters-F"))
        return BUILDERS[name](data)

    times = {name: timed(lambda: fresh(name), runs) for name in HEADLINE}
    literal = {} if "--fast" in sys.argv else {name: timed(lambda: build(data), runs) for name, build in LITERAL.items()}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "literal": literal,
                "inputs": inputs,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
