"""Sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml import Pipeline
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from cohortry import standin
from cohortry.catalog.registry import R, query, r6, rounded, sql
from cohortry.plans import tables
from cohortry.session import ensure_checkpoint_dir
from cohortry.sources import html_tables, json_pages, tables as store
from cohortry.standin import StandIn

PAGE = 1_000
HTML_PAGE = 200


def draft_pages(s: StandIn, *keep: str) -> DataFrame:
    """Draft pages of at most two thousand picks, with some picks lacking the player."""
    draft = s.draft()
    totals = draft.groupBy("year").agg(F.count(F.lit(1)).alias("total"))
    player = F.when(F.col("player_id") % 53 != 0, F.struct(F.col("player_id").alias("id")))
    item = F.struct(
        player.alias("player"),
        F.concat_ws("-", "year", (F.col("year") + 1)).alias("year"),
        "round",
        F.col("ov").cast("int").alias("overall"),
        F.struct(F.col("team").alias("name")).alias("team"),
    )
    pages = draft.groupBy("year", F.floor(F.col("player_id") / PAGE).alias("page")).agg(F.collect_list(item).alias("data"))
    doc = F.struct(F.struct(F.col("total").alias("totalCount")).alias("metadata"), "data")
    return pages.join(totals, "year").select("year", *keep, F.to_json(doc).alias("raw"))


def _detail(pos2: str = "pos2"):
    pos = F.col(pos2)
    return F.when(F.col("player_id") % 89 == 0, F.lit(None)).when(pos == "G", "G").when(pos == "D", "D/RW").otherwise("LW/C")


DETAIL_SQL = "case when b.player_id % 89 = 0 then null when pos2 = 'G' then 'G' when pos2 = 'D' then 'D/RW' else 'LW/C' end"


def bio_docs(s: StandIn) -> DataFrame:
    rows = s.bios().join(s.table("customer").select(F.col("c_custkey").alias("player_id"), "c_name", "c_mktsegment"), "player_id")
    full = F.when(F.length("dob") > 4, F.col("dob"))
    player = F.struct(
        F.col("player_id").alias("id"),
        F.col("c_name").alias("firstName"),
        F.when(F.col("player_id") % 7 != 0, F.col("c_mktsegment")).alias("lastName"),
        full.alias("dateOfBirth"),
        F.left("dob", F.lit(4)).cast("int").alias("yearOfBirth"),
        F.struct(F.col("country").alias("name")).alias("country"),
        _detail().alias("playerPositionDetailed"),
        F.when(F.col("player_id") % 2 == 0, "L").otherwise("R").alias("shoots"),
        "height",
        F.when(F.col("player_id") % 13 != 0, F.col("weight")).alias("weight"),
    )
    other = F.struct(F.struct((F.col("player_id") + 1).alias("id")).alias("player"))
    data = F.concat_ws(",", F.to_json(F.struct(player.alias("player"))), F.to_json(other))
    return rows.select(F.concat(F.lit('{"data":['), data, F.lit("]}")).alias("raw"))


def stat_docs(s: StandIn) -> DataFrame:
    """One document per entity and season; a few dozen stat lines at most."""
    rows = s.stats().join(s.bios().select("player_id", "pos2"), "player_id")
    goalie = F.col("pos2") == "G"
    gaa = F.round(F.col("p").cast("double") / F.col("gp"), 2)
    svp = F.round(1 - F.col("g").cast("double") / F.col("gp"), 3)
    line = F.struct(
        F.struct(F.col("player_id").alias("id"), _detail().alias("playerPositionDetailed")).alias("player"),
        F.when(F.col("team") == "P", "POSTSEASON").otherwise("REGULAR_SEASON").alias("gameType"),
        F.struct(F.col("season").alias("name")).alias("season"),
        F.struct(F.col("team").alias("name")).alias("team"),
        F.struct(F.col("league_id").alias("id"), F.col("league_name").alias("name")).alias("league"),
        F.col("gp").alias("GP"),
        F.when(F.col("gp") != 1, F.col("g")).alias("G"),
        F.col("a").alias("A"),
        F.col("p").alias("TP"),
        (F.col("g") * 2).alias("PIM"),
        F.when(F.col("gp") % 2 == 0, F.col("g") - F.col("a")).alias("PM"),
        F.when(goalie & (F.col("gp") != 2), gaa).alias("GAA"),
        F.when(goalie, svp).alias("SVP"),
    )
    # A total of four is written as a stored null, which is not the same as a missing key.
    text = F.regexp_replace(F.to_json(line), '"TP":4,', '"TP":null,')
    docs = rows.select("player_id", "season", text.alias("line")).groupBy("player_id", "season").agg(
        F.concat_ws(",", F.collect_list("line")).alias("lines")
    )
    return docs.select(F.concat(F.lit('{"data":['), "lines", F.lit("]}")).alias("raw"))


def member_pages(s: StandIn) -> DataFrame:
    rows = s.stats().select("league_id", "season", "player_id").distinct()
    totals = rows.groupBy("league_id", "season").agg(F.count(F.lit(1)).alias("total"))
    page = F.floor(F.col("player_id") / PAGE).alias("page")
    item = F.struct(F.struct(F.col("player_id").alias("id")).alias("player"))
    pages = rows.groupBy("league_id", "season", page).agg(F.collect_list(item).alias("data"))
    doc = F.struct(F.struct(F.col("total").alias("totalCount")).alias("metadata"), "data")
    return pages.join(totals, ["league_id", "season"]).select("league_id", "season", F.to_json(doc).alias("raw"))


def award_docs(s: StandIn) -> DataFrame:
    """Award documents in parts of bounded size, and empty ones for everyone else."""
    kind = F.element_at(F.array(*[F.lit(k) for k in (*tables.AWARD_TYPES, 999)]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    rows = s.table("orders").select(
        F.col("o_custkey").alias("player_id"), F.floor(F.col("o_orderkey") / PAGE).alias("part"),
        F.struct(F.struct(kind.alias("id")).alias("awardType")).alias("item"),
    )
    docs = rows.groupBy("player_id", "part").agg(F.collect_list("item").alias("awards"))
    doc = F.to_json(F.struct(F.struct("awards").alias("data")))
    everyone = s.table("customer").select(F.col("c_custkey").alias("player_id"))
    return everyone.join(docs.select("player_id", doc.alias("raw")), "player_id", "left")


def measure_pages(s: StandIn) -> DataFrame:
    key = F.col("player_id")
    inches = 65 + key % 12
    feet_text = F.concat(F.floor(inches / 12).cast("string"), F.lit("' "), (inches % 12).cast("string"), F.lit('"'))
    height = F.when(key % 37 == 0, "6-2").otherwise(feet_text)
    cells = [
        F.col("round").cast("string"), (key % 30).cast("string"), F.col("ov").cast("string"), F.col("team"),
        F.concat(F.lit('<a href="#">Name '), key.cast("string"), F.lit("</a>")), F.lit("C"), F.lit("XX"),
        height, (150 + key % 90).cast("string"), F.lit("League"), F.lit("Junior"),
    ]
    row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>\n "), c, F.lit(" </td>")) for c in cells], F.lit("</tr>"))
    pages = s.draft().withColumn("row", row).groupBy("year", F.floor(key / HTML_PAGE).alias("page")).agg(
        F.concat_ws("\n", F.collect_list("row")).alias("rows")
    )
    html = F.concat(
        F.lit('<html><table class="menu"><tbody><tr><td>x</td></tr></tbody></table><table border="0" class="data"><tbody>'
              "<tr><td>Round 1</td><td>y</td></tr><tr></tr>"),
        "rows", F.lit("</tbody></table></html>"),
    )
    return pages.select("year", html.alias("html"))


@query("src_json_draft", sql(["draft"], """
    select case when player_id % 53 = 0 then -1 else player_id end as player_id, year, round, ov, team
    from draft where year between 2013 and 2017"""))
def _(s):
    return json_pages.draft_rows(draft_pages(s), 2013, 2017)


@query("src_json_bios", sql(["bios"], f"""
    select b.player_id, c_name as first_name, case when b.player_id % 7 <> 0 then c_mktsegment end as last_name, dob, country,
      {DETAIL_SQL} as pos, case when b.player_id % 2 = 0 then 'L' else 'R' end as shoots, height,
      case when b.player_id % 13 <> 0 then weight end as weight,
      case when b.player_id % 89 <> 0 then pos2 end as pos2
    from bios b join customer on c_custkey = b.player_id"""))
def _(s):
    return json_pages.bio_rows(bio_docs(s))


@query("src_json_skater", sql(["bios", "stats"], """
    select s.player_id, season, team, league_name, league_id, gp, g, a, case when p <> 4 then p end as p, 2 * g as pim,
      case when gp % 2 = 0 then g - a end as plus_minus
    from stats s join bios b on b.player_id = s.player_id
    where pos2 <> 'G' and s.player_id % 89 <> 0 and team <> 'P' and gp <> 1"""))
def _(s):
    return json_pages.skater_rows(stat_docs(s))


@query("src_json_goalie", sql(["goalies"], """
    select player_id, season, team, league_name, league_id, gp, gaa, svp
    from goalies where player_id % 89 <> 0 and team <> 'P' and gp <> 2"""))
def _(s):
    return json_pages.goalie_rows(stat_docs(s))


@query("src_json_league_members", sql(["stats"], "select distinct league_id, season, player_id from stats"))
def _(s):
    return json_pages.member_rows(member_pages(s), ["league_id", "season"])


@query("src_json_awards", sql(["award_counts"], """
    select c_custkey as player_id, coalesce(hart, 0) as hart, coalesce(norris, 0) as norris, coalesce(vezina, 0) as vezina,
      coalesce(first_all_star, 0) as first_all_star, coalesce(second_all_star, 0) as second_all_star, coalesce(all_star, 0) as all_star
    from customer left join award_counts on player_id = c_custkey"""))
def _(s):
    per_doc = json_pages.award_counts(award_docs(s))
    return per_doc.groupBy("player_id").agg(*[F.sum(n).alias(n) for n in tables.AWARD_TYPES.values()])


@query("src_html_table", sql(["draft"], """
    select cast(round as varchar) as round, cast(player_id % 30 as varchar) as pick, ov, team, concat('Name ', cast(player_id as varchar)) as name,
      'C' as pos, 'XX' as country, case when player_id % 37 <> 0 then cast(floor((65 + player_id % 12) * 2.54) as int) end as height,
      cast(floor((150 + player_id % 90) * 0.453592) as int) as weight, 'League' as league_name, 'Junior' as junior_team, year
    from draft"""))
def _(s):
    return html_tables.measure_rows(measure_pages(s))


@query("src_union_years", sql(["draft"], "select * from draft"))
def _(s):
    path = _fresh(s, "years")
    store.sink_replace(s.draft(), path, ["year"])
    return html_tables.read_years(s.spark, path).select(s.draft().columns)


# The pages of 2013 are landed twice, the first page of 2015 is missing.
@query("src_page_merge", sql(["draft"], f"""
    , paged as (select *, floor(player_id / {PAGE}) as page, count(*) over (partition by year) as total from draft),
    landed as (select * from paged where not (year = 2015 and page = 0))
    select year, count(distinct page) * case when year = 2013 then 2 else 1 end as pages,
      count(*) * case when year = 2013 then 2 else 1 end as rows_read, count(distinct cast(ov as int)) as distinct_rows,
      max(total) as total_count, count(distinct ov) >= max(total) as complete
    from landed group by year"""))
def _(s):
    pages = draft_pages(s, "page")
    landed = pages.where("not (year = 2015 and page = 0)").unionByName(pages.where("year = 2013"))
    return json_pages.merge_pages(landed.drop("page"), ["year"], json_pages.DRAFT_PAGE, "overall")


@query("src_table", sql(["sss"], "select player_id, season, gp, p from sss"))
def _(s):
    s.season().createOrReplaceTempView("cohortry_season")
    return store.src_table(s.spark, "cohortry_season", ["player_id", "season", "gp", "p"])


@query("src_param_query", sql(["points"], f"""
    select league_name, pos, age0, n, {R('delta_p_gp')} as delta_p_gp from points where league_name = '2-HIGH' and pos = 'F'"""))
def _(s):
    points = tables.curve_points(s.season(), s.bios(), standin.MIN_N)
    text = "select league_name, pos, age0, n, round(delta_p_gp, 6) as delta_p_gp from {points} where league_name = :name and pos = :pos"
    return store.src_param_query(s.spark, text, {"name": "2-HIGH", "pos": "F"}, points=points)


def _fresh(s: StandIn, name: str) -> str:
    return f"{ensure_checkpoint_dir(s.spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_replace", sql(["career"], "select player_id, league_id, gp, p from career"))
def _(s):
    path = _fresh(s, "career")
    rows = s.career().select("player_id", "league_id", "gp", "p")
    # What stood there before must go, partitions that the new rows do not have included.
    store.sink_replace(rows.withColumn("league_id", F.col("league_id") + 100), path, ["league_id"])
    store.sink_replace(rows, path, ["league_id"])
    return s.spark.read.parquet(path)


# All years are stored, then one of them anew with fewer rows and other scores.
@query("sink_parts", sql(["draft", "bios"], """
    select d.player_id, pos2 as pos, year, ov, case when year = 2014 then ov else -ov end as score
    from draft d join bios b on b.player_id = d.player_id where year <> 2014 or ov % 4 = 0"""))
def _(s):
    path = _fresh(s, "scores")
    rows = s.draft().join(s.pos().withColumnRenamed("pos2", "pos"), "player_id").select("player_id", "pos", "year", "ov", (-F.col("ov")).alias("score"))
    store.sink_parts(rows, path, ["pos", "year"])
    for pos in ("F", "D", "G"):
        anew = rows.where((F.col("pos") == pos) & (F.col("year") == 2014) & (F.col("ov") % 4 == 0)).withColumn("score", F.col("ov"))
        store.sink_parts(anew, path, ["pos", "year"])
    return s.spark.read.schema(rows.schema).parquet(path)


@query("sink_ctas", sql(["era"], f"select season, league_name, {R('era_adj_p_gp')} as era_adj_p_gp from era"))
def _(s):
    name = f"cohortry_era_{uuid.uuid4().hex[:8]}"
    path = _fresh(s, "era")
    store.sink_ctas(s.era().where("era_adj_p_gp > 1"), name, path)
    store.sink_ctas(s.era(), name, path)
    s.spark.sql(f"drop table {name}")
    return rounded(s.spark.read.parquet(path), "era_adj_p_gp")


# The outcome is the sum of two inputs, so the stored model must give it back exactly.
@query("sink_model", sql(["sss"], "select player_id, season, team, league_name, cast(p as double) as prediction from sss"))
def _(s):
    rows = s.season().where("gp is not null and p is not null")
    model = Pipeline(stages=[
        VectorAssembler(inputCols=["gp", "g", "a"], outputCol="x"), LinearRegression(featuresCol="x", labelCol="p")
    ]).fit(rows)
    path = _fresh(s, "model")
    store.sink_model(model, path)
    again = store.load_model(path).transform(rows)
    return again.select("player_id", "season", "team", "league_name", r6("prediction").alias("prediction"))
