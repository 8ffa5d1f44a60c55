"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.landing import measure_pages
from cohortry.catalog.registry import R, age_sql, div, query, rounded, sql
from cohortry.functions import scalar as fn
from cohortry.operators.curves import curve_adjust
from cohortry.plans import tables
from cohortry.sources.html_tables import table_cells

ROW = ["player_id", "season", "team", "league_name"]
ROW_SQL = "player_id, season, team, league_name"


@query("fn_season_year", sql(["stats"], f"select {ROW_SQL}, right(season, 4) as season_year from stats"))
def _(s):
    return s.stats().select(*ROW, fn.season_year("season").alias("season_year"))


@query("fn_birth_year", sql(["bios"], "select player_id, try_cast(substr(dob, 0, 5) as int) as birth_year from bios"))
def _(s):
    return s.bios().select("player_id", fn.birth_year("dob").alias("birth_year"))


@query("fn_int_age", sql(["sss"], f"select {ROW_SQL}, age2 from sss"))
def _(s):
    rows = s.stats().join(s.bios().select("player_id", "dob"), "player_id")
    return rows.select(*ROW, fn.int_age("season", "dob").alias("age2"))


@query("fn_decimal_age", sql(["sss"], f"select {ROW_SQL}, age from sss"))
def _(s):
    rows = s.stats().join(s.bios().select("player_id", "dob"), "player_id")
    return rows.select(*ROW, fn.season_age("season", "dob").alias("age"))


@query("fn_fixed_date_age", sql(["bios"], f"select player_id, {age_sql(chr(39) + '2019-09-15' + chr(39))} as age1 from bios"))
def _(s):
    return s.bios().select("player_id", fn.age_on("2019-09-15", "dob").alias("age1"))


@query("fn_concat", sql(["draft"], "select player_id, ov, year || '-09-15' as as_of from draft"))
def _(s):
    return s.draft().select("player_id", "ov", F.concat(F.col("year").cast("string"), F.lit("-09-15")).alias("as_of"))


@query("fn_round_ratio", sql(["sss"], f"select {ROW_SQL}, g_gp, a_gp, p_gp from sss"))
def _(s):
    return s.stats().select(*ROW, *[fn.round_ratio(c, "gp").alias(f"{c}_gp") for c in ("g", "a", "p")])


@query("fn_safe_div", sql(["stats"], f"select {ROW_SQL}, {R(div('g', 'a'))} as ratio from stats"))
def _(s):
    return rounded(s.stats().select(*ROW, fn.safe_div("g", "a").alias("ratio")), "ratio")


@query("fn_ifnull", sql(["stats"], f"select {ROW_SQL}, coalesce({R(div('g', 'a'))}, 0) as ratio from stats"))
def _(s):
    return s.stats().select(*ROW, fn.if_null(F.round(fn.safe_div("g", "a"), 6), 0.0).alias("ratio"))


@query("fn_cast_prefix", """
    select event_id, try_cast(left(json_extract_string(props, '$.k'), 4) as int) as prefix from events""")
def _(s):
    return s.table("events").select("event_id", fn.birth_year(fn.json_path("props", "$.k")).alias("prefix"))


@query("fn_to_numeric", """
    select p_partkey, try_cast(regexp_replace(p_brand, '^Brand#', '') as double) as number, try_cast(p_type as double) as none from part""")
def _(s):
    return s.table("part").select(
        "p_partkey", fn.as_double(F.regexp_replace("p_brand", "^Brand#", "")).alias("number"), fn.as_double("p_type").alias("none")
    )


@query("fn_strip", r"select doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') as kept from documents")
def _(s):
    return s.table("documents").select("doc_id", fn.strip("text").alias("kept"))


@query("fn_prefix_test", sql(["draft"], """
    select year, count(*) as body_rows from draft group by year"""))
def _(s):
    return table_cells(measure_pages(s)).groupBy("year").agg(F.count(F.lit(1)).alias("body_rows"))


@query("fn_year4", sql(["stats"], "select distinct season, left(season, 4) as opening from stats"))
def _(s):
    return s.stats().select("season", fn.year_prefix("season").alias("opening")).distinct()


@query("fn_height_cm", """
    select p_partkey, case when p_size < 12 then cast(floor((60 + p_size) * 2.54) as int) end as cm from part""")
def _(s):
    size = F.col("p_size").cast("string")
    text = F.when(F.col("p_size") < 12, F.concat(F.lit("5' "), size, F.lit('"'))).otherwise(F.concat(F.lit("6-"), size))
    return s.table("part").select("p_partkey", fn.height_cm(text).alias("cm"))


@query("fn_weight_kg", """
    select p_partkey, cast(floor((100 + p_size) * 0.453592) as int) as kg from part""")
def _(s):
    return s.table("part").select("p_partkey", fn.weight_kg((100 + F.col("p_size")).cast("string")).alias("kg"))


@query("fn_contains", "select doc_id, contains(text, 'G') as has_g, contains(text, 'the') as has_the from documents")
def _(s):
    return s.table("documents").select("doc_id", F.contains("text", F.lit("G")).alias("has_g"), F.contains("text", F.lit("the")).alias("has_the"))


@query("fn_length", sql(["bios"], "select player_id, length(dob) > 4 as complete from bios"))
def _(s):
    return s.bios().select("player_id", (F.length("dob") > 4).alias("complete"))


@query("fn_fillna_zero", sql(["awards"], """
    select player_id, coalesce(wjc_18, 0) as wjc_18, coalesce(wjc_20, 0) as wjc_20, coalesce(hart, 0) as hart from awards"""))
def _(s):
    return s.awards().select("player_id", "wjc_18", "wjc_20", "hart").fillna(0, subset=["wjc_18", "wjc_20", "hart"])


@query("fn_poly_eval", sql(["sss"], f"select {ROW_SQL}, {R('0.01 * age2 * age2 - 0.4 * age2 + 3.5')} as value from sss"))
def _(s):
    return rounded(s.season().select(*ROW, fn.poly_eval(F.lit(0.01), F.lit(-0.4), F.lit(3.5), "age2").alias("value")), "value")


def _curve_body():
    from cohortry.catalog.aggregates import POLY

    return sql(["points", "sss"], "") + POLY + f"""
        select s.player_id, season, team, s.league_name, pos2 as pos, age2, {R('x2 * age2 * age2 + x1 * age2 + x0', 4)} as curve
        from sss s join bios b on b.player_id = s.player_id left join fit f on f.league_name = s.league_name and f.pos = b.pos2"""


@query("fn_curve_adjust", _curve_body())
def _(s):
    rows = s.season().join(s.bios().select("player_id", F.col("pos2").alias("pos")), "player_id")
    curve = tables.aging_curve(s.season(), s.bios(), standin.MIN_N)
    adjusted = curve_adjust(rows.select(*ROW, "pos", "age2"), curve, ["league_name", "pos"], "age2")
    return adjusted.withColumn("curve", F.round("curve", 4))


@query("fn_json_path", """
    select event_id, cast(json_extract_string(props, '$.k') as int) as k, coalesce(json_extract_string(props, '$.none'), 'absent') as missing from events""")
def _(s):
    return s.table("events").select(
        "event_id", fn.json_path("props", "$.k", "int").alias("k"), fn.json_path("props", "$.none", default="absent").alias("missing")
    )
