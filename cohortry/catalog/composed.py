"""End products."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from cohortry import standin
from cohortry.catalog.aggregates import poly_sql
from cohortry.catalog.learning import BODY_SQL, NB_INPUTS, TREES, body_models, folds_sql
from cohortry.catalog.projections import stored_frame
from cohortry.catalog.registry import CONFUSION, R, dot_sql, gauss_sql, lsq_sql, query, rounded, sql
from cohortry.plans import body, features as ff, models, tables


@query("season_enrich", sql(["sss"], "select player_id, season, team, league_name, league_id, gp, g, a, p, age, age2, g_gp, a_gp, p_gp from sss"))
def _(s):
    return tables.season_enrich(s.stats(), s.bios())


@query("goalie_enrich", sql(["gss"], "select * from gss"))
def _(s):
    return s.goalie_season()


@query("awards_table", sql(["awards"], "select * from awards"))
def _(s):
    return s.awards()


@query("awards_table_strict", sql(["sss", "gss", "roster_counts"], """
    select r.player_id, wjc_18, wjc_20, hart, norris, vezina, first_all_star, second_all_star, all_star
    from (select distinct player_id from sss union all select distinct player_id from gss) r
    left join (select player_id, count(*) as wjc_18 from sss where league_name = '1-URGENT' group by player_id
               union all select player_id, count(*) from gss where league_name = '1-URGENT' group by player_id) j on j.player_id = r.player_id
    left join (select player_id, count(*) as wjc_20 from sss where league_name = '2-HIGH' and age2 <= 18 group by player_id
               union all select player_id, count(*) from gss where league_name = '2-HIGH' and age2 <= 18 group by player_id) u on u.player_id = r.player_id
    left join roster_counts c on c.player_id = r.player_id"""))
def _(s):
    return tables.awards_table(
        s.season(), s.goalie_season(), s.roster_counts(), strict=True, first="1-URGENT", second="2-HIGH"
    )


@query("award_roster", sql(["career", "gss"], f"""
    select player_id from career where league_name = '{standin.ANCHOR}'
    union all select distinct player_id from gss where league_name = '{standin.ANCHOR}'"""))
def _(s):
    return tables.award_roster(s.career(), s.goalie_season(), s.bios(), standin.ANCHOR)


@query("era_adjust", sql(["era"], f"select season, league_name, {R('era_adj_p_gp')} as era_adj_p_gp from era"))
def _(s):
    return rounded(tables.era_adjust(s.season()), "era_adj_p_gp")


@query("league_factor", sql(["league"], f"select league_name, {R('le')} as le from league"))
def _(s):
    return rounded(tables.league_factor(s.season(), s.bios(), standin.ANCHOR, standin.MIN_GP, standin.EDGE_MIN_N), "le")


@query("aging_curve_points", sql(["points"], f"select league_name, pos, n, age0, age1, {R('delta_p_gp')} as delta_p_gp from points"))
def _(s):
    return rounded(tables.curve_points(s.season(), s.bios(), standin.MIN_N), "delta_p_gp")


@query("aging_curve", poly_sql(f"select league_name, pos, {R('x2', 5)} as x2, {R('x1', 5)} as x1, {R('x0', 5)} as x0 from fit"))
def _(s):
    curve = tables.aging_curve(s.season(), s.bios(), standin.MIN_N)
    return curve.withColumns({c: F.round(c, 5) for c in ("x2", "x1", "x0")})


@query("body_training_set", sql(["draft", "bios", "hw"], f"""
    select player_id, case when length(dob) > 4 then {R("cast(date_diff('day', try_cast(dob as date), cast(year || '-09-15' as date)) as double) / 365.25", 2)} end as age0,
      height0, weight0, height1, weight1, pos
    from (select d.player_id, dob, d.year, h.height as height0, h.weight as weight0, b.height as height1, b.weight as weight1, pos2 as pos
          from draft d join bios b on b.player_id = d.player_id join hw h on h.year = d.year and h.ov = d.ov
          where d.year between 2014 and 2018) t"""))
def _(s):
    return body.body_training_set(s.draft(), s.bios(), s.height_weight())


@query("player_clusters", sql(["clusters"], "select player_id, 'F' as pos, clusters50, clusters100, clusters200 from clusters"))
def _(s):
    return s.clusters()


def classification_sql(label: str = "classifier2") -> str:
    """Stratified split, scaled inputs, those selected by a linear fit, and the training rows as ``c_train``."""
    m, sd = ", ".join(f"avg({c}) as m_{c}" for c in NB_INPUTS), ", ".join(f"coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in NB_INPUTS)
    return f"""
      c_split as (select *, row_number() over (partition by {label} order by md5(player_id || ':0')) <= ceil(0.3 * count(*) over (partition by {label})) as is_test from frame),
      c_stats as (select {m}, {sd} from c_split where not is_test),
      c_scaled as (select player_id as id, {label} as label, is_test, {", ".join(f"({c} - m_{c}) / s_{c} as {c}" for c in NB_INPUTS)} from c_split, c_stats),
      c_fit as (select * from c_scaled where not is_test), {lsq_sql("c_fit", NB_INPUTS, "label", name="chosen")},
      c_keep as (
        select case when len(list_filter(k, lambda x: x)) = 0 then list_transform(k, lambda x: true) else k end as keep
        from (select list_transform(answer[2:], lambda x: abs(x) >= {models.IMPORTANCE_MIN}) as k from chosen) t),
      c_rows as (select id, label, is_test, [{", ".join(NB_INPUTS)}]::double[] as u, case when is_test then -1 else -2 end as fold from c_scaled),
      c_train as (select * from c_rows where not is_test)"""


@query("train_eval_classifier", sql(["frame"], f"""
    , {classification_sql()}, {folds_sql("c_train")}, held as (select distinct fold as f from folded), tested as (select -1 as f),
    by_fold as (with {gauss_sql("folded", "held", "c_keep")} select * from voted),
    on_test as (with {gauss_sql("c_rows", "tested", "c_keep")} select * from voted),
    parts as (select 'fold' || fold as part, label, probability from by_fold union all select 'test', label, probability from on_test),
    {CONFUSION.strip()}"""))
def _(s):
    _model, quality, _weights = models.train_eval_classifier(stored_frame(s), imb=0, encode="drop", voters="gaussian")
    return rounded(quality, "accuracy", "precision", "recall", "f1")


@query("train_eval_classifier_boosted")
def _(s):
    _model, quality, _weights = models.train_eval_classifier(stored_frame(s), imb=1, trees=TREES)
    return rounded(quality, "accuracy", "precision", "recall", "f1")


@query("train_eval_classifier_variants")
def _(s):
    """Every label, and every level of clusters as an input."""
    parts = []
    for label, level, adj in ((1, 0, 1), (3, 0, 1), (2, 1, 1), (2, 2, 1), (2, 3, 1), (2, 0, 0)):
        _model, quality, _weights = models.train_eval_classifier(stored_frame(s, clustered=True), adj=adj, clusters=level, label=label, imb=0, voters="gaussian")
        parts.append(quality.select(F.lit(label).alias("label"), F.lit(level).alias("clusters"), F.lit(adj).alias("adj"), "*"))
    return rounded(reduce(DataFrame.unionByName, parts), "accuracy", "precision", "recall", "f1")


def regression_sql(adj: int, target: str, name: str = "fit") -> tuple[str, list[str]]:
    """Split, scaled rows and the two fits of the linear regressor, categories left out; and its inputs."""
    dropped = ff.variant_drop_list(adj, 0, "regr")
    others = [*ff.CATEGORICAL, *ff.ADJUSTED_PARTS, "player_id", *dropped]
    inputs = [c for c in ff.FEATURE_COLUMNS if c not in others]
    scaled = [c for c in inputs if c in ff.SCALED_REGR]
    z = ", ".join(f"({c} - m_{c}) / s_{c} as {c}" if c in scaled else c for c in inputs)
    return f"""
      rows_{name} as (select *, row_number() over (order by md5(player_id || ':0')) <= ceil(0.3 * count(*) over ()) as is_test from frame where classifier3 = 1),
      stats_{name} as (select {", ".join(f"avg({c}) as m_{c}, coalesce(nullif(stddev_pop({c}), 0), 1) as s_{c}" for c in scaled)} from rows_{name} where not is_test),
      z_{name} as (select player_id, is_test, {target} as y, {z} from rows_{name}, stats_{name}),
      train_{name} as (select * from z_{name} where not is_test), {lsq_sql(f"train_{name}", inputs, "y", name=f"all_{name}")},
      sel_{name} as (
        select case when len(list_filter(k, lambda x: x)) = 0 then list_transform(k, lambda x: true) else k end as keep
        from (select list_transform(answer[2:], lambda x: abs(x) >= {models.COEFFICIENT_MIN}) as k from all_{name}) t),
      {lsq_sql(f"train_{name}", inputs, "y", masked=f"sel_{name}", name=name)}""", inputs


def quality_sql(adj: int, target: str, name: str = "fit") -> tuple[str, str]:
    parts, inputs = regression_sql(adj, target, name)
    return parts, f"""
      select count(*) as n, {R("1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))")} as r2
      from (select y, {dot_sql(inputs, name)} as p from z_{name}, {name} where is_test) t"""


PLAIN_REGRESSION = quality_sql(1, "p_gp")


@query("train_eval_regressor", sql(["frame"], f", {PLAIN_REGRESSION[0]} {PLAIN_REGRESSION[1]}"))
def _(s):
    _model, quality, _p, _weights = models.train_eval_regressor(stored_frame(s, labelled_only=True), encode="drop")
    return rounded(quality, "r2")


VARIANTS = [(adj, target) for adj in (1, 0) for target in ff.TARGET_COLUMNS]


@query("train_eval_regressor_variants", sql(["frame"], ", " + ", ".join(quality_sql(a, t, f"fit_{a}_{t}")[0] for a, t in VARIANTS) + " union all ".join(
    f"select {a} as adj, '{t}' as target, n, r2 from ({quality_sql(a, t, f'fit_{a}_{t}')[1]}) q" for a, t in VARIANTS)))
def _(s):
    """Every target, from adjusted and from raw rates."""
    parts = [
        models.train_eval_regressor(stored_frame(s, labelled_only=True), adj=a, target=t, encode="drop")[1].select(F.lit(a).alias("adj"), F.lit(t).alias("target"), "n", "r2")
        for a, t in VARIANTS
    ]
    return rounded(reduce(DataFrame.unionByName, parts), "r2")


READY = {c: "coalesce(adj_p_a17, middle)" if c == "adj_p_a17" else c for c in NB_INPUTS}


COHORT_SCORES = f"""{BODY_SQL}, {classification_sql()}, tested as (select -1 as f),
    c_cohort as (
      select player_id as id, cast(null as int) as label, -1 as fold, [{", ".join(f"({x} - m_{c}) / s_{c}" for c, x in READY.items())}]::double[] as u
      from projected, c_stats, (select median(adj_p_a17) as middle from cohort) t),
    c_both as (select id, label, fold, u from c_train union all select id, label, fold, u from c_cohort), {gauss_sql("c_both", "tested", "c_keep")},
    scored as (select id as player_id, cast(probability > 0.5 as int) as prediction, {R("probability")} as probability from voted)"""


def cohort_scores(s):
    model, _quality, _weights = models.train_eval_classifier(stored_frame(s), imb=0, encode="drop", voters="gaussian")
    scored = models.score_cohort_classifier(stored_frame(s, mode="cohort"), model, *body_models(s))
    return rounded(scored, "probability")


@query("score_cohort_classifier", sql(["frame", "cohort", "draft", "hw"], f"{COHORT_SCORES} select * from scored"))
def _(s):
    return cohort_scores(s)


@query("rank_predictions", sql(["frame", "cohort", "draft", "hw"], f"""{COHORT_SCORES}
    select *, row_number() over (order by prediction desc, probability desc, player_id) as rank from scored"""))
def _(s):
    return models.rank_all(cohort_scores(s))


@query("score_cohort_classifier_boosted")
def _(s):
    model, _quality, _weights = models.train_eval_classifier(stored_frame(s), imb=2, trees=TREES)
    scored = models.score_cohort_classifier(stored_frame(s, mode="cohort"), model, *body_models(s))
    return rounded(scored, "probability")


def scored_sql(adj: int, target: str) -> str:
    """The cohort with the missing rate filled and the body figures projected, scored by the regressor."""
    parts, inputs = regression_sql(adj, target)
    z = [f"(({c} - m_{c}) / s_{c})" if c in ff.SCALED_REGR else "coalesce(adj_p_a17, middle)" if c == "adj_p_a17" else c for c in inputs]
    return sql(["frame", "cohort", "draft", "hw"], f"""{BODY_SQL}, {parts}
      select player_id, {R(dot_sql(z))} as {target} from projected, stats_fit, fit, (select median(adj_p_a17) as middle from cohort) t""")


@query("score_cohort_regressor", scored_sql(1, "p_gp"))
def _(s):
    model, *_rest = models.train_eval_regressor(stored_frame(s, labelled_only=True), encode="drop")
    return rounded(models.score_cohort_regressor(stored_frame(s, mode="cohort"), model, *body_models(s)), "p_gp")


@query("ml_score_cohort", scored_sql(0, "g_gp"))
def _(s):
    """Another target, from the raw rates; as always, trained on labelled rows only."""
    model, *_rest = models.train_eval_regressor(stored_frame(s, labelled_only=True), adj=0, target="g_gp", encode="drop")
    return rounded(models.score_cohort_regressor(stored_frame(s, mode="cohort"), model, *body_models(s), name="g_gp"), "g_gp")
