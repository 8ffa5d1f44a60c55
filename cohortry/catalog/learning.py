"""Preparation and models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortry import standin
from cohortry.catalog.aggregates import MOMENTS
from cohortry.catalog.joins import binary_vectors
from cohortry.catalog.projections import stored_frame
from cohortry.catalog.registry import CONFUSION, R, dot_sql, gauss_sql, lloyd_sql, lsq_sql, query, r6, rounded, sql
from cohortry.operators import prepare, resample
from cohortry.operators.metrics import agg_confusion, agg_r2
from cohortry.plans import body, clusters, features as ff, models

TREES = models.BOOST_TREES
LEVELS = clusters.LEVELS
ALL_ADJ = [*ff.ADJUSTED_PARTS, *ff.ADJUSTED_SUMS]


def labelled(s):
    """Marked documents with their length as the only numeric input."""
    return s.table("labels").join(s.table("documents").select("doc_id", "n_chars"), "doc_id")


def class_rows(s):
    """Stored ``id, vec, label`` rows of the training frame."""
    def build():
        frame = stored_frame(s)
        scaled = prepare.Standardiser.fit(frame, ff.SCALED_CLASS).transform(frame)
        return scaled.select(F.col("player_id").alias("id"), F.array(*NB_INPUTS).alias("vec"), F.col("classifier2").alias("label"))

    return s.staged("class_rows", build)


def as_vectors(rows):
    return rows.select("id", array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"))


@query("feat_frame_train", sql(["frame_k"], f"""
    select player_id, height, weight, age, pos, country, league_id17, league_id18, g_gp17, a_gp17, g_gp18, a_gp18,
      {', '.join(f'{R(c)} as {c}' for c in ALL_ADJ)}, wjc_18, wjc_20, clusters50, clusters100, clusters200,
      classifier1, classifier2, classifier3, p_gp, g_gp, a_gp from frame_k"""))
def _(s):
    return rounded(stored_frame(s, clustered=True), *ALL_ADJ)


@query("feat_frame_cohort", sql(["cohort_k"], f"""
    select player_id, height, weight, age, age1, pos, country, league_id17, league_id18, g_gp17, a_gp17, g_gp18, a_gp18,
      {', '.join(f'{R(c)} as {c}' for c in ALL_ADJ)}, wjc_18, wjc_20, clusters50, clusters100, clusters200,
      classifier1, classifier2, classifier3, p_gp, g_gp, a_gp from cohort_k"""))
def _(s):
    return rounded(stored_frame(s, mode="cohort", clustered=True), *ALL_ADJ)


def cluster_rates(s, pos: str = "F"):
    return s.rates(pos)


@query("feat_frame_cluster", sql(["rates"], f"select player_id, {', '.join(f'{R(c)} as {c}' for c in clusters.RATE_COLUMNS)} from rates"))
def _(s):
    return rounded(cluster_rates(s), *clusters.RATE_COLUMNS)


@query("ml_impute_median", sql(["cohort"], f"""
    select player_id, {R('coalesce(adj_p_a17, (select median(adj_p_a17) from cohort))')} as adj_p_a17 from cohort"""))
def _(s):
    filled = prepare.ml_impute_median(stored_frame(s, mode="cohort"), "adj_p_a17", "player_id")
    return rounded(filled.select("player_id", "adj_p_a17"), "adj_p_a17")


@query("ml_split", """
    select doc_id, row_number() over (order by md5(doc_id || ':0')) <= ceil(0.3 * count(*) over ()) as is_test from documents""")
def _(s):
    return prepare.ml_split(s.table("documents").select("doc_id"), "doc_id")


@query("ml_split_stratified", """
    select doc_id, toxic, row_number() over (partition by toxic order by md5(doc_id || ':0')) <= ceil(0.3 * count(*) over (partition by toxic)) as is_test
    from labels""")
def _(s):
    return prepare.ml_split(s.table("labels").select("doc_id", "toxic"), "doc_id", by=["toxic"])


# The counterpart lays all rows of a class beside the line positions it fills, sorted by fold.
@query("ml_folds", """
    with line as (select quality, row_number() over (order by quality) - 1 as spot from labels),
    slots as (select quality, spot % 3 as fold, row_number() over (partition by quality order by spot % 3, spot) as r from line),
    ranked as (select doc_id, quality, row_number() over (partition by quality order by md5(doc_id || ':0')) as r from labels)
    select doc_id, k.quality, cast(fold as int) as fold from ranked k join slots s on s.quality = k.quality and s.r = k.r""")
def _(s):
    return prepare.ml_folds(s.table("labels").select("doc_id", "quality"), "doc_id", "quality")


@query("ml_standardise", sql(["frame"], "select player_id, " + ", ".join(
    f"{R(f'({c} - (select avg({c}) from frame)) / (select stddev_pop({c}) from frame)', 5)} as {c}" for c in MOMENTS) + " from frame"))
def _(s):
    frame = stored_frame(s)
    scaled = prepare.Standardiser.fit(frame, MOMENTS).transform(frame)
    return scaled.select("player_id", *[F.round(c, 5).alias(c) for c in MOMENTS])


@query("ml_onehot", sql(["frame"], " union all ".join(
    f"select f.player_id, '{c}' as feature, v.category, cast(cast(f.{c} as varchar) = v.category as int) as hot "
    f"from frame f, (select distinct cast({c} as varchar) as category from frame) v" for c in ff.CATEGORICAL)))
def _(s):
    frame = stored_frame(s).select("player_id", *ff.CATEGORICAL)
    return prepare.OneHot(ff.CATEGORICAL).fit(frame).long_form(frame, "player_id")


@query("ml_select_importance")
def _(s):
    rows = as_vectors(class_rows(s))
    weights = models.ml_select_importance(rows, "label", TREES, features="features")
    return s.spark.createDataFrame([(i, w, w >= models.IMPORTANCE_MIN) for i, w in enumerate(weights)], "feature int, weight double, kept boolean")


NB_INPUTS = ["height", "weight", "age", "adj_p_a17", "adj_p_a18", "wjc_18", "wjc_20"]
NB_SCALED = ", ".join(f"({c} - (select avg({c}) from frame)) / (select stddev_pop({c}) from frame) as {c}" for c in NB_INPUTS)


@query("ml_select_coef", sql(["frame"], f"""
    , z as (select classifier2, {NB_SCALED} from frame), {lsq_sql("z", NB_INPUTS, "classifier2")}
    select i as feature, {R('answer[i + 2]')} as weight, abs(answer[i + 2]) >= {models.COEFFICIENT_MIN} as kept
    from fit, (select cast(unnest(range(0, 7)) as int) as i) t"""))
def _(s):
    weights = models.ml_select_coef(as_vectors(class_rows(s)), "label", NB_INPUTS, features="features")
    rows = [(i, w, abs(w) >= models.COEFFICIENT_MIN) for i, w in enumerate(weights)]
    return rounded(s.spark.createDataFrame(rows, "feature int, weight double, kept boolean"), "weight")


def _predicted(df):
    return df.select("id", F.col("label").cast("int").alias("label"), F.col("prediction").cast("int").alias("prediction"))


@query("ml_gbt")
def _(s):
    rows = as_vectors(class_rows(s))
    return _predicted(models.booster(TREES).fit(rows).transform(rows))


@query("ml_gaussian_nb", sql(["frame"], f"""
    , long as ({' union all '.join(f"select player_id as id, classifier2 as label, '{c}' as name, cast({c} as double) as v from frame" for c in NB_INPUTS)}),
    shape as (select label as c, name, avg(v) as m, var_pop(v) as s from long group by label, name),
    prior as (select classifier2 as c, ln(count(*)) as lp from frame group by classifier2),
    score as (select id, label, p.c, any_value(lp) + sum(-0.5 * ln(2 * pi() * s) - (v - m) * (v - m) / (2 * s)) as score
      from long l join shape h on h.name = l.name join prior p on p.c = h.c group by id, label, p.c)
    select id, label, c as prediction from score qualify row_number() over (partition by id order by score desc, c) = 1"""))
def _(s):
    rows = as_vectors(class_rows(s))
    return _predicted(models.CLASSIFIERS["gaussian"]().fit(rows).transform(rows))


@query("nb_params", sql(["vectors"], f"""
    select label, i as feature, {R('avg(v)', 4)} as mean, {R('var_pop(v)', 4)} as variance
    from (select label, unnest(vec) as v, unnest(range(0, len(vec))) as i from vectors) t group by label, i"""))
def _(s):
    rows = s.vectors().select(F.col("label").cast("double").alias("label"), array_to_vector("vec").alias("features"))
    fitted = models.CLASSIFIERS["gaussian"]().fit(rows)
    means, variances = fitted.theta.toArray(), fitted.sigma.toArray()
    # The fitted parameters are one figure per class and input.
    out = [
        (int(c), i, float(means[c, i]), float(variances[c, i])) for c in range(means.shape[0]) for i in range(means.shape[1])
    ]
    frame = s.spark.createDataFrame(out, "label int, feature bigint, mean double, variance double")
    return frame.withColumns({c: F.round(c, 4) for c in ("mean", "variance")})


def _vote(s):
    rows = as_vectors(class_rows(s))
    return models.SoftVote.fit(rows, {"boosted": models.booster(TREES), "gaussian": models.CLASSIFIERS["gaussian"]()}), rows


NB_ROWS = f"nb_rows as (select player_id as id, classifier2 as label, [{', '.join(NB_INPUTS)}]::double[] as u, -1 as fold from (select player_id, classifier2, {NB_SCALED} from frame) t)"


@query("ml_soft_vote", sql(["frame"], f"""
    , {NB_ROWS}, everyone as (select -2 as f),
    {gauss_sql("nb_rows", "everyone").replace("s.f = e.fold", "s.f = -2")}
    select id, cast(probability > 0.5 as int) as prediction, {R('probability')} as probability from voted"""))
def _(s):
    return rounded(models.gaussian_vote(class_rows(s), len(NB_INPUTS)).select("id", "prediction", "probability"), "probability")


@query("ml_soft_vote_boosted")
def _(s):
    vote, rows = _vote(s)
    return vote.transform(rows).select("id", "prediction", r6("probability").alias("probability"))


SMOTE = f"""
    , minority as (select id, vec from twoclass where label = 1),
    sizes as (select count(*) filter (label = 0) - count(*) filter (label = 1) as missing, count(*) filter (label = 1) as n from twoclass),
    seeds as (select id, vec, row_number() over (order by md5(id || ':0')) as r from minority),
    made as (select id as seed_id, vec as seed_vec, cast(unnest(range(0, missing // n + case when r <= missing % n then 1 else 0 end)) as int) as copy
      from seeds, sizes),
    drawn as (select m.seed_id, k.right_id as neighbour_id, m.copy, seed_vec, b.vec as near_vec,
        ('0x' || substr(md5(concat_ws(':', m.seed_id, k.right_id, m.copy, 0)), 1, 12))::bigint / 281474976710656.0 as lam
      from made m join knn_near k on k.left_id = m.seed_id and k.rank = 1 + m.copy % 5 join minority b on b.id = k.right_id)
    select seed_id, neighbour_id, copy, {R('lam')} as "lambda", i, {R('seed_vec[i + 1] + (near_vec[i + 1] - seed_vec[i + 1]) * lam', 5)} as x
    from (select *, unnest(range(0, len(seed_vec))) as i from drawn) t"""


def _entries(made):
    """One row per entry of each made vector."""
    long = made.select("seed_id", "neighbour_id", "copy", r6("lambda").alias("lambda"), F.posexplode("vec").alias("i", "x"))
    return long.withColumns({"i": F.col("i").cast("bigint"), "x": F.round("x", 5)})


@query("ml_smote", sql(["twoclass", "knn_near"], SMOTE))
def _(s):
    made = resample.ml_smote(binary_vectors(s), "label", variant="plain")
    return _entries(made)


# A fixed separator through the origin for vectors of 64 entries, shifted so that its margin takes one side.
BORDER = [((7 * i) % 5 - 2) / 10 for i in range(64)], 1.0
BORDER_SQL = f"""
    , minority as (select id, vec from fourclass where label = 1),
    line as (select {BORDER[0]}::double[] as w),
    margins as (select id, round({BORDER[1]} + list_sum(list_transform(list_zip(vec, w), lambda z: z[1] * z[2])), {resample.MARGIN_DIGITS}) as margin
      from minority, line),
    votes as (select left_id as id, sum(other) as against from knn_all join margins on id = left_id
      where margin <= {resample.MARGIN} and rank <= {resample.VOTERS} group by left_id),
    seeds as (select v.id, vec, case when 2 * against >= {resample.VOTERS} then 'danger' else 'safe' end as kind,
        row_number() over (order by md5(v.id || ':0')) as r, count(*) over () as n
      from votes v join minority m on m.id = v.id where against < {resample.VOTERS}),
    sizes as (select count(*) filter (label = 0) - count(*) filter (label = 1) as missing from fourclass),
    made as (select id as seed_id, vec as seed_vec, kind, cast(unnest(range(0, missing // n + case when r <= missing % n then 1 else 0 end)) as int) as copy
      from seeds, sizes),
    drawn as (select m.seed_id, k.right_id as neighbour_id, m.copy, kind, seed_vec, b.vec as near_vec,
        ('0x' || substr(md5(concat_ws(':', m.seed_id, k.right_id, m.copy, 0)), 1, 12))::bigint / 281474976710656.0 as lam
      from made m join knn_all k on k.left_id = m.seed_id and k.other = 0 and k.class_rank = 1 + m.copy % 5 join minority b on b.id = k.right_id),
    stepped as (select *, case when kind = 'safe' then -{resample.OUT_STEP} * lam else lam end as step from drawn)
    select seed_id, neighbour_id, copy, kind, {R('step')} as step, i, {R('seed_vec[i + 1] + (near_vec[i + 1] - seed_vec[i + 1]) * step', 5)} as x
    from (select *, unnest(range(0, len(seed_vec))) as i from stepped) t"""


@query("ml_smote_border", sql(["fourclass", "knn_all"], BORDER_SQL))
def _(s):
    rows = s.vectors().withColumn("label", (F.col("label") <= 3).cast("int"))
    made = resample.ml_smote(rows, "label", variant="svm", border=BORDER)
    long = made.select("seed_id", "neighbour_id", "copy", "kind", r6("step").alias("step"), F.posexplode("vec").alias("i", "x"))
    return long.withColumns({"i": F.col("i").cast("bigint"), "x": F.round("x", 5)})


@query("ml_nearmiss", sql(["twoclass", "knn_far"], f"""
    , d as (select left_id as id, {R('avg(distance)')} as m from knn_far where rank <= 3 group by left_id),
    r as (select id, row_number() over (order by m, md5(id || ':0')) as r from d)
    select id, label from twoclass where label = 1
    union all select id, 0 from r where r <= (select count(*) from twoclass where label = 1)"""))
def _(s):
    return resample.ml_nearmiss(binary_vectors(s), "label").select("id", "label")


def folds_sql(rows: str, label: str = "label", key: str = "id") -> str:
    """``folded``: the rows with a stratified fold each."""
    return f"""
      line as (select {label} as y, row_number() over (order by {label}) - 1 as spot from {rows}),
      slots as (select y, cast(spot % 3 as int) as place, row_number() over (partition by y order by spot % 3, spot) as r from line),
      ordered as (select *, row_number() over (partition by {label} order by md5({key} || ':0')) as r from {rows}),
      folded as (select o.* exclude (r, fold), place as fold from ordered o join slots s on s.y = o.{label} and s.r = o.r)"""


@query("ml_cv", sql(["frame"], f"""
    , {NB_ROWS}, {folds_sql("nb_rows")}, held as (select distinct fold as f from folded), {gauss_sql("folded", "held")},
    parts as (select 'fold' || fold as part, label, probability from voted), {CONFUSION.strip()}"""))
def _(s):
    return rounded(models.ml_cv(class_rows(s), imb=0, voters="gaussian", width=len(NB_INPUTS)), "accuracy", "precision", "recall", "f1")


@query("ml_cv_boosted")
def _(s):
    return rounded(models.ml_cv(class_rows(s), imb=2, trees=TREES), "accuracy", "precision", "recall", "f1")


@query("ml_kmeans", sql(["clusters"], "select player_id, clusters50, clusters100, clusters200 from clusters"))
def _(s):
    centres = clusters.lloyd(cluster_rates(s), LEVELS, seed=1)
    return clusters.lloyd_assign(cluster_rates(s), centres).select("player_id", *[f"clusters{k}" for k in LEVELS])


# Fixed centres: the mean vector of each label, so that both engines start from the same table.
@query("ml_kmeans_assign", sql(["vectors"], f"""
    , parts as (select id, label, unnest(vec) as v, unnest(range(0, len(vec))) as i from vectors),
    means as (select label, i, {R('avg(v)')} as m from parts group by label, i),
    gaps as (select p.id, m.label as cluster, {R('sum((p.v - m.m) * (p.v - m.m))')} as gap from parts p join means m on m.i = p.i group by p.id, m.label)
    select id, cluster, {R('gap', 4)} as gap from gaps qualify row_number() over (partition by id order by gap, cluster) = 1"""))
def _(s):
    points = s.vectors()
    parts = points.select("label", F.posexplode("vec").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg("v"), 6).alias("m"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"])
    centres = parts.groupBy(F.col("label").alias("centre")).agg(ordered.alias("vec"))
    return clusters.nearest_centre(points.select("id", "vec"), centres).select("id", "cluster", F.round("gap", 4).alias("gap"))


@query("ml_elbow", sql(["rates"], f"""
    , near as ({lloyd_sql(clusters.ELBOW_GRID, 0)})
    select level as k, {R(f"sum(gap) / {float(clusters.GRAIN) ** 2:.1f}")} as cost from near group by level"""))
def _(s):
    return rounded(clusters.ml_elbow(cluster_rates(s)), "cost")


@query("ml_linear", sql(["sss"], f"""
    select {R('regr_slope(p, gp)')} as slope, {R('regr_intercept(p, gp)')} as intercept from sss"""))
def _(s):
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["gp"], outputCol="features").transform(s.season().select("gp", F.col("p").cast("double").alias("p")))
    fitted = models.REGRESSORS["linear"](labelCol="p", solver="normal").fit(rows)
    return rounded(s.spark.createDataFrame([(float(fitted.coefficients[0]), float(fitted.intercept))], "slope double, intercept double"), "slope", "intercept")


OLS_INPUTS = ["height", "weight", "adj_p_a17", "adj_p_a18"]


# The probability of a larger t is a ratio of integrals of a power of the cosine, here by Simpson's rule.
@query("ml_ols_pvalues", sql(["frame"], f"""
    , {lsq_sql("frame", OLS_INPUTS, "p_gp", intercept=False)},
    tested as (
      select {OLS_INPUTS}[i] as feature, answer[i + 1] as coefficient, freedom, answer[i + 1] / sqrt(rest / freedom * m[i + 1][{len(OLS_INPUTS) + 2} + i + 1]) as t_value
      from fit, (select unnest(range(1, {len(OLS_INPUTS) + 1})) as i) k),
    angles as (select *, atan(abs(t_value) / sqrt(freedom)) as angle from tested),
    areas as (
      select feature, sum(w * pow(cos(angle * k / 20000), freedom - 1)) * angle / sum(w * pow(cos(pi() / 2 * k / 20000), freedom - 1)) / (pi() / 2) as area
      from angles, (select k, case when k = 0 or k = 20000 then 1 when k % 2 = 1 then 4 else 2 end as w from range(0, 20001) r(k)) r
      group by feature, angle)
    select feature, {R('coefficient')} as coefficient, {R('t_value', 5)} as t_value, {R('1 - area')} as p_value from tested join areas using (feature)"""))
def _(s):
    fitted = rounded(models.ml_ols_pvalues(stored_frame(s), OLS_INPUTS, "p_gp"), "coefficient", "p_value")
    return fitted.withColumn("t_value", F.round("t_value", 5))


def body_models(s):
    training = s.staged("body", lambda: body.body_training_set(s.draft(), s.bios(), s.height_weight()))
    return [body.fit_body(training, var)[0] for var in ("height", "weight")]


BODY_SQL = f"""
    , body0 as (
      select d.player_id, case when length(dob) > 4 then {R("cast(date_diff('day', try_cast(dob as date), cast(d.year || '-09-15' as date)) as double) / 365.25", 2)} end as age0,
        h.height as height0, h.weight as weight0, b.height as height1, b.weight as weight1, case when pos2 = 'D' then 1 else 0 end as pos_flag,
        md5(d.player_id || ':0') as text
      from draft d join bios b on b.player_id = d.player_id join hw h on h.year = d.year and h.ov = d.ov
      where d.year between {body.YEARS[0]} and {body.YEARS[1]}),
    body_cut as (select text as last from (select text, row_number() over (order by text) as r, count(*) over () as n from body0) t where r = ceil(0.3 * n)),
    body_train as (select * from body0, body_cut where text > last), {lsq_sql("body_train", body.INPUTS, "height1", name="tall")}, {lsq_sql("body_train", body.INPUTS, "weight1", name="heavy")},
    projected as (
      select c.* replace ({dot_sql(["age1", "c.height", "c.weight", "(case when pos = 'D' then 1 else 0 end)"], "tall")} as height,
        {dot_sql(["age1", "c.height", "c.weight", "(case when pos = 'D' then 1 else 0 end)"], "heavy")} as weight)
      from cohort c, tall, heavy where age1 is not null)"""


@query("ml_project_body", sql(["cohort", "draft", "hw"], f"{BODY_SQL} select player_id, {R('height')} as height, {R('weight')} as weight from projected"))
def _(s):
    projected = body.ml_project_body(stored_frame(s, mode="cohort"), *body_models(s))
    return rounded(projected.select("player_id", "height", "weight"), "height", "weight")


@query("ml_importances")
def _(s):
    vote, _rows = _vote(s)
    weights = vote.members[0].featureImportances.toArray()
    return s.spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "feature int, weight double")


@query("ml_alternatives")
def _(s):
    rows = as_vectors(class_rows(s))
    parts = []
    for name in models.CLASSIFIERS:
        extra = {"layers": [len(NB_INPUTS), 8, 2], "seed": 0} if name == "perceptron" else {}
        out = models.CLASSIFIERS[name](**extra).fit(rows).transform(rows)
        parts.append(_predicted(out).withColumn("model", F.lit(name)))
    both = parts[0]
    for other in parts[1:]:
        both = both.unionByName(other)
    return rounded(agg_confusion(both, by=["model"]), "accuracy", "precision", "recall", "f1")


@query("ml_alternative_regressors")
def _(s):
    frame = stored_frame(s, labelled_only=True)
    rows = frame.select("player_id", array_to_vector(F.array(*[F.col(c).cast("double") for c in NB_INPUTS])).alias("raw"), "p_gp")
    parts = None
    for scaler in models.SCALERS:
        step = models.SCALERS[scaler](inputCol="raw", outputCol="features")
        scaled = (step.fit(rows) if hasattr(step, "fit") else step).transform(rows)
        for name in models.REGRESSORS if parts is None else ("linear",):
            fitted = models.REGRESSORS[name](labelCol="p_gp").fit(scaled)
            one = agg_r2(fitted.transform(scaled), "p_gp", "prediction").select(F.lit(name).alias("model"), F.lit(scaler).alias("scaler"), "r2")
            parts = one if parts is None else parts.unionByName(one)
    return rounded(parts, "r2")
