"""Registration of queries and the shared parts of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cohortry import standin
from cohortry.operators import leastsq
from cohortry.plans import clusters, models
from cohortry.standin import StandIn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
# The same queries on given stand-in tables.
BUILDERS: dict[str, Callable[[StandIn], DataFrame]] = {}


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[StandIn], DataFrame]):
        BUILDERS[name] = build
        QUERIES[name] = lambda spark, sf_dir: build(StandIn(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def R(x: str, k: int = 6) -> str:
    """Half-up rounding of the printed value, the same in both engines."""
    return f"cast(round(cast(cast(({x}) as varchar) as decimal(38,18)), {k}) as double)"


def div(a: str, b: str) -> str:
    return f"(cast({a} as double) / nullif(cast({b} as double), 0))"


A17, A18 = standin.AGES
_DAYS = "date_diff('day', try_cast({dob} as date), cast({to} as date))"


def age_sql(to: str, dob: str = "dob") -> str:
    days = _DAYS.format(dob=dob, to=to)
    return f"case when length({dob}) > 4 then {R(f'cast({days} as double) / 365.25', 2)} end"


def rate_sql(num: str) -> str:
    inner = R(f"cast({num} as double)", 2)
    return R(f"{inner} / nullif(cast(gp as double), 0)", 2)


def lloyd_sql(levels, seed: int, rounds: int = clusters.ROUNDS) -> str:
    """``player_id, level, centre, gap``: nearest centres after that many rounds, each round a relation of its own."""
    grain, weights = clusters.GRAIN, clusters.AGE_WEIGHTS
    far = " + ".join(f"{w} * (p[{i}] - c[{i}]) * (p[{i}] - c[{i}])" for i, w in enumerate(weights, 1))
    means = ", ".join(f"(2 * s{i} + n) // (2 * n)" for i in range(1, 5))
    steps = [f"""
      pts as materialized (select player_id, [{", ".join(f"cast(round({R(c)} * {grain}) as bigint)" for c in clusters.RATE_COLUMNS)}] as p from rates),
      c0 as materialized (
        select level, centre, p as c from (select p, cast(row_number() over (order by md5(player_id || ':{seed}'), p) - 1 as int) as centre from pts) t,
          (values {", ".join(f"({k})" for k in levels)}) v(level) where centre < level)"""]
    for r in range(rounds + 1):
        steps.append(f"""
      n{r} as materialized (
        select player_id, level, best.centre as centre, best.gap as gap from (
          select player_id, level, min({{'gap': cast({far} as bigint), 'centre': centre}}) as best from pts, c{r} group by player_id, level) t)""")
        if r < rounds:
            steps.append(f"""
      c{r + 1} as materialized (
        select c.level, c.centre, coalesce(m.c, c.c) as c from c{r} c left join (
          select level, centre, [{means}]::bigint[] as c from (
            select level, centre, count(*) as n, {", ".join(f"sum(p[{i}]) as s{i}" for i in range(1, 5))}
            from n{r} join pts using (player_id) group by level, centre) t) m on m.level = c.level and m.centre = c.centre)""")
    return f"with {','.join(steps)} select player_id, level, centre, gap from n{rounds}"


def lsq_sql(source: str, inputs: list[str], target: str, intercept: bool = True, masked: str = "", name: str = "fit") -> str:
    """Relations that end in ``name (answer, used, m, freedom, rest)``: normal equations of ``source``, eliminated input after input.

    ``answer`` is a list, the intercept first (0 without).  ``masked``: a relation with a list ``keep`` of the inputs in use.
    """
    k, u = len(inputs) + 1, f"u_{name}"
    entry = "case when {0} then cast({1} as double) else 0 end" if masked else "cast({1} as double)"
    listed = ", ".join(entry.format(f"keep[{i}]", x) for i, x in enumerate(inputs, 1))
    rows = ", ".join("[" + ", ".join(f"sum(u[{i}] * u[{j}])" for j in range(1, k + 2)) + f", {', '.join('1.0' if i == j else '0.0' for j in range(1, k + 1))}]" for i in range(1, k + 1))
    steps = [f"""
      {u} as (select [{"1.0" if intercept else "0.0"}, {listed}, cast({target} as double)]::double[] as u from {source}{", " + masked if masked else ""}
        where {" and ".join(f"{c} is not null" for c in [*inputs, target])}),
      {name}0 as materialized (select [{rows}]::double[][] as m, []::boolean[] as used, [{", ".join(f"sum(u[{i}] * u[{i}])" for i in range(1, k + 2))}] as squares, count(*) as n from {u})"""]
    for i in range(1, k + 1):
        steps.append(f"""
      {name}{i} as materialized (
        select case when m[{i}][{i}] > {leastsq.TOLERANCE} * squares[{i}] then list_transform(m, lambda row, spot: case when spot = {i}
            then list_transform(row, lambda x: x / m[{i}][{i}])
            else list_transform(row, lambda x, j: x - row[{i}] * m[{i}][j] / m[{i}][{i}]) end) else m end as m,
          list_append(used, m[{i}][{i}] > {leastsq.TOLERANCE} * squares[{i}]) as used, squares, n from {name}{i - 1})""")
    steps.append(f"""
      {name} as materialized (
        select list_transform(m, lambda row, spot: case when used[spot] then row[{k + 1}] else 0 end) as answer, used, m,
          n - list_sum(list_transform(used, lambda x: cast(x as int))) as freedom,
          squares[{k + 1}] - list_sum(list_transform(range(1, {k + 1}), lambda spot: case when used[spot] then m[spot][{k + 1}] * f.m0[spot][{k + 1}] else 0 end)) as rest
        from {name}{k}, (select m as m0 from {name}0) f)""")
    return ",".join(steps)


def dot_sql(inputs: list[str], fit: str = "fit") -> str:
    return " + ".join([f"{fit}.answer[1]", *(f"{fit}.answer[{i}] * {x}" for i, x in enumerate(inputs, 2))])


def gauss_sql(rows: str, folds: str, keep: str = "") -> str:
    """``fold, id, label, probability``: the vote of two Gaussian classifiers on inputs dealt in turn.

    ``rows (id, label, u, fold)``; ``folds (f)``: each row of fold f is judged by the models of the rows of other folds.
    ``keep``: a relation with a list of the inputs in use.
    """
    used = f"(select i, cast(row_number() over (order by i) - 1 as int) % 2 as part from {keep}, (select unnest(range(1, 1000)) as i) t where i <= len(keep) and keep[i])" if keep else (
        f"(select i, cast((i - 1) % 2 as int) as part from (select unnest(range(1, 1000)) as i) t where i <= (select max(len(u)) from {rows}))")
    return f"""
      entries as (select id, label, fold, k.i, part, u[k.i] as x from {rows}, {used} k),
      least_spread as (
        select f, part, {models.VARIANCE_SHARE} * max(v) as e from (select f, part, i, var_pop(x) as v from entries, {folds} where fold <> f group by f, part, i) t group by f, part),
      shape as (select s.*, v + e as spread from (
        select f, part, label as c, i, avg(x) as m, var_pop(x) as v from entries, {folds} where fold <> f group by f, part, label, i) s
        join least_spread l on l.f = s.f and l.part = s.part),
      prior as (select f, label as c, ln(count(*) / sum(count(*)) over (partition by f)) as lp from {rows}, {folds} where fold <> f group by f, label),
      score as (
        select e.id, e.label, e.fold, e.part, s.c, any_value(lp) + sum(-0.5 * ln(2 * pi() * spread) - (x - m) * (x - m) / (2 * spread)) as score
        from entries e join shape s on s.f = e.fold and s.part = e.part and s.i = e.i join prior p on p.f = s.f and p.c = s.c group by all),
      chance as (
        select id, label, fold, part, 1 / (1 + exp(least(max(score) filter (c = 0) - max(score) filter (c = 1), 700))) as p from score group by id, label, fold, part),
      voted as (select id, label, fold, avg(p) as probability from chance group by id, label, fold)"""


CONFUSION = f"""
    counted as (select *, count(*) filter (label = 1 and hit) as tp, count(*) filter (label = 0 and hit) as fp,
        count(*) filter (label = 1 and not hit) as fn, count(*) filter (label = 0 and not hit) as tn
      from (select part, label, probability > 0.5 as hit from parts) t group by all),
    summed as (select part, cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, cast(sum(tn) as bigint) as tn from counted group by part)
    select part, tp, fp, fn, tn, {R('coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0)')} as accuracy, {R('coalesce(tp / nullif(tp + fp, 0), 0)')} as precision,
      {R('coalesce(tp / nullif(tp + fn, 0), 0)')} as recall, {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} as f1 from summed"""


# Shared relations in dependency order; each query names the ones it starts from.
PARTS: dict[str, tuple[list[str], str]] = {
    "bios": ([], """
        select c_custkey as player_id,
          case when c_custkey % 10 = 0 then 'G' when c_custkey % 3 = 0 then 'D' else 'F' end as pos2,
          n_name as country,
          case when c_custkey % 97 = 0 then null
               when c_custkey % 41 = 0 then cast(1976 + c_custkey % 6 as varchar)
               else concat(cast(1976 + c_custkey % 6 as varchar), '-', lpad(cast(1 + c_custkey % 12 as varchar), 2, '0'),
                           '-', lpad(cast(1 + c_custkey % 28 as varchar), 2, '0')) end as dob,
          cast(170 + c_custkey % 25 as double) as height, cast(70 + c_custkey % 31 as double) as weight
        from customer join nation on c_nationkey = n_nationkey"""),
    "stats": ([], """
        select o_custkey as player_id,
          concat(cast(year(o_orderdate) - 1 as varchar), '-', cast(year(o_orderdate) as varchar)) as season,
          o_orderpriority as league_name, cast(substr(o_orderpriority, 1, 1) as int) as league_id, o_orderstatus as team,
          count(*) as gp,
          cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as g,
          cast(sum(case when l_returnflag = 'A' then 1 else 0 end) as bigint) as a,
          cast(sum(case when l_returnflag <> 'N' then 1 else 0 end) as bigint) as p
        from orders join lineitem on l_orderkey = o_orderkey
        group by o_custkey, year(o_orderdate), o_orderpriority, o_orderstatus"""),
    "sss": (["bios", "stats"], f"""
        select s.*, {age_sql("concat(right(season, 4), '-09-15')")} as age,
          cast(right(season, 4) as int) - try_cast(left(dob, 4) as int) as age2,
          {rate_sql('g')} as g_gp, {rate_sql('a')} as a_gp, {rate_sql('p')} as p_gp
        from stats s join bios b on s.player_id = b.player_id"""),
    "goalies": (["bios", "stats"], f"""
        select s.player_id, season, team, league_name, league_id, gp,
          {R('cast(p as double) / gp', 2)} as gaa, {R('1 - cast(g as double) / gp', 3)} as svp, dob
        from stats s join bios b on s.player_id = b.player_id where pos2 = 'G'"""),
    "gss": (["goalies"], f"""
        select player_id, season, team, league_name, league_id, gp, gaa, svp,
          {age_sql("concat(right(season, 4), '-09-15')")} as age,
          cast(right(season, 4) as int) - try_cast(left(dob, 4) as int) as age2
        from goalies where length(dob) > 4"""),
    "career": (["bios", "stats"], f"""
        select *, {rate_sql('g')} as g_gp, {rate_sql('a')} as a_gp, {rate_sql('p')} as p_gp from (
          select b.player_id, min(league_name) as league_name, league_id, cast(sum(gp) as bigint) as gp,
            cast(sum(g) as bigint) as g, cast(sum(a) as bigint) as a, cast(sum(p) as bigint) as p
          from stats s join bios b on s.player_id = b.player_id group by b.player_id, league_id) t"""),
    "draft": ([], """
        select c_custkey as player_id, cast(2012 + c_custkey % 7 + again as int) as year, cast(1 + c_custkey % 7 as int) as round,
          cast(2 * c_custkey + again as bigint) as ov, c_mktsegment as team
        from customer, (values (0), (1)) v(again)
        where c_custkey % 4 <> 3 and (again = 0 or c_custkey % 11 = 0)"""),
    "hw": (["bios", "draft"], """
        select year, ov, cast(height - 1 - d.player_id % 3 as int) as height, cast(weight - 4 - d.player_id % 5 as int) as weight, pos2 as pos
        from draft d join bios b on d.player_id = b.player_id"""),
    "pairs": (["sss"], """
        select x.player_id, pos2, x.age2 as age0, y.age2 as age1, x.league_name as l0, y.league_name as l1,
          x.gp as gp0, x.p as p0, y.gp as gp1, y.p as p1
        from sss x join sss y on x.player_id = y.player_id join bios b on b.player_id = x.player_id
        where x.age2 = y.age2 - 1"""),
    "deltas": (["pairs"], f"""
        select l0 as league_name, pos2 as pos, age0, age1, count(*) as n,
          coalesce({R("(r1 - r0) / nullif(r0, 0)", 2)}, 0) as delta
        from (select l0, pos2, age0, age1, player_id,
                sum(p0) over w / nullif(cast(sum(gp0) over w as double), 0) as r0,
                sum(p1) over w / nullif(cast(sum(gp1) over w as double), 0) as r1
              from pairs where l0 = l1 window w as (partition by l0, pos2, age0, age1)) t
        group by l0, pos2, age0, age1, r0, r1"""),
    "points": (["deltas"], """
        select hi.league_name, hi.pos, hi.n, hi.age0, hi.age1, sum(lo.delta) as delta_p_gp
        from deltas hi join deltas lo on hi.league_name = lo.league_name and hi.pos = lo.pos and hi.age0 >= lo.age0
        where hi.n >= 10 group by hi.league_name, hi.pos, hi.n, hi.age0, hi.age1"""),
    "edges": (["pairs"], f"""
        select l0 as src, l1 as dst, count(*) as n,
          coalesce({R(div('sum(p1)', 'sum(gp1)') + ' / nullif(' + div('sum(p0)', 'sum(gp0)') + ', 0)', 2)}, 0) as le
        from pairs where gp0 >= {standin.MIN_GP} and gp1 >= {standin.MIN_GP}
        group by l0, l1 having count(*) >= {standin.EDGE_MIN_N}"""),
    "paths": (["edges"], f"""
        select x.src as start, concat(x.src, '>', x.dst) as path, 2 as nodes, x.le as product
          from edges x where x.dst = '{standin.ANCHOR}'
        union all
        select x.src, concat(x.src, '>', x.dst, '>', y.dst), 3, x.le * y.le
          from edges x join edges y on x.dst = y.src
          where y.dst = '{standin.ANCHOR}' and x.dst <> '{standin.ANCHOR}' and x.src <> x.dst
        union all
        select x.src, concat(x.src, '>', x.dst, '>', y.dst, '>', z.dst), 4, x.le * y.le * z.le
          from edges x join edges y on x.dst = y.src join edges z on y.dst = z.src
          where z.dst = '{standin.ANCHOR}' and x.dst <> '{standin.ANCHOR}' and y.dst <> '{standin.ANCHOR}'
            and x.src <> x.dst and y.src <> y.dst and x.src <> y.dst"""),
    "nodes": (["edges"], "select src as node from edges union select dst from edges"),
    "scores": (["paths", "nodes"], """
        select node, coalesce(avg(product / (nodes * nodes)), 0) as score
        from nodes left join paths on start = node group by node"""),
    "league": (["scores"], f"""
        select node as league_name, score / (select score from scores where node = '{standin.ANCHOR}') as le from scores"""),
    "era": (["sss"], f"""
        select season, y.league_name, {div('t.r', 'y.r')} as era_adj_p_gp
        from (select league_name, season, {div('sum(p)', 'sum(gp)')} as r from sss group by league_name, season) y
        join (select league_name, {div('sum(p)', 'sum(gp)')} as r from sss group by league_name) t
          on t.league_name = y.league_name"""),
    "award_rows": ([], """
        select o_custkey as player_id,
          [7464, 7467, 7471, 230, 149, 223, 999][o_orderkey % 7 + 1] as award_type
        from orders"""),
    "award_counts": (["award_rows"], """
        select player_id,
          cast(count(*) filter (award_type = 7464) as int) as hart, cast(count(*) filter (award_type = 7467) as int) as norris,
          cast(count(*) filter (award_type = 7471) as int) as vezina, cast(count(*) filter (award_type = 230) as int) as first_all_star,
          cast(count(*) filter (award_type = 149) as int) as second_all_star, cast(count(*) filter (award_type = 223) as int) as all_star
        from award_rows group by player_id"""),
    "roster_counts": (["award_counts", "career", "gss"], """
        select r.player_id, coalesce(hart, 0) as hart, coalesce(norris, 0) as norris, coalesce(vezina, 0) as vezina,
          coalesce(first_all_star, 0) as first_all_star, coalesce(second_all_star, 0) as second_all_star, coalesce(all_star, 0) as all_star
        from (select player_id from career where league_name = '1-URGENT' union select player_id from gss where league_name = '1-URGENT') r
        left join award_counts c on c.player_id = r.player_id"""),
    "awards": (["sss", "gss", "roster_counts"], """
        select r.player_id, nullif(count(*) filter (league_name = '1-URGENT'), 0) as wjc_18,
          nullif(count(*) filter (league_name = '2-HIGH' and age2 <= 18), 0) as wjc_20,
          any_value(hart) as hart, any_value(norris) as norris, any_value(vezina) as vezina,
          any_value(first_all_star) as first_all_star, any_value(second_all_star) as second_all_star, any_value(all_star) as all_star
        from (select player_id, league_name, age2 from sss union all select player_id, league_name, age2 from gss) r
        left join roster_counts c on c.player_id = r.player_id group by r.player_id"""),
    "adjusted": (["sss", "league", "era"], """
        select s.*, le, era_adj_p_gp from sss s join league l on s.league_name = l.league_name
        join era e on e.league_name = s.league_name and e.season = s.season"""),
    "weighted": (["adjusted"], f"""
        select player_id, age2, cast(sum(gp) as bigint) as gp, max(age) as age,
          {div('sum(g_gp * era_adj_p_gp * le * gp)', 'sum(gp)')} as ng, {div('sum(a_gp * era_adj_p_gp * le * gp)', 'sum(gp)')} as na
        from adjusted group by player_id, age2"""),
    "adj_wide": (["weighted"], f"""
        select player_id, max(case when age2 = {A17} then ng end) as adj_g_a17, max(case when age2 = {A18} then ng end) as adj_g_a18,
          max(case when age2 = {A17} then na end) as adj_a_a17, max(case when age2 = {A18} then na end) as adj_a_a18,
          max(case when age2 = {A17} then gp end) as adj_gp_a17, max(case when age2 = {A18} then gp end) as adj_gp_a18,
          max(case when age2 = {A18} then age end) as age
        from weighted where age2 in ({A17}, {A18}) group by player_id"""),
    "main_row": (["sss"], """
        select player_id, age2, gp, league_id, g_gp, a_gp from (
          select *, row_number() over (partition by player_id, age2 order by gp desc, league_id, team, season) as rn
          from sss where gp is not null) t where rn = 1"""),
    "raw_wide": (["main_row"], f"""
        select player_id, max(case when age2 = {A17} then league_id end) as league_id17, max(case when age2 = {A18} then league_id end) as league_id18,
          max(case when age2 = {A17} then gp end) as gp17, max(case when age2 = {A18} then gp end) as gp18,
          max(case when age2 = {A17} then g_gp end) as g_gp17, max(case when age2 = {A18} then g_gp end) as g_gp18,
          max(case when age2 = {A17} then a_gp end) as a_gp17, max(case when age2 = {A18} then a_gp end) as a_gp18
        from main_row where age2 in ({A17}, {A18}) group by player_id"""),
    "rates": (["adj_wide", "bios"], f"""
        select w.player_id, adj_g_a17 as g_a17, adj_g_a18 as g_a18, adj_a_a17 as a_a17, adj_a_a18 as a_a18
        from adj_wide w join bios b on b.player_id = w.player_id
        where pos2 = 'F' and try_cast(left(dob, 4) as int) <= {standin.MAX_BIRTH_YEAR} and adj_g_a17 is not null and adj_g_a18 <> 0
          and adj_a_a17 is not null and adj_a_a18 is not null and adj_gp_a18 >= {standin.MIN_GP}"""),
    "clusters": (["rates"], f"""
        select player_id, {", ".join(f"max(centre) filter (level = {k}) as clusters{k}" for k in clusters.LEVELS)}
        from ({lloyd_sql(clusters.LEVELS, 1)}) t group by player_id"""),
    "frame_k": (["frame", "clusters"], f"""
        select f.* replace ({", ".join(f"coalesce(k.clusters{n}, 0) as clusters{n}" for n in clusters.LEVELS)})
        from frame f left join clusters k on k.player_id = f.player_id"""),
    "cohort_k": (["cohort", "clusters"], f"""
        select f.* replace ({", ".join(f"coalesce(k.clusters{n}, 0) as clusters{n}" for n in clusters.LEVELS)})
        from cohort f left join clusters k on k.player_id = f.player_id"""),
    "labels_f": (["career"], f"""
        select player_id, case when gp < 1 then 0 else 1 end as classifier1,
          case when gp <= {standin.LABEL_MIN_GP} or p_gp < {standin.LABEL_MIN_RATE} then 0 else 1 end as classifier2,
          case when gp <= {standin.LABEL_MIN_GP} then 0 else 1 end as classifier3, p_gp, g_gp, a_gp
        from career where league_name = '{standin.ANCHOR}'"""),
    "frame_base": (["bios", "adj_wide", "raw_wide", "awards", "labels_f"], f"""
        select b.player_id, b.height, b.weight, w.age, pos2 as pos, country, dob, league_id17, league_id18, gp17, gp18,
          g_gp17, a_gp17, g_gp18, a_gp18, adj_g_a17, adj_g_a18, adj_a_a17, adj_a_a18,
          coalesce(wjc_18, 0) as wjc_18, coalesce(wjc_20, 0) as wjc_20, 0 as clusters50, 0 as clusters100, 0 as clusters200,
          coalesce(classifier1, 0) as classifier1, coalesce(classifier2, 0) as classifier2, coalesce(classifier3, 0) as classifier3,
          coalesce(p_gp, 0) as p_gp, coalesce(g_gp, 0) as g_gp, coalesce(a_gp, 0) as a_gp
        from bios b join adj_wide w on w.player_id = b.player_id join raw_wide q on q.player_id = b.player_id
        left join awards a on a.player_id = b.player_id left join labels_f f on f.player_id = b.player_id
        where pos2 = 'F' and adj_g_a17 is not null and adj_g_a18 <> 0 and adj_a_a17 is not null and adj_a_a18 is not null
          and w.age is not null and gp18 >= {standin.MIN_GP} and league_id17 is not null and league_id18 is not null"""),
    "frame": (["frame_base"], f"""
        select * exclude (dob, gp17, gp18), adj_g_a17 + adj_a_a17 as adj_p_a17, adj_g_a18 + adj_a_a18 as adj_p_a18
        from frame_base where gp17 >= {standin.MIN_GP} and try_cast(left(dob, 4) as int) <= {standin.MAX_BIRTH_YEAR}"""),
    "cohort": (["frame_base"], f"""
        select * exclude (dob, gp17, gp18), {age_sql("'2019-09-15'")} as age1,
          case when gp17 >= {standin.MIN_GP} then adj_g_a17 + adj_a_a17 end as adj_p_a17, adj_g_a18 + adj_a_a18 as adj_p_a18
        from frame_base where length(dob) > 4 and {age_sql(f"'{standin.COHORT_DATE}'")} >= {standin.COHORT_AGE[0]}
          and {age_sql(f"'{standin.COHORT_DATE}'")} < {standin.COHORT_AGE[1]}"""),
    "vectors": ([], "select vec_id as id, cast(embedding as double[]) as vec, label from embeddings"),
    "twoclass": (["vectors"], "select id, vec, case when label = 3 then 1 else 0 end as label from vectors"),
    "fourclass": (["vectors"], "select id, vec, case when label <= 3 then 1 else 0 end as label from vectors"),
    "knn_all": (["fourclass"], f"""
        select left_id, right_id, other, row_number() over (partition by left_id order by distance, right_id) as rank,
          row_number() over (partition by left_id, other order by distance, right_id) as class_rank
        from (select p.id as left_id, q.id as right_id, 1 - q.label as other,
                {R("sqrt(list_sum(list_transform(list_zip(p.vec, q.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")} as distance
              from fourclass p join fourclass q on p.label = 1 and p.id <> q.id) t"""),
    "knn_far": (["twoclass"], f"""
        select left_id, right_id, distance, row_number() over (partition by left_id order by distance, right_id) as rank
        from (select p.id as left_id, q.id as right_id,
                {R("sqrt(list_sum(list_transform(list_zip(p.vec, q.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")} as distance
              from twoclass p join twoclass q on p.label = 0 and q.label = 1) t"""),
    "knn_near": (["twoclass"], f"""
        select left_id, right_id, distance, row_number() over (partition by left_id order by distance, right_id) as rank
        from (select p.id as left_id, q.id as right_id,
                {R("sqrt(list_sum(list_transform(list_zip(p.vec, q.vec), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))")} as distance
              from twoclass p join twoclass q on p.label = 1 and q.label = 1 and p.id <> q.id) t"""),
    "marked": ([], "select l.doc_id, l.quality, l.toxic, d.n_chars, d.lang from labels l join documents d on d.doc_id = l.doc_id"),
}


def sql(parts: list[str], body: str) -> str:
    """A query on the named shared relations."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in PARTS[name][0]:
            visit(needed)
        if name not in order:
            order.append(name)

    for part in parts:
        visit(part)
    head = ", ".join(f"{name} as ({PARTS[name][1]})" for name in order)
    return f"with {head} {body}" if head else body
