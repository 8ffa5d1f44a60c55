"""Exact order statistics without gathering a group in one task.

A total order is taken over ``(value, digest)``, the digest being the md5 text of a
seeded key.  Rows are counted per bucket of that order (combined map-side), the
few bucket counts are accumulated, and only the bucket that holds a wanted position
is sorted, after it has been narrowed to a bounded number of rows.  Wide rows never
move: callers compare each row with the cut key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.session import stage

HASH_BUCKETS = 65_536
VALUE_SPLITS = 1_024
SORT_ROWS = 1_000_000
_DIGEST_HEX = 12
_DIGEST_SPAN = float(16**_DIGEST_HEX)


def digest(key: Column | str, seed: int = 0) -> Column:
    """Seeded md5 text of a key: a reproducible shuffle order."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def digest_fraction(text: Column) -> Column:
    """A digest as a number in [0, 1), in the same order as the text."""
    return F.conv(F.substr(text, F.lit(1), F.lit(_DIGEST_HEX)), 16, 10).cast("double") / F.lit(_DIGEST_SPAN)


def _value_buckets(base: DataFrame, splits: int) -> DataFrame:
    """Add ``_b`` and ``_sub``: buckets in value order that no single value can fill.

    The boundaries are approximate quantiles (one bounded array on the driver) and serve
    only to spread the work.  A value that fills several boundaries is heavy; its rows
    are spread over sub-buckets by digest, which is the next key of the order.
    """
    shares = ", ".join(f"{i / splits}D" for i in range(1, splits))
    grid = base.agg(F.expr(f"percentile_approx(_value, array({shares}), {splits * 20})").alias("g")).first()["g"] or [0.0]
    weight = Counter(grid)
    edges = sorted({float("-inf"), *weight, float("inf")})
    placed = Bucketizer(splits=edges, inputCol="_value", outputCol="_b").transform(base)
    heavy = {value: times for value, times in weight.items() if times > 1}
    if not heavy:
        return placed.withColumn("_sub", F.lit(0).cast("bigint"))
    pairs = ", ".join(f"double('{value!r}'), {times}" for value, times in heavy.items())
    spread = F.element_at(F.expr(f"map({pairs})"), F.col("_value"))
    # Bucket b starts at its boundary value, so the heavy rows come first in it.
    sub = F.floor(digest_fraction(F.col("_digest")) * spread)
    return placed.withColumn("_sub", F.coalesce(sub, F.lit(splits).cast("bigint")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which NULL keys meet NULL keys; the left side's keys stay."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(named, same, how).drop(*[f"__{k}" for k in keys])


def _share(x: Column, low: Column, high: Column, parts: int) -> Column:
    """In which of equal parts of ``[low, high]`` a number lies; never falls as it grows."""
    whole = F.coalesce(F.floor((x - low) / F.nullif(high - low, F.lit(0.0)) * parts), F.lit(0))
    halves = F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * parts)
    return F.when(high - low == float("inf"), halves).otherwise(whole)


def _narrow(inside: DataFrame, groups: list[str], most: int, parts: int) -> DataFrame:
    """Leave of each group's rows, by and by, at most ``most`` among which row ``_at`` of the group is.

    Each round cuts a group's span of values into equal parts and keeps the part that holds row ``_at``;
    a group of one value is cut by digest.  The extremes fall into different parts, so every round
    leaves rows out; rows that agree in value and digest are copies and need no more rounds.
    """
    infinite = F.abs("_value") == float("inf")
    finite = F.when(~infinite, F.col("_value"))
    fraction = digest_fraction(F.col("_digest"))
    while True:
        inside = stage(inside, "cut-rows")
        ends = inside.groupBy(*groups).agg(
            F.min(finite).alias("_low"),
            F.max(finite).alias("_high"),
            (F.min("_value") == F.max("_value")).alias("_tied"),
            F.min(fraction).alias("_first"),
            F.max(fraction).alias("_last"),
            F.count(F.lit(1)).alias("_rows"),
        )
        ends = stage(ends, "cut-ends")
        if ends.where((F.col("_rows") > most) & ~(F.col("_tied") & (F.col("_first") == F.col("_last")))).isEmpty():
            return inside
        by_value = (
            F.when(~infinite, _share(F.col("_value"), F.col("_low"), F.col("_high"), parts))
            .when(F.col("_value") < 0, F.lit(-1))
            .otherwise(F.lit(parts + 1))
        )
        by_digest = _share(fraction, F.col("_first"), F.col("_last"), parts)
        placed = null_safe_join(inside, ends.drop("_rows"), groups).withColumn(
            "_part", F.when(F.col("_tied"), by_digest).otherwise(by_value).cast("bigint")
        )
        counts = placed.groupBy(*groups, "_at", "_part").agg(F.count(F.lit(1)).alias("_n"))
        running = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
        held = (
            counts.withColumn("_upto", F.sum("_n").over(running))
            .where("_at > _upto - _n and _at <= _upto")
            .select(*groups, "_part", (F.col("_at") - F.col("_upto") + F.col("_n")).alias("_at"))
        )
        inside = null_safe_join(placed.select(*inside.columns, "_part").drop("_at"), stage(held, "cut-parts"), [*groups, "_part"]).drop("_part")


def order_cuts(
    df: DataFrame,
    key: str,
    positions: Sequence[Callable[[Column], Column]],
    *,
    strata: Sequence[str] = (),
    value: str | None = None,
    seed: int = 0,
    buckets: int = HASH_BUCKETS,
    splits: int = VALUE_SPLITS,
    sort_rows: int = SORT_ROWS,
) -> DataFrame:
    """The rows at given 1-based positions of the order ``(value, digest(key))``.

    ``positions`` map the stratum size to a position.  Returns
    ``strata.., cut_no, n, position, cut_value, cut_digest``; a position of 0 has a NULL key.
    NULL is a stratum of its own; rows whose value is NULL or NaN are not counted.
    A bucket of more than ``sort_rows`` rows is narrowed before it is sorted; copies of a row count
    as one there.
    """
    strata = list(strata)
    base = df.select(
        *strata,
        (F.col(value).cast("double") if value else F.lit(0.0)).alias("_value"),
        digest(key, seed).alias("_digest"),
    )
    if value:
        # Read for the grid, for the counts and for the rows of the bucket: written narrow, once.
        base = stage(base.where(F.col("_value").isNotNull() & ~F.isnan("_value")), "cut-base")
        base = _value_buckets(base, splits)
    else:
        base = base.withColumn("_b", F.floor(digest_fraction(F.col("_digest")) * buckets)).withColumn(
            "_sub", F.lit(0).cast("bigint")
        )

    spot = ["_b", "_sub"]
    counts = base.groupBy(*strata, *spot).agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` (or twice `splits`) rows per stratum reach this window.
    whole = Window.partitionBy(*[F.col(s) for s in strata]) if strata else Window.partitionBy(F.lit(1))
    running = whole.orderBy(*spot).rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.array(
        *[
            F.struct(F.lit(i).alias("cut_no"), p(F.col("n")).cast("bigint").alias("position"))
            for i, p in enumerate(positions)
        ]
    )
    spots = (
        counts.withColumn("_upto", F.sum("_n").over(running))
        .withColumn("n", F.sum("_n").over(whole))
        .select("*", F.explode(wanted).alias("_w"))
        .select("*", "_w.cut_no", "_w.position")
    )
    hit = spots.where(
        (F.col("position") > F.col("_upto") - F.col("_n")) & (F.col("position") <= F.col("_upto"))
    ).select(
        *strata, *spot, "n", "cut_no", "position", (F.col("position") - F.col("_upto") + F.col("_n")).alias("_at"), F.col("_n").alias("_rows")
    )
    # Stored, so that its size is known: a few rows per stratum, normally broadcast.
    hit = stage(hit, "cut-buckets")
    inside = null_safe_join(base, hit.drop("_rows"), [*strata, *spot]).drop(*spot)
    groups = [*strata, "cut_no"]
    if not hit.where(F.col("_rows") > sort_rows).isEmpty():
        inside = _narrow(inside, groups, sort_rows, splits)
    copies = inside.groupBy(*groups, "n", "position", "_at", "_value", "_digest").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*groups).orderBy("_value", "_digest").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        copies.withColumn("_upto", F.sum("_n").over(order))
        .where("_at > _upto - _n and _at <= _upto")
        .select(*groups, "n", "position", F.col("_value").alias("cut_value"), F.col("_digest").alias("cut_digest"))
    )
    return found


def within_cut(value: Column, text: Column, cut_value: Column, cut_digest: Column) -> Column:
    """True for rows at or before the cut key; a missing cut takes nothing."""
    return F.coalesce(
        (value < cut_value) | ((value == cut_value) & (text <= cut_digest)), F.lit(False)
    )


def take_smallest(
    df: DataFrame,
    key: str,
    count: Callable[[Column], Column],
    *,
    strata: Sequence[str] = (),
    value: str | None = None,
    seed: int = 0,
    flag: str = "taken",
) -> DataFrame:
    """Mark the first ``count(n)`` rows per stratum in the order ``(value, digest)``."""
    strata = list(strata)
    cuts = order_cuts(df, key, [count], strata=strata, value=value, seed=seed)
    marked = with_cuts(df, cuts, strata)
    own = F.col(value).cast("double") if value else F.lit(0.0)
    cut = F.col("_cuts")[F.lit(0)]
    hit = within_cut(own, digest(key, seed), cut["cut_value"], cut["cut_digest"])
    return marked.withColumn(flag, hit).drop("_cuts")


def with_cuts(df: DataFrame, cuts: DataFrame, strata: Sequence[str] = ()) -> DataFrame:
    """Attach ``_cuts``, a map of cut number to cut key, to every row.

    The cuts are stored first, so Spark knows their size when it plans: a few rows are
    broadcast and the rows of ``df`` stay where they are, many are joined by shuffle.
    """
    strata = list(strata)
    entry = F.struct(F.col("cut_no"), F.struct("cut_value", "cut_digest"))
    keys = cuts.groupBy(*strata).agg(F.map_from_entries(F.collect_list(entry)).alias("_cuts"))
    if strata:
        return null_safe_join(df, stage(keys, "cuts"), strata, "left")
    return df.withColumn("_cuts", keys.scalar())


def exact_median(df: DataFrame, column: str, key: str, strata: Sequence[str] = ()) -> DataFrame:
    """Interpolated median per stratum: the mean of the two middle rows."""
    known = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")))
    middle = [lambda n: F.floor((n + 1) / 2), lambda n: F.floor(n / 2) + 1]
    cuts = order_cuts(known, key, middle, strata=strata, value=column)
    return cuts.groupBy(*strata).agg(F.avg("cut_value").alias("median"))
