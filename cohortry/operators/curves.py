"""Cumulative curves and closed-form polynomial fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from cohortry.functions.scalar import poly_eval


def running_total(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """Sum of ``value`` over all rows of the group up to and including this ``order``."""
    upto = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(upto))


def aging_curve_points(deltas: DataFrame, min_n: int = 10) -> DataFrame:
    """Cumulative change per category and position.

    The size filter comes after the running total, so sparse ages still count in it.
    """
    total = running_total(deltas, ["league_name", "pos"], "age0", "delta", "delta_p_gp")
    return total.where(F.col("n") >= min_n).select("league_name", "pos", "n", "age0", "age1", "delta_p_gp")


def agg_poly_fit(
    points: DataFrame, keys: Sequence[str], x: str, y: str, min_points: int = 2
) -> DataFrame:
    """Least-squares parabola per group as ``x2, x1, x0``.

    The normal equations are solved in closed form on centred ``x``.  With two distinct
    ``x`` the fit is a line, with one it is the mean of ``y``.
    """
    keys = list(keys)
    rows = points.select(*keys, F.col(x).try_cast("double").alias("_x"), F.col(y).try_cast("double").alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    # The centre only has to be near the data for precision; min and max need no second pass.
    first = rows.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_w"), F.sum("_y").alias("_sy"))
    centre = first.groupBy(*keys).agg(((F.min("_x") + F.max("_x")) / 2).alias("_c"))
    u = F.col("_x") - F.col("_c")
    sums = (
        first.join(centre, keys)
        .withColumn("_u", u)
        .groupBy(*keys)
        .agg(
            F.first("_c").alias("c"),
            F.count(F.lit(1)).alias("distinct_x"),
            F.sum("_w").cast("double").alias("s0"),
            *[F.sum(F.col("_w") * F.pow("_u", F.lit(k))).alias(f"s{k}") for k in range(1, 5)],
            *[F.sum(F.col("_sy") * F.pow("_u", F.lit(k))).alias(f"t{k}") for k in range(3)],
        )
        .where(F.col("s0") >= min_points)
    )
    s0, s1, s2, s3, s4 = (F.col(f"s{k}") for k in range(5))
    t0, t1, t2 = (F.col(f"t{k}") for k in range(3))
    det = s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2)
    a_top = t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0)
    b_top = s4 * (t1 * s0 - t0 * s1) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2)
    line_det = s0 * s2 - s1 * s1
    parabola, line = F.col("distinct_x") >= 3, F.col("distinct_x") == 2
    fitted = sums.select(
        *keys,
        "c",
        "s0", "s1", "s2", "t0",
        F.when(parabola, a_top / F.nullif(det, F.lit(0.0))).otherwise(0.0).alias("a"),
        F.when(parabola, b_top / F.nullif(det, F.lit(0.0)))
        .when(line, (s0 * t1 - s1 * t0) / F.nullif(line_det, F.lit(0.0)))
        .otherwise(0.0)
        .alias("b"),
    ).withColumn("d", (F.col("t0") - F.col("a") * F.col("s2") - F.col("b") * F.col("s1")) / F.col("s0"))
    a, b, c, d = (F.col(n) for n in "abcd")
    return fitted.select(
        *keys,
        a.alias("x2"),
        (b - 2 * a * c).alias("x1"),
        (a * c * c - b * c + d).alias("x0"),
    )


def curve_adjust(rows: DataFrame, curve: DataFrame, keys: Sequence[str], age: str, name: str = "curve") -> DataFrame:
    """Value of each group's stored curve at the row's age; no curve gives NULL."""
    joined = rows.join(curve, list(keys), "left")
    return joined.withColumn(name, poly_eval("x2", "x1", "x0", age)).drop("x2", "x1", "x0")
