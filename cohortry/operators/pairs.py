"""Consecutive-age pairs and how rates carry over between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortry.functions.scalar import safe_div


def join_consecutive(
    season: DataFrame,
    *,
    entity: str = "player_id",
    age: str = "age2",
    category: str = "league_name",
    exposure: str = "gp",
    outcome: str = "p",
    min_exposure: int | None = None,
    same_category: bool = False,
) -> DataFrame:
    """Pairs of season rows of one entity at ages ``a`` and ``a + 1``.

    An entity may have many rows at one age (several teams), and every row of one age
    pairs with every row of the next.  All later steps only add pairs up, so the pairs
    of one entity, age and category combination are returned as a single row with
    ``pairs`` (how many there are) and the sums over them.  Each side is added up
    before the join: a row of one side occurs once per row on the other, so its sums
    are scaled by the other side's count.  The join therefore stays linear however
    many rows an entity has at one age.  Pairs within one category need no join at all:
    the sums of an age stand beside those of the next.
    """
    rows = season
    if min_exposure is not None:
        rows = rows.where(F.col(exposure) >= min_exposure)
    rows = rows.where(F.col(age).isNotNull() & F.col(entity).isNotNull())
    if same_category:
        return _same_category(rows, entity, age, category, exposure, outcome)
    side = (
        rows.groupBy(entity, age, category)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.sum(exposure).alias("e"),
            F.sum(outcome).alias("o"),
        )
    )
    first = side.select(
        F.col(entity),
        F.col(age).alias("age0"),
        F.col(category).alias("category0"),
        F.col("rows").alias("rows0"),
        F.col("e").alias("e0"),
        F.col("o").alias("o0"),
    )
    second = side.select(
        F.col(entity),
        (F.col(age) - 1).alias("age0"),
        F.col(category).alias("category1"),
        F.col("rows").alias("rows1"),
        F.col("e").alias("e1"),
        F.col("o").alias("o1"),
    )
    return _scaled(first.join(second, [entity, "age0"]), entity)


def _same_category(rows: DataFrame, entity: str, age: str, category: str, exposure: str, outcome: str) -> DataFrame:
    """Pairs within a category: sums per age, each beside the sums of the age that follows, in one shuffle by entity."""
    sums = rows.where(F.col(category).isNotNull()).groupBy(entity, F.col(category).alias("category0"), F.col(age).alias("age0")).agg(
        F.count(F.lit(1)).alias("rows0"), F.sum(exposure).alias("e0"), F.sum(outcome).alias("o0")
    )
    after = Window.partitionBy(entity, "category0").orderBy("age0")
    named = {"_age1": "age0", "rows1": "rows0", "e1": "e0", "o1": "o0"}
    both = sums.withColumns({new: F.lead(old).over(after) for new, old in named.items()}).where("_age1 = age0 + 1").drop("_age1")
    return _scaled(both.withColumn("category1", F.col("category0")), entity)


def _scaled(pairs: DataFrame, entity: str) -> DataFrame:
    return pairs.select(
        entity,
        "age0",
        (F.col("age0") + 1).alias("age1"),
        "category0",
        "category1",
        (F.col("rows0") * F.col("rows1")).alias("pairs"),
        (F.col("e0") * F.col("rows1")).alias("exposure0"),
        (F.col("o0") * F.col("rows1")).alias("outcome0"),
        (F.col("e1") * F.col("rows0")).alias("exposure1"),
        (F.col("o1") * F.col("rows0")).alias("outcome1"),
    )


def _pair_rates(pairs: DataFrame, keys: Sequence[str | Column], digits: int) -> DataFrame:
    def total(name: str) -> Column:
        return F.round(F.sum(name).cast("double"), digits)

    return (
        pairs.groupBy(*keys)
        .agg(
            F.sum("pairs").alias("n"),
            total("outcome0").alias("_o0"),
            total("exposure0").alias("_e0"),
            total("outcome1").alias("_o1"),
            total("exposure1").alias("_e1"),
        )
        .withColumn("_r0", safe_div("_o0", "_e0"))
        .withColumn("_r1", safe_div("_o1", "_e1"))
        .drop("_o0", "_e0", "_o1", "_e1")
    )


def agg_rate_delta(pairs: DataFrame, keys: Sequence[str], digits: tuple[int, int] = (4, 2)) -> DataFrame:
    """Relative change of the pooled rate from the first age to the second; undefined is 0."""
    rates = _pair_rates(pairs, keys, digits[0])
    change = F.round(safe_div(F.col("_r1") - F.col("_r0"), F.col("_r0")), digits[1])
    return rates.select(*keys, "n", F.coalesce(change, F.lit(0.0)).alias("delta"))


def agg_rate_ratio(
    pairs: DataFrame,
    keys: Sequence[str] = ("category0", "category1"),
    min_n: int | None = 50,
    digits: tuple[int, int] = (4, 2),
) -> DataFrame:
    """Pooled rate at the second age over the pooled rate at the first; undefined is 0."""
    rates = _pair_rates(pairs, keys, digits[0])
    ratio = F.round(safe_div(F.col("_r1"), F.col("_r0")), digits[1])
    edges = rates.select(*keys, "n", F.coalesce(ratio, F.lit(0.0)).alias("le"))
    return edges if min_n is None else edges.where(F.col("n") >= min_n)
