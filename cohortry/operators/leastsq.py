"""Least squares by normal equations.

One pass adds up the products of all pairs of inputs; elimination on that small matrix, input after input, gives the
coefficients and their standard errors.  An input that depends on those before it is left out, so any set of
inputs (indicator columns of every category, copies of a column) has a defined result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: What is left of an input's square sum once the inputs before it are taken out, as a share; less counts as nothing.
TOLERANCE = 1e-9


def products(rows: DataFrame, inputs: Column, target: Column) -> np.ndarray:
    """Sums of ``u_i * u_j`` over all rows, ``u`` being the inputs and the target; rows with an unknown number are left out.

    Each task adds up its own rows; the parts are summed by entry, so the driver gets one matrix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            u = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            part = np.einsum("ni,nj->ij", u, u)
            total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i.astype(np.int32), j.astype(np.int32), total)], ["i", "j", "v"])

    u = rows.select(F.concat(inputs.cast("array<double>"), F.array(target.cast("double"))).alias("u"))
    known = u.where(~F.exists("u", lambda x: x.isNull() | F.isnan(x)))
    sums = known.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    n = 1 + max((r.i for r in sums), default=-1)
    out = np.zeros((n, n))
    for r in sums:
        out[r.i, r.j] = r.v
    return out


def two_sided(t: float, freedom: float) -> float:
    """Probability of a larger absolute t: the regularised incomplete beta function by its continued fraction."""
    x, a, b = freedom / (freedom + t * t), freedom / 2, 0.5
    if x >= 1 or x <= 0:
        return float(x >= 1)
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    out = d
    for m in range(1, 500):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return 1 - front * out if swap else front * out


@dataclass(frozen=True)
class LeastSquares:
    """A fit.  Figures of inputs that depend on earlier ones are None."""

    names: tuple[str, ...]
    coefficients: tuple[float | None, ...]
    t_values: tuple[float | None, ...]
    p_values: tuple[float | None, ...]
    intercept: float

    @classmethod
    def fit(cls, rows: DataFrame, names: Sequence[str], inputs: Column, target: Column, intercept: bool = True) -> "LeastSquares":
        """``inputs`` is an array of one number for each name."""
        k = len(names) + 1
        sums = products(rows, F.concat(F.array(F.lit(1.0)), inputs.cast("array<double>")), target)
        if not len(sums):
            none = (None,) * len(names)
            return cls(tuple(names), none, none, none, 0.0)
        first = sums[:k, :k].copy()
        table = np.hstack([first, sums[:k, k:], np.eye(k)])  # equations, right-hand side, inverse
        used = []
        for i in range(0 if intercept else 1, k):
            if table[i, i] > TOLERANCE * first[i, i]:
                table[i] /= table[i, i]
                factor = table[:, i].copy()
                factor[i] = 0
                table -= np.multiply.outer(factor, table[i])
                used.append(i)
        answer = {i: float(table[i, k]) for i in used}
        freedom = float(first[0, 0]) - len(used)
        rest = max(0.0, float(sums[k, k]) - sum(answer[i] * float(sums[i, k]) for i in used))
        t, p = {}, {}
        for i in used:
            error = math.sqrt(rest / freedom * float(table[i, k + 1 + i])) if freedom > 0 else 0.0
            if error > 0:
                t[i] = answer[i] / error
                p[i] = two_sided(t[i], freedom)
        spread = range(1, k)
        return cls(tuple(names), tuple(answer.get(i) for i in spread), tuple(t.get(i) for i in spread), tuple(p.get(i) for i in spread), answer.get(0, 0.0))

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(self.names, self.coefficients, self.t_values, self.p_values))
        return spark.createDataFrame(rows, "feature string, coefficient double, t_value double, p_value double")
