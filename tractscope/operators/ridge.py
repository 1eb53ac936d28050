"""Ridge regression from sufficient statistics.

One aggregate over the rows gives, per region, the number of rows and the means
and covariances of the numeric features and the label.  They hold everything
the fit needs: the region's one-hot columns are its shares, so the covariance
matrix of all features is put together from them and solved in p x p numbers
on the driver (p = regions + numeric features).  The settings are those of
``model.count_model_pipeline`` and the coefficients equal MLlib's: features
and label standardised (population deviations), an unpenalised intercept, the
penalty ``reg_param / sd(label)`` on the standardised coefficients, a constant
feature gets 0.

Defined cases: rows with a null among the used columns take no part; a region
not seen in training has no one-hot column (prediction from the rest); a
constant label gives zero coefficients and its mean; no rows give None.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The numeric features of the count model, in the assembler's order.
NUMERIC = ("avg_income", "avg_victim_age", "weapon_rate", "Occured_Month", "Occured_Year")


@dataclass(frozen=True)
class Ridge:
    """Coefficients of the one-hot groups, then of the numeric features."""
    group: str
    labels: tuple[str, ...]
    numeric: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    @property
    def names(self) -> list[str]:
        return [f"{self.group}_ohe_{v}" for v in self.labels] + list(self.numeric)


def statistics(df: DataFrame, numeric: Sequence[str] = NUMERIC, label: str = "crime_count", group: str = "spa") -> DataFrame:
    """Per group: ``n``, means ``m<i>`` and population covariances ``c<i>_<j>`` of
    the numeric features and (last) the label, in one aggregate."""
    cols = [*numeric, label]
    q = [f"CAST(`{c}` AS DOUBLE)" for c in cols]
    parts = ["count(*) AS n", *[f"avg({x}) AS m{i}" for i, x in enumerate(q)]]
    parts += [f"covar_pop({q[i]}, {q[j]}) AS c{i}_{j}" for i in range(len(q)) for j in range(i, len(q))]
    return df.na.drop(subset=[group, *cols]).groupBy(group).agg(*[F.expr(p) for p in parts])


def fit(df: DataFrame, numeric: Sequence[str] = NUMERIC, label: str = "crime_count", group: str = "spa",
        reg_param: float = 0.1) -> Ridge | None:
    """The ridge model of ``label``; one row per group comes to the driver."""
    rows = statistics(df, numeric, label, group).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (-r["n"], r[group]))  # one-hot slots by frequency, ties by label
    w = len(numeric) + 1
    n = np.array([r["n"] for r in rows], dtype=np.float64)
    share = n / n.sum()
    mean = np.array([[r[f"m{i}"] for i in range(w)] for r in rows])
    within = np.array([[[r[f"c{min(i, j)}_{max(i, j)}"] for j in range(w)] for i in range(w)] for r in rows])
    center = share @ mean
    gap = mean - center
    between = np.einsum("r,ri,rj->ij", share, gap, gap)
    inner = np.einsum("r,rij->ij", share, within) + between
    g = len(rows)
    cov = np.empty((g + w, g + w))
    cov[:g, :g] = np.diag(share) - np.outer(share, share)
    cov[:g, g:] = share[:, None] * gap
    cov[g:, :g] = cov[:g, g:].T
    cov[g:, g:] = inner
    x, y, sd = cov[:-1, :-1], cov[:-1, -1], np.sqrt(np.maximum(cov[-1, -1], 0.0))
    beta = np.zeros(g + w - 1)
    if sd > 0:
        var = np.diag(x).copy()
        live = var > 1e-18 * np.maximum(1.0, np.concatenate([share, center[:-1] ** 2]))
        beta[live] = np.linalg.solve(x[np.ix_(live, live)] + reg_param / sd * np.diag(var[live]), y[live])
    intercept = center[-1] - beta @ np.concatenate([share, center[:-1]])
    return Ridge(group, tuple(r[group] for r in rows), tuple(numeric), tuple(map(float, beta)), float(intercept))


def predict(df: DataFrame, model: Ridge, out: str = "prediction") -> DataFrame:
    """``df`` with the model's value, one SQL expression."""
    total = F.lit(model.intercept)
    if model.labels:
        hot = F.coalesce(*[F.when(F.col(model.group) == v, F.lit(c)) for v, c in zip(model.labels, model.coefficients)], F.lit(0.0))
        total = total + hot
    for name, c in zip(model.numeric, model.coefficients[len(model.labels):]):
        total = total + F.lit(c) * F.col(name).cast("double")
    return df.withColumn(out, total)


def coefficient_table(df: DataFrame, model: Ridge) -> DataFrame:
    """(feature, coefficient, abs_coef), largest first."""
    rows = [(name, c, abs(c)) for name, c in zip(model.names, model.coefficients)]
    return df.sparkSession.createDataFrame(rows, "feature string, coefficient double, abs_coef double").orderBy(F.desc("abs_coef"), "feature")
