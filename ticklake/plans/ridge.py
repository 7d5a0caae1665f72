"""Ridge regression from a Gram matrix: one aggregation over the rows, small solves on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties that are tried, smallest first.
PENALTIES = (0.0, *(10.0**k for k in range(-6, 3)))


def gram(rows: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n and cells (a, b, g): sums of products of each two columns, upper triangle; one partial aggregation."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs]
    cells = F.array(*(F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.col(f"g{i}_{j}").alias("g")) for i, j in pairs))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums).select(*keys, "n", cells.alias("cells"))


@dataclass(frozen=True)
class Ridge:
    """A fitted model: score = intercept + sum of beta * clip((x - mean) / scale, -20, 20)."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    beta: tuple[float, ...]
    intercept: float
    penalty: float

    def column(self) -> F.Column:
        from ..functions.quotes import standardized

        total = F.lit(float(self.intercept))
        for f, m, s, b in zip(self.features, self.mean, self.scale, self.beta, strict=True):
            total = total + standardized(F.col(f), F.lit(float(m)), F.lit(float(s))) * F.lit(float(b))
        return total


def moments(rows: DataFrame, features: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations; a deviation of 1e-12 or less counts as 1."""
    row = rows.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(features)), *(F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features))).first()
    mean, scale = (np.array([row[f"{x}{i}"] for i in range(len(features))], float) for x in "ms")
    return mean, np.where(scale > 1e-12, scale, 1.0)


def standardised(rows: DataFrame, features: tuple[str, ...], mean: np.ndarray, scale: np.ndarray) -> DataFrame:
    from ..functions.quotes import standardized

    return rows.select("*", *(standardized(F.col(c), F.lit(float(m)), F.lit(float(s))).alias(f"_z{i}") for i, (c, m, s) in enumerate(zip(features, mean, scale, strict=True))))


def matrix(row, size: int) -> np.ndarray:
    g = np.zeros((size, size))
    for c in row.cells:
        g[c.a, c.b] = g[c.b, c.a] = c.g
    return g


def solve(g: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept from the Gram matrix of (1, z..., y): target centred, features penalised, minimum norm at 0."""
    n, k = g[0, 0], len(g) - 2
    zz, zy = g[1:-1, 1:-1], g[1:-1, -1] - g[0, 1:-1] * (g[0, -1] / n)
    return np.linalg.lstsq(zz + penalty * np.eye(k), zy, rcond=1e-12)[0], g[0, -1] / n


def squared_error(g: np.ndarray, beta: np.ndarray, intercept: float) -> float:
    """Mean squared error on the rows behind a Gram matrix of (1, z..., y)."""
    w = np.concatenate([[intercept], beta, [-1.0]])
    return float(w @ g @ w / g[0, 0])


def fit(train: DataFrame, validation: DataFrame, features: tuple[str, ...], target: str = "target", penalties: tuple[float, ...] = PENALTIES) -> Ridge:
    """The penalty with the least validation error (the first of equal ones); mean and scale come from the training rows alone."""
    return fit_groups(train, validation, {"all": features}, target, penalties)["all"]


def fit_groups(train: DataFrame, validation: DataFrame, groups: dict[str, tuple[str, ...]], target: str = "target", penalties: tuple[float, ...] = PENALTIES) -> dict[str, Ridge]:
    """A model for each group of features: every group's Gram matrix is a part of that of all features, which is read once."""
    features = tuple(dict.fromkeys(f for own in groups.values() for f in own))
    mean, scale = moments(train, features)
    names = ("_one", *(f"_z{i}" for i in range(len(features))), target)
    grams = [matrix(gram(standardised(part, features, mean, scale).withColumn("_one", F.lit(1.0)), names).first(), len(names)) for part in (train, validation)]
    out = {}
    for group, own in groups.items():
        places = [features.index(f) for f in own]
        cells = np.ix_(*[[0, *(i + 1 for i in places), len(features) + 1]] * 2)
        fits = []
        for p in penalties:
            beta, intercept = solve(grams[0][cells], p)
            fits.append((squared_error(grams[1][cells], beta, intercept), p, beta, intercept))
        _, p, beta, intercept = min(fits, key=lambda x: x[0])  # the first of equal ones
        out[group] = Ridge(tuple(own), tuple(mean[places].tolist()), tuple(scale[places].tolist()), tuple(beta.tolist()), float(intercept), p)
    return out
