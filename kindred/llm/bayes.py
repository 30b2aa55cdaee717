"""Beta-binomial shrinkage fitted to grouped counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RHO = (1e-3, 0.5)  # bounds of the correlation inside a group: concentrations from 1 to 999


def fit_beta(groups: DataFrame) -> tuple[float, float]:
    """(mean, concentration) of the beta prior of groups with columns k of n, by the method of moments.

    With S the weighted spread of the groups' rates, E[S] = p(1-p)((J-1) + rho (N - sum(n^2)/N - (J-1))).
    No observations: the uniform prior.  One row of sums goes to the driver.
    """
    row = groups.where("n > 0").agg(F.count("*").alias("j"), F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum(F.col("k").cast("double") * F.col("k") / F.col("n")).alias("kk")).first()
    if not row.n:
        return 0.5, 2.0
    p, spare = row.k / row.n, row.n - row.n2 / row.n - (row.j - 1)
    if p in (0.0, 1.0) or spare <= 0:
        return (row.k + 1) / (row.n + 2), 1 / RHO[1] - 1 if p not in (0.0, 1.0) else 2.0
    rho = ((row.kk - p * row.k) / (p * (1 - p)) - (row.j - 1)) / spare
    return p, 1 / min(max(rho, RHO[0]), RHO[1]) - 1


def shrunk(k: Column, n: Column, mean: Column | float, concentration: float) -> Column:
    """Posterior mean of a rate."""
    return (k + mean * F.lit(concentration)) / (n + F.lit(concentration))


def bound(k: Column, n: Column, mean: Column | float, concentration: float, z: float) -> Column:
    """z posterior standard deviations above the posterior mean of a rate; below it for z < 0."""
    rate = shrunk(k, n, mean, concentration)
    return rate + F.lit(float(z)) * F.sqrt(rate * (F.lit(1.0) - rate) / (n + F.lit(concentration + 1)))
