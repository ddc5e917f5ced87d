"""Column expressions for the goal model: rates, Poisson masses, low-score correction."""
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_GOALS = 10
TAU_FLOOR = 1e-10


def rates(attack_h, defence_a, attack_a, defence_h, gamma, delta) -> tuple[Column, Column]:
    """Expected home and away goals of the log-linear strength model."""
    lam = F.exp(attack_h + defence_a + gamma + delta)
    mu = F.exp(attack_a + defence_h + delta)
    return lam, mu


def poisson_pmf(rate: Column, k: int) -> Column:
    # multiply by 1/k! instead of dividing: division is nullable in Spark, products are not
    return F.exp(-rate) * F.pow(rate, F.lit(float(k))) * F.lit(1.0 / math.factorial(k))


def tau(i: int, j: int, lam: Column, mu: Column, rho: Column) -> Column:
    """Dixon-Coles weight of one low-score cell, floored so a cell never goes negative."""
    one = F.lit(1.0)
    cells = {
        (0, 0): one - lam * mu * rho,
        (0, 1): one + lam * rho,
        (1, 0): one + mu * rho,
        (1, 1): one - rho,
    }
    t = cells.get((i, j))
    return one if t is None else F.greatest(t, F.lit(TAU_FLOOR))


def decay_weight(days: Column, xi: float) -> Column:
    return F.exp(F.lit(-xi) * days)


def temperature(p: Column, t: Column, over) -> Column:
    """p^(1/T) rescaled to sum to one over the window ``over`` (one market of one match)."""
    q = F.pow(F.greatest(p, F.lit(1e-12)), F.lit(1.0) / t)
    return q / F.sum(q).over(over)
