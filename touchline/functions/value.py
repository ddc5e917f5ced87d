"""Price against probability: edge, tag, Kelly stake."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the value rules.
BANKO_MIN_PROB = 0.70
BANKO_MIN_EDGE = 0.03
KOMBINE_MIN_PROB = 0.35
KOMBINE_MAX_PROB = 0.70
KOMBINE_MIN_EDGE = 0.05


def edge(prob: Column, odds: Column) -> Column:
    return prob * odds - F.lit(1.0)


def fair_edge(prob: Column, book_prob: Column, overround: Column) -> Column:
    """Edge over the bookmaker's probability once its margin is taken out."""
    e = prob / (book_prob / overround) - F.lit(1.0)
    return F.when(book_prob.isNull() | (book_prob <= 0), F.lit(0.0)).otherwise(e)


def tag(prob: Column, e: Column) -> Column:
    banko = (prob >= BANKO_MIN_PROB) & (e >= BANKO_MIN_EDGE)
    kombine = (prob >= KOMBINE_MIN_PROB) & (prob < KOMBINE_MAX_PROB) & (e >= KOMBINE_MIN_EDGE)
    return F.when(banko, "banko_value").when(kombine, "kombine_value").otherwise("no_value")


def kelly(prob: Column, odds: Column) -> Column:
    b = odds - F.lit(1.0)
    full = F.greatest(F.lit(0.0), (b * prob - (F.lit(1.0) - prob)) / b)
    return F.when(b <= 0, F.lit(0.0)).otherwise(full)


def kelly_stake(prob: Column, odds: Column, bankroll: Column, fraction: Column) -> Column:
    """Fractional Kelly in currency, half-even at two decimals."""
    return F.bround(bankroll * fraction * kelly(prob, odds), 2)
