"""Nightly prediction batch: rates, motivation, markets, context, sink rows."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.operators import markets as mk


def predict(targets: DataFrame, history: DataFrame) -> DataFrame:
    """Adjusted rates of target matches (with lam, mu, rho) given all matches as history."""
    mot = ft.motivation_before(history)
    return ft.adjust_rates(ft.attach_sides(targets, mot, ft.SIGNALS, "mot"))


def market_rows(rates: DataFrame) -> DataFrame:
    return mk.long_book(rates.select("match_id", "lam", "mu", "rho"))


def model_version(train: DataFrame, asof: str, xi: float = 0.0018, l2: float = 2.0) -> DataFrame:
    """One row naming the fit: penalties, number of training rows, how many carry xG, day."""
    day = asof[:10].replace("-", "")
    c = train.agg(F.count("*").alias("n"), F.expr("count_if(xg_home IS NOT NULL AND xg_away IS NOT NULL) AS x"))
    return c.selectExpr(f"concat('dc-pooled-l2_{l2}-xi_{xi}-', IF(x > 0, concat('xg', x), 'g'), '-mot-n_', n, '-{day}') AS model_version")


def context_json(df: DataFrame) -> DataFrame:
    """match_id, context: the signals behind a prediction as one document."""
    side = lambda p: "struct(" + ", ".join(f"{p}_{c} AS {c}" for c in ft.SIGNALS) + ")"
    return df.selectExpr("match_id", f"to_json(struct({side('h')} AS home_motivation, {side('a')} AS away_motivation,"
                         " lam AS lambda_home, mu AS lambda_away)) AS context")


def select_targets(matches: DataFrame, now: str, *, ids=None, recent: int | None = None, leagues=None) -> DataFrame:
    """Explicit ids first, else the newest finished ``recent``, else everything still to play."""
    pool = matches.filter(F.col("league").isin(list(leagues))) if leagues else matches
    if ids:
        return pool.filter(F.col("match_id").isin(list(ids)))
    if recent:
        return pool.filter("status = 'finished'").orderBy(F.desc("kickoff"), F.desc("match_id")).limit(recent)
    return pool.filter((F.col("status") != "finished") & (F.col("kickoff") >= F.lit(now).cast("timestamp_ntz")))
