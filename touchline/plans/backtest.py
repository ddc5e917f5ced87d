"""Walk-forward back-test: every fold fitted in parallel, rolling calibration, bets and the report's tables."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import settle
from touchline.operators import evaluate as ev
from touchline.operators import fit, rolling, timeline
from touchline.operators import markets as mk
from touchline.operators import odds as od
from touchline.session import stored

# The back-test's schedule, and matches a group needs beyond the training start.
MIN_TRAIN, REFIT_EVERY, LEAST_TESTS = 200, 20, 10
BOOKS = {"1X2": ["1", "X", "2"], "over_under_2.5": ["over", "under"]}
TRUE_ONE = {"1X2": "CASE WHEN ft_home > ft_away THEN 1 WHEN ft_home < ft_away THEN 3 ELSE 2 END",
            "over_under_2.5": "IF(ft_home + ft_away > 2.5D, 1, 2)"}


def numbered(matches: DataFrame, *, pooled: bool, min_train: int, refit_every: int, xg_mode: str = "off") -> DataFrame:
    """Training rows with grp, position and fold on a per-league or one global timeline."""
    t = fit.training_frame(matches, xg_mode).withColumn("grp", F.lit("all") if pooled else F.col("league"))
    x = timeline.with_row_index(t, "kickoff", "match_id", "grp", "idx")
    return x.withColumn("fold", F.expr(timeline.fold_of("idx", min_train, refit_every)))


def walk_forward(matches: DataFrame, *, pooled: bool = False, min_train: int = MIN_TRAIN, refit_every: int = REFIT_EVERY,
                 xi: float = 0.0018, l2: float = 2.0, xg_mode: str = "off") -> DataFrame:
    """Out-of-sample rates of every match past the training start.

    A prediction uses the last fit at or before its position, trained on strictly earlier
    positions; a match with a team the fit has not seen is left out, as is a group too short for LEAST_TESTS tests.
    """
    # numbering is read three times below
    rows = numbered(matches, pooled=pooled, min_train=min_train, refit_every=refit_every, xg_mode=xg_mode)
    rows = stored(rows)
    enough = rows.groupBy("grp").agg(F.max("idx").alias("_last")).filter(F.col("_last") + 1 >= min_train + LEAST_TESTS)
    rows = rows.join(F.broadcast(enough.select("grp")), "grp", "left_semi")  # a row a group: all rows may be one group
    stats = fit.fold_changes(rows, xi, fit.POOLED_FOLDS if pooled else None)
    params = fit.fit_pooled(stats, l2) if pooled else fit.fit_folds(stats, l2)
    return fit.with_fitted_rates(rows.filter("fold >= 0"), params)


def with_books(rated: DataFrame) -> DataFrame:
    """Predictions with ``books``: (market, p, y) of 1X2 and over/under 2.5, and ``seq``, their number in their league."""
    wide = mk.wide_book(rated.select("match_id", "league", "kickoff", "idx", "ft_home", "ft_away", "lam", "mu", "rho"))
    books = ", ".join("struct('{0}' AS market, array({1}) AS p, {2} AS y)".format(m, ", ".join(f"`{m}|{s}`" for s in sel), TRUE_ONE[m]) for m, sel in BOOKS.items())
    x = wide.selectExpr("match_id", "league", "kickoff", "idx", "ft_home", "ft_away", f"array({books}) AS books")
    return timeline.with_row_index(x, "kickoff", "match_id", "league", "seq")


def calibrate(rated: DataFrame, *, minimum: int = rolling.MINIMUM, every: int = rolling.EVERY, window: int = rolling.WINDOW) -> tuple[DataFrame, DataFrame]:
    """(predictions, fits): each prediction and market with its calibrated ``p``, and the temperatures of each league's fits.

    ``idx`` is the clock between refits: the league's own timeline, or the one all leagues share.
    """
    rated = stored(rated)  # numbering reads it twice, and fits may stand behind it
    marked = stored(rolling.refits(with_books(rated), "league", "seq", "idx", minimum, every))
    fits = stored(rolling.temperatures(marked, "league", "seq", window))
    long = marked.select("match_id", "league", "kickoff", "idx", "ft_home", "ft_away", "serves", F.inline("books"))
    return stored(rolling.calibrated(long, fits, "league")), fits


def bets(cal: DataFrame, odds: DataFrame, least: float = 0.0, priority=od.OPENING_PRIORITY) -> DataFrame:
    """One bet per priced selection whose calibrated edge is above ``least``; ``priority`` names opening or closing prices."""
    sel = F.create_map(*[x for m, s in BOOKS.items() for x in (F.lit(m), F.array(*map(F.lit, s)))])[F.col("market")]
    own = cal.select("match_id", "league", "kickoff", "ft_home", "ft_away", "market", "p").hint("merge")  # prices are a row a match, whatever their estimated size
    rows = od.with_prices(own, od.best_prices(odds, priority, tie="first"), list(BOOKS))
    long = rows.select("match_id", "league", "kickoff", "ft_home", "ft_away", "market", "prices", F.inline(F.arrays_zip(sel.alias("selection"), F.col("p").alias("prob"))))
    place = F.array(*[F.lit(f"{m}|{s}") for m, s in mk.book_columns(list(BOOKS))])
    long = long.withColumn("ord", F.array_position(place, F.concat_ws("|", "market", "selection")).cast("int"))
    x = od.priced(long).withColumn("edge", F.expr("prob * odds - 1D")).filter(F.col("edge") > least)
    return x.withColumn("hit", settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away")))


def losses(cal: DataFrame) -> DataFrame:
    """Per league and overall: 1X2 predictions, Brier and log loss."""
    one = cal.filter("market = '1X2'").selectExpr("league", "aggregate(transform(p, (x, i) -> pow(x - IF(i + 1 = y, 1D, 0D), 2D)), 0D, (s, v) -> s + v) AS brier",
                                                  "-ln(greatest(element_at(p, y), 1e-12D)) AS logloss")
    return ev.loss_summary(one)


def reliability(cal: DataFrame) -> DataFrame:
    """The reliability table over all 1X2 selections."""
    return ev.reliability(cal.filter("market = '1X2'").selectExpr("inline(transform(p, (x, i) -> struct(x AS prob, IF(i + 1 = y, 1, 0) AS hit)))"))


def report(cal: DataFrame, fits: DataFrame, placed: DataFrame) -> DataFrame:
    """One row per league (and ``overall``): losses, calibrator fits and last temperatures, bets, and the best ROI over cells of 30 bets."""
    grid = ev.roi_by_threshold(placed, group=["league", "market"])
    bet = placed.rollup("league").agg(F.count("*").alias("bets"), F.avg(settle.pnl(F.col("hit"), F.col("odds"))).alias("roi"), F.grouping("league").alias("g"))
    bet = bet.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("league")).alias("league"), "bets", "roi")
    last = fits.groupBy("league").agg(F.count_if(F.col("market") == "1X2").alias("fits"), *[
        F.max_by(F.when(F.col("market") == m, F.col("T")), F.when(F.col("market") == m, F.col("fit"))).alias(n) for m, n in (("1X2", "t_1x2"), ("over_under_2.5", "t_ou25"))])
    return losses(cal).join(last, "league", "left").join(bet, "league", "left").join(ev.best_roi(grid), "league", "left")
