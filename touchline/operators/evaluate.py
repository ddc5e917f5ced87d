"""Scoring of predictions: accuracy, calibration tables, Brier, log loss, ROI grids.

Grids are never multiplied with the rows: a row is put into its cell first, cells are summed
map-side, and only the small cell table meets the grid.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import naming, settle
from touchline.operators import markets as mk
from touchline.session import literal_rows

# Report bins and thresholds.
ACCURACY_EDGES = [0.50, 0.60, 0.70, 0.80, 0.90, 1.01]
STRATEGY_EDGES = [0.55, 0.65, 0.75, 0.85, 1.01]
# How the bins are shown.
ACCURACY_LABELS = ["50-60%", "60-70%", "70-80%", "80-90%", "90-100%"]
STRATEGY_LABELS = ["55-65%", "65-75%", "75-85%", "85-100%"]
EDGE_THRESHOLDS = [0.0, 0.01, 0.02, 0.03, 0.05, 0.08]
PROB_FLOORS = [0.50, 0.55, 0.60]
MARKET_GROUPS = {
    "1X2": ["1X2"], "DC": ["double_chance"], "OU": ["over_under"], "BTTS": ["btts"],
    "Goals": ["over_under", "btts"], "All": ["1X2", "double_chance", "over_under", "btts"],
}
LEAGUE_GROUPS = {
    "All": None,
    "Big5": ["E0", "D1", "I1", "SP1", "F1"],
    "Small": ["FIN", "POL", "IRL", "SC0", "ROU", "NOR", "SWE", "T1", "AUT", "B1", "DNK", "N1", "P1", "E1"],
}
ARGMAX_MARKETS = ["1X2", "double_chance"] + [f"over_under_{l}" for l in mk.LINES] + ["btts", "odd_even"]


def model_picks(df: DataFrame) -> DataFrame:
    """One row per match and market with the model's likeliest selection (first on ties).

    Works inside the row: the argmax is a CASE over the wide columns, nothing is shuffled.
    """
    keep = [f"`{c}`" for c in df.columns]
    items = []
    for m in ARGMAX_MARKETS:
        sel = [s for _, s in mk.book_columns([m])]
        p = [f"round(`{m}|{s}`, 12)" for s in sel]
        cases = " ".join(
            f"WHEN {' AND '.join(f'{p[i]} >= {q}' for q in p[i + 1:])} THEN '{sel[i]}'" for i in range(len(sel) - 1))
        # a later selection is reached only when something later beat every earlier one
        raw = ", ".join(f"`{m}|{s}`" for s in sel)
        items.append(f"struct(CASE {cases} ELSE '{sel[-1]}' END AS pick, greatest({raw}) AS prob) AS `{m}`")
    items.append("struct(top[0].score AS pick, top[0].p AS prob) AS correct_score")
    wide = mk.wide_book(mk.top_scores(df, 1)).selectExpr(*keep, *items)
    long = wide.unpivot(df.columns, [f"`{m}`" for m in ARGMAX_MARKETS] + ["correct_score"], "market", "_p")
    return long.selectExpr(*keep, "market", "_p.pick AS pick", "_p.prob AS pick_prob")


def accuracy_rows(df: DataFrame) -> DataFrame:
    """model_picks of played matches with the actual outcome and whether the pick hit."""
    m, fh, fa = F.col("market"), F.col("ft_home"), F.col("ft_away")
    return model_picks(df).withColumns({
        "actual": settle.actual_label(m, fh, fa), "hit": settle.hit(m, F.col("pick"), fh, fa)})


def _rates(n: Column, hits: Column, prob: Column):
    return (n.alias("picks"), hits.alias("hits"), (hits / n).alias("hit_rate"), (prob / n).alias("avg_prob"))


def accuracy_summary(rows: DataFrame) -> DataFrame:
    """Per market plus an ``overall`` row."""
    n, hits, prob = F.count("*"), F.count_if("hit"), F.sum("pick_prob")
    g = rows.rollup("market").agg(*_rates(n, hits, prob), F.grouping("market").alias("g"))
    return g.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("market")).alias("market"),
                    "picks", "hits", "hit_rate", "avg_prob")


def _bin_of(p: str, edges) -> str:
    """SQL text: 1-based left-closed bin; null outside the edges."""
    cases = " ".join(f"WHEN {p} >= {edges[i]}D AND {p} < {edges[i + 1]}D THEN {i + 1}" for i in range(len(edges) - 1))
    return f"CASE {cases} END"


def calibration_bins(rows: DataFrame, edges=ACCURACY_EDGES, prob: str = "pick_prob", labels=ACCURACY_LABELS) -> DataFrame:
    """Hits and mean probability per bin; empty bins are kept."""
    inside = rows.filter(f"{prob} >= {edges[0]}D AND {prob} < {edges[-1]}D")
    sums = inside.selectExpr(f"{_bin_of(prob, edges)} AS bin", "hit", f"{prob} AS p").groupBy("bin").agg(
        F.count("*").alias("n"), F.count_if("hit").alias("h"), F.sum("p").alias("s"))
    bins = literal_rows(rows.sparkSession, list(enumerate(labels, 1)), "bin, range")
    j = bins.join(sums, "bin", "left")
    n = F.coalesce("n", F.lit(0))
    return j.select("range", n.alias("picks"), F.coalesce("h", F.lit(0)).alias("hits"),
                    F.coalesce(F.col("h") / F.col("n"), F.lit(0.0)).alias("hit_rate"),
                    F.coalesce(F.col("s") / F.col("n"), F.lit(0.0)).alias("avg_prob"))


def reliability(points: DataFrame, bins: int = 10) -> DataFrame:
    """Equal right-closed bins of (prob, hit 0/1); only observed bins."""
    b = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("prob") * bins))
    g = points.groupBy(b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("prob").alias("predicted"), F.avg(F.col("hit").cast("double")).alias("actual"))
    return g.withColumn("gap", F.col("actual") - F.col("predicted"))


def with_score_losses(wide: DataFrame) -> DataFrame:
    """Brier and log loss of the 1X2 columns of a played match."""
    terms, p_act = [], None
    r = settle.result_1x2(F.col("ft_home"), F.col("ft_away"))
    for s in ("1", "X", "2"):
        p = F.col(f"`1X2|{s}`")
        terms.append(F.pow(p - F.when(r == s, 1.0).otherwise(0.0), 2.0))
        p_act = F.when(r == s, p) if p_act is None else F.coalesce(p_act, F.when(r == s, p))
    return wide.withColumns({"brier": sum(terms[1:], terms[0]), "logloss": -F.ln(F.greatest(p_act, F.lit(1e-12)))})


def loss_summary(scored: DataFrame) -> DataFrame:
    """Per league plus an ``overall`` row."""
    g = scored.rollup("league").agg(F.count("*").alias("n"), F.avg("brier").alias("brier"),
                                    F.avg("logloss").alias("logloss"), F.grouping("league").alias("g"))
    return g.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("league")).alias("league"), "n", "brier", "logloss")


def _crossed(value: Column, thresholds, strict: bool) -> Column:
    """How many thresholds the value passes (thresholds ascending)."""
    hits = [F.when(value > t if strict else value >= t, 1).otherwise(0) for t in thresholds]
    return sum(hits[1:], hits[0])


def roi_by_threshold(bets: DataFrame, thresholds=EDGE_THRESHOLDS, group="market") -> DataFrame:
    """n, win rate and ROI of bets whose edge is above each threshold; empty cells kept."""
    keys = [group] if isinstance(group, str) else list(group)
    cell = bets.groupBy(*keys, _crossed(F.col("edge"), thresholds, True).alias("level")).agg(
        F.count("*").alias("n"), F.count_if("hit").alias("wins"),
        F.sum(settle.pnl(F.col("hit"), F.col("odds"))).alias("pnl"))
    grid = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("need"), F.lit(float(t)).alias("threshold"))
                               for i, t in enumerate(thresholds)]))
    g = cell.select("*", grid.alias("g")).groupBy(*keys, F.col("g.threshold").alias("threshold")).agg(
        F.sum(F.when(F.col("level") >= F.col("g.need"), F.col("n")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("level") >= F.col("g.need"), F.col("wins"))).alias("wins"),
        F.sum(F.when(F.col("level") >= F.col("g.need"), F.col("pnl"))).alias("pnl"))
    return g.select(*keys, "threshold", "n", (F.col("wins") / F.col("n")).alias("win_rate"), (F.col("pnl") / F.col("n")).alias("roi")) \
        .withColumns({c: F.when(F.col("n") > 0, F.col(c)) for c in ("win_rate", "roi")})


def best_roi(grid: DataFrame, min_n: int = 30) -> DataFrame:
    return grid.groupBy("league").agg(F.max(F.when(F.col("n") >= min_n, F.col("roi"))).alias("best_roi"))


def correct_score_quality(df: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Predicted mass of the top K scores against how often the result was among them."""
    n = mk.N
    label = f"concat(least(ft_home, {n}), '-', least(ft_away, {n}))"
    t = mk.top_scores(df, max(ks)).selectExpr("top", f"{label} AS actual")
    per = t.selectExpr(*[f"aggregate(slice(top, 1, {k}), 0D, (s, x) -> s + x.p) AS m{k}" for k in ks],
                       *[f"exists(slice(top, 1, {k}), x -> x.score = actual) AS h{k}" for k in ks])
    s = per.agg(F.count("*").alias("n"), *[F.sum(f"m{k}").alias(f"m{k}") for k in ks],
                *[F.count_if(f"h{k}").alias(f"h{k}") for k in ks])
    items = ", ".join(f"struct({k} AS k, m{k} / n AS predicted, h{k} / n AS actual, h{k} / n - m{k} / n AS gap,"
                      f" h{k} / m{k} - 1 AS edge_at_fair)" for k in ks)
    return s.selectExpr(f"inline(array({items}))")


def ev_grid(cands: DataFrame, leagues=LEAGUE_GROUPS, edges=EDGE_THRESHOLDS, floors=PROB_FLOORS,
            min_n: int = 50, top: int = 30) -> DataFrame:
    """ROI of every (league group, market group, edge floor, probability floor) strategy, best first.

    Candidates are summed into (league, family, edge level, probability level) cells; groups
    overlap, so cells join the group membership lists and the floors afterwards.
    """
    spark = cands.sparkSession
    cell = cands.groupBy(
        "league", naming.base_market(F.col("market")).alias("family"),
        _crossed(F.col("edge"), edges, False).alias("el"), _crossed(F.col("prob"), floors, False).alias("pl"),
    ).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), F.sum("odds").alias("odds"),
          F.sum(settle.pnl(F.col("hit"), F.col("odds"))).alias("pnl")).filter("el > 0 AND pl > 0")
    fam = literal_rows(spark, [(g, b) for g, bs in MARKET_GROUPS.items() for b in bs], "market_group, family")
    lg_member = F.lit("All") if list(leagues) == ["All"] else F.explode(F.array_compact(F.array(*[
        F.lit(g) if ls is None else F.when(F.col("league").isin(ls), g) for g, ls in leagues.items()])))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(i + 1).alias("en"), F.lit(float(e)).alias("min_edge"), F.lit(j + 1).alias("pn"), F.lit(float(p)).alias("min_prob"))
        for i, e in enumerate(edges) for j, p in enumerate(floors)]))
    x = cell.withColumn("league_group", lg_member).join(fam, "family").withColumn("g", pairs)
    x = x.filter("el >= g.en AND pl >= g.pn").groupBy(
        "league_group", "market_group", F.col("g.min_edge").alias("min_edge"), F.col("g.min_prob").alias("min_prob")).agg(
        F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("odds").alias("odds"), F.sum("pnl").alias("pnl"))
    x = x.filter(F.col("n") >= min_n).select(
        "league_group", "market_group", "min_edge", "min_prob", "n", (F.col("hits") / F.col("n")).alias("hit_rate"),
        (F.col("odds") / F.col("n")).alias("avg_odds"), (F.col("pnl") / F.col("n")).alias("roi"))
    return x.orderBy(F.round("roi", 9).desc(), F.desc("n"), F.desc("league_group"), F.desc("market_group"),
                     F.desc("min_edge"), F.desc("min_prob")).limit(top)
