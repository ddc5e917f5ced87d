"""Queries: goal model columns, markets, prices, value (M0, M1)."""
from pyspark.sql import functions as F

from touchline.functions import goals, naming, value
from touchline.operators import markets as mk
from touchline.operators import odds as od
from touchline.plans import derive as D
from touchline.plans.oracle import sql
from touchline.plans.registry import query

def p6(name):
    """``round(name, 6)`` of a double column, to the last bit: by plain arithmetic, and by decimals only next to a tie or from a thousand up."""
    y = f"({name} * 1e6D)"
    return F.expr(f"IF(abs({name}) < 1e3D AND abs({y} - floor({y}) - 0.5D) > 1e-4D, floor({y} + 0.5D) / 1e6D, round({name}, 6))").alias(name)


NOW_SQL = f"TIMESTAMP '{D.NOW}'"


def r6(c, name=None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6).alias(name) if name else F.round(c, 6)


def book(matches, best, markets, how="inner"):
    """The long book of ``matches`` with prices."""
    return od.priced(mk.long_book(od.with_prices(matches, best, markets, how), markets), how)


def priced_book(spark, d):
    """Every selection of every match that has a price."""
    odds = D.odds(spark, d)
    return book(D.rates(spark, d), od.best_prices(odds), od.priced_markets(odds))


def upcoming(spark, d):
    return D.matches(spark, d).filter((F.col("status") == "scheduled") & (F.col("kickoff") > D.now()))


@query("m0_upcoming_value", sql("mp best", f"""
SELECT match_id, league, market, selection, round(prob, 6) AS prob, odds, round(prob * odds - 1, 6) AS edge,
  CASE WHEN prob >= 0.7e0 AND prob * odds - 1 >= 0.03e0 THEN 'banko_value'
       WHEN prob >= 0.35e0 AND prob < 0.7e0 AND prob * odds - 1 >= 0.05e0 THEN 'kombine_value' ELSE 'no_value' END AS tag
FROM mp JOIN best USING (match_id, market, selection)
WHERE status = 'scheduled' AND kickoff > {NOW_SQL} AND prob * odds > 1"""))
def m0_upcoming_value(spark, d):
    m = D.with_rates(upcoming(spark, d)).select("match_id", "league", "lam", "mu", "rho")
    e = value.edge(F.col("prob"), F.col("odds"))
    return (
        book(m, od.best_prices(D.odds(spark, d)), ["1X2", "over_under_2.5"])
        .withColumn("e", e).filter("e > 0")
        .select("match_id", "league", "market", "selection", r6("prob", "prob"), "odds", r6("e", "edge"),
                value.tag(F.col("prob"), F.col("e")).alias("tag"))
    )


@query("f1_poisson_rates", sql("r", """
SELECT match_id, round(lam, 6) AS lam, round(mu, 6) AS mu, round(exp(-lam), 6) AS home_p0,
  round(exp(-lam) * pow(lam, 3) / 6, 6) AS home_p3, round(exp(-mu) * pow(mu, 10) / 3628800, 9) AS away_p10 FROM r"""))
def f1_poisson_rates(spark, d):
    r = D.rates(spark, d)
    return r.select("match_id", r6("lam", "lam"), r6("mu", "mu"), r6(goals.poisson_pmf(F.col("lam"), 0), "home_p0"),
                    r6(goals.poisson_pmf(F.col("lam"), 3), "home_p3"),
                    F.round(goals.poisson_pmf(F.col("mu"), 10), 9).alias("away_p10"))


@query("f2_score_matrix", sql("m pair_cells", """
SELECT match_id, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(p, 6) AS p
FROM m JOIN pair_cells USING (home_team_id, away_team_id)"""))
def f2_score_matrix(spark, d):
    return mk.cells(D.rates(spark, d)).select("match_id", "i", "j", p6("p"))


@query("j25_cells_per_match", sql("m pair_cells", """
SELECT match_id, count(*) AS cells, round(sum(p), 6) AS mass, round(sum(p * i), 6) AS mean_home
FROM m JOIN pair_cells USING (home_team_id, away_team_id) GROUP BY match_id"""))
def j25_cells_per_match(spark, d):
    return (mk.cells(D.rates(spark, d)).groupBy("match_id")
            .agg(F.count("*").alias("cells"), r6(F.sum("p"), "mass"), r6(F.sum(F.col("p") * F.col("i")), "mean_home")))


@query("f3_decay_weight", sql("m", f"""
SELECT match_id, round(exp(-0.0018e0 * date_diff('day', kickoff, {NOW_SQL})), 6) AS weight
FROM m WHERE status = 'finished' AND kickoff <= {NOW_SQL}"""))
def f3_decay_weight(spark, d):
    from touchline.functions import times
    m = D.matches(spark, d).filter((F.col("status") == "finished") & (F.col("kickoff") <= D.now()))
    return m.select("match_id", r6(goals.decay_weight(times.days_between(D.now(), F.col("kickoff")), 0.0018), "weight"))


def _market_query(name, markets):
    names = ", ".join(f"'{m}'" for m in markets)

    @query(name, sql("mp", f"SELECT match_id, market, selection, round(prob, 6) AS prob FROM mp WHERE market IN ({names})"))
    def run(spark, d):
        return mk.long_book(D.rates(spark, d), markets).select("match_id", "market", "selection", r6("prob", "prob"))
    return run


_market_query("a5_one_x_two", ["1X2"])
_market_query("a6_double_chance", ["double_chance"])
_market_query("a8_btts", ["btts"])
_market_query("a9_goal_range", ["goal_range"])
_market_query("a10_odd_even", ["odd_even"])
_market_query("a12_team_totals", ["home_over_under_1.5", "away_over_under_1.5"])
_market_query("a13_full_payload", sorted({m for m, _ in mk.book_columns()}))

OU_LINES = [0.5, 1.5, 2.0, 2.25, 2.5, 2.75, 3.0, 3.5, 4.5]
AH_LINES = [-1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 0.75, 1.0]


def _lines_cte(lines):
    rows = []
    for l in lines:
        parts = [l - 0.25, l + 0.25] if l % 0.5 else [l]
        rows += [f"({l}e0, {c}e0)" for c in parts]
    return "(VALUES " + ", ".join(rows) + ") l(line, part)"


@query("a7_over_under_lines", sql("m pair_cells", f""",
 q AS (SELECT home_team_id, away_team_id, line, part, sum(CASE WHEN i + j > part THEN p WHEN i + j = part THEN p / 2 ELSE 0 END) AS o
  FROM pair_cells, {_lines_cte(OU_LINES)} GROUP BY home_team_id, away_team_id, line, part),
 t AS (SELECT home_team_id, away_team_id, line, avg(o) AS o FROM q GROUP BY home_team_id, away_team_id, line)
SELECT match_id, line, round(o, 6) AS over_prob, round(1 - o, 6) AS under_prob FROM m JOIN t USING (home_team_id, away_team_id)"""))
def a7_over_under_lines(spark, d):
    dist = mk.with_distributions(D.rates(spark, d)).select("match_id", "total_pmf")
    e = dist.select("match_id", "total_pmf", F.explode(F.array(*[F.lit(float(l)) for l in OU_LINES])).alias("line"))
    o = e.withColumn("o", mk.over_at("total_pmf", "line"))
    return o.select("match_id", "line", r6("o", "over_prob"), r6(F.lit(1.0) - F.col("o"), "under_prob"))


@query("a11_asian_handicap_lines", sql("m pair_cells", f""",
 q AS (SELECT home_team_id, away_team_id, line, part, sum(CASE WHEN i - j + part > 0 THEN p WHEN i - j + part = 0 THEN p / 2 ELSE 0 END) AS h
  FROM pair_cells, {_lines_cte(AH_LINES)} GROUP BY home_team_id, away_team_id, line, part),
 t AS (SELECT home_team_id, away_team_id, line, avg(h) AS h FROM q GROUP BY home_team_id, away_team_id, line)
SELECT match_id, line, round(h, 6) AS home_prob, round(1 - h, 6) AS away_prob FROM m JOIN t USING (home_team_id, away_team_id)"""))
def a11_asian_handicap_lines(spark, d):
    dist = mk.with_distributions(D.rates(spark, d)).select("match_id", "margin_pmf")
    e = dist.select("match_id", "margin_pmf", F.explode(F.array(*[F.lit(float(l)) for l in AH_LINES])).alias("line"))
    o = e.withColumn("h", mk.handicap_home_at("margin_pmf", "line"))
    return o.select("match_id", "line", r6("h", "home_prob"), r6(F.lit(1.0) - F.col("h"), "away_prob"))


@query("f31_line_components", sql("m", """
SELECT match_id, line, CASE WHEN abs(line - floor(line) - 0.25e0) < 1e-9 OR abs(line - floor(line) - 0.75e0) < 1e-9 THEN 2 ELSE 1 END AS parts,
  CASE WHEN line * 2 = floor(line * 2) THEN line ELSE line - 0.25e0 END AS first_part
FROM (SELECT match_id, (match_id % 21 - 8) / 4.0e0 AS line FROM m) z"""))
def f31_line_components(spark, d):
    line = ((F.col("match_id") % 21 - 8) / F.lit(4.0)).alias("line")
    parts = mk.component_lines(F.col("line"))
    return D.matches(spark, d).select("match_id", line).select(
        "match_id", "line", F.size(parts).alias("parts"), parts[0].alias("first_part"))


@query("t1_top_correct_scores", sql("m pair_cells", """,
 t AS (SELECT home_team_id, away_team_id, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS score, p,
   row_number() OVER (PARTITION BY home_team_id, away_team_id ORDER BY floor(p * 1e12 + 0.5e0) DESC, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) DESC) AS rnk
  FROM pair_cells)
SELECT match_id, CAST(rnk AS INTEGER) AS rnk, score, round(p, 6) AS p FROM m JOIN t USING (home_team_id, away_team_id) WHERE rnk <= 10"""))
def t1_top_correct_scores(spark, d):
    t = mk.top_scores(D.rates(spark, d)).select("match_id", F.posexplode_outer("top").alias("pos", "s"))
    return t.select("match_id", (F.col("pos") + 1).alias("rnk"), F.col("s.score").alias("score"), r6("s.p", "p"))


@query("w11_score_cell_rank", sql("m pair_cells", """,
 t AS (SELECT home_team_id, away_team_id, i, j, p,
   row_number() OVER (PARTITION BY home_team_id, away_team_id ORDER BY floor(p * 1e12 + 0.5e0) DESC, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) DESC) AS rnk
  FROM pair_cells)
SELECT match_id, CAST(rnk AS INTEGER) AS actual_rank FROM m JOIN t USING (home_team_id, away_team_id)
WHERE i = ft_home AND j = ft_away"""))
def w11_score_cell_rank(spark, d):
    """At which rank did the model hold the score that came in?"""
    m = D.with_rates(D.matches(spark, d).filter("ft_home is not null"))
    t = mk.top_scores(m.select("match_id", "ft_home", "ft_away", "lam", "mu", "rho"), 121)
    label = F.concat_ws("-", F.col("ft_home").cast("string"), F.col("ft_away").cast("string"))
    rank = F.array_position(F.transform("top", lambda s: s["score"]), label)
    return t.select("match_id", rank.cast("int").alias("actual_rank"))


@query("f32_payload_document")
def f32_payload_document(spark, d):
    return mk.payload_json(D.rates(spark, d)).select("match_id", "payload")


@query("p12_flat_payload_markets", sql("mp", """
SELECT match_id, market, selection, round(prob, 6) AS prob FROM mp WHERE market NOT LIKE 'over_under%'"""))
def p12_flat_payload_markets(spark, d):
    """Read the stored document back: only flat numeric maps are markets."""
    doc = mk.payload_json(D.rates(spark, d)).select("match_id", "payload")
    return mk.payload_probs(doc).select("match_id", "market", "selection", p6("prob"))


@query("w7_best_price_last_wins", sql("best", "SELECT match_id, market, selection, odds FROM best"))
def w7_best_price_last_wins(spark, d):
    return od.best_prices(D.odds(spark, d))


@query("w7_best_price_opening", sql("odds", """
SELECT match_id, market, selection, odds FROM (
  SELECT match_id, replace(market, 'OU_', 'over_under_') AS market, selection, decimal_odds AS odds,
    row_number() OVER (PARTITION BY match_id, market, selection ORDER BY
      CASE source WHEN 'B365' THEN 0 WHEN 'B365C' THEN 5 WHEN 'PSC' THEN 6 ELSE 99 END, odds_id) AS rn FROM odds) z WHERE rn = 1"""))
def w7_best_price_opening(spark, d):
    return od.best_prices(D.odds(spark, d), od.OPENING_PRIORITY, tie="first")


@query("w8_latest_price", sql("odds", """
SELECT match_id, market, selection, odds FROM (
  SELECT match_id, replace(market, 'OU_', 'over_under_') AS market, selection, decimal_odds AS odds,
    row_number() OVER (PARTITION BY match_id, market, selection ORDER BY fetched_at DESC, odds_id DESC) AS rn FROM odds) z WHERE rn = 1"""))
def w8_latest_price(spark, d):
    return od.latest_prices(D.odds(spark, d))


@query("a14_overround", sql("overround", "SELECT match_id, market, round(vig, 6) AS overround FROM overround"))
def a14_overround(spark, d):
    o = od.overrounds(od.best_prices(D.odds(spark, d)))
    return o.select("match_id", "market", r6("overround", "overround"))


@query("a14_double_chance_overround", sql("overround", """
SELECT match_id, 'double_chance' AS market, round(vig * 2 / 3, 6) AS overround FROM overround WHERE market = '1X2'"""))
def a14_double_chance_overround(spark, d):
    o = od.double_chance_overround(od.overrounds(od.best_prices(D.odds(spark, d))))
    return o.select("match_id", "market", r6("overround", "overround"))


@query("j3_probs_with_prices", sql("mp best", """
SELECT match_id, market, selection, round(prob, 6) AS prob, odds
FROM mp LEFT JOIN best USING (match_id, market, selection)
WHERE market IN ('1X2', 'double_chance', 'btts', 'odd_even') OR market LIKE 'over_under_%'"""))
def j3_probs_with_prices(spark, d):
    return book(D.rates(spark, d), od.best_prices(D.odds(spark, d)), mk.ENUMERATED, "left").select(
        "match_id", "market", "selection", p6("prob"), "odds")


@query("f4_edges", sql("mp best overround", """
SELECT match_id, market, selection, round(prob * odds - 1, 6) AS raw_edge, round(prob / ((1 / odds) / vig) - 1, 6) AS fair_edge
FROM mp JOIN best USING (match_id, market, selection) JOIN overround USING (match_id, market)"""))
def f4_edges(spark, d):
    x = priced_book(spark, d)
    return x.select("match_id", "market", "selection", r6(value.edge(F.col("prob"), F.col("odds")), "raw_edge"),
                    r6(value.fair_edge(F.col("prob"), F.lit(1.0) / F.col("odds"), F.col("overround")), "fair_edge"))


@query("f5_value_tags", sql("mp best", """
SELECT tag, count(*) AS n FROM (SELECT CASE WHEN prob >= 0.7e0 AND prob * odds - 1 >= 0.03e0 THEN 'banko_value'
       WHEN prob >= 0.35e0 AND prob < 0.7e0 AND prob * odds - 1 >= 0.05e0 THEN 'kombine_value' ELSE 'no_value' END AS tag
FROM mp JOIN best USING (match_id, market, selection)) z GROUP BY tag"""))
def f5_value_tags(spark, d):
    x = priced_book(spark, d)
    t = value.tag(F.col("prob"), value.edge(F.col("prob"), F.col("odds")))
    return x.groupBy(t.alias("tag")).agg(F.count("*").alias("n"))


@query("f6_kelly", sql("mp best", """
SELECT match_id, market, selection, round(CASE WHEN odds - 1 <= 0 THEN 0 ELSE greatest(0, ((odds - 1) * prob - (1 - prob)) / (odds - 1)) END, 6) AS kelly,
  round_even(1000 * 0.25e0 * greatest(0, ((odds - 1) * prob - (1 - prob)) / (odds - 1)), 2) AS stake
FROM mp JOIN best USING (match_id, market, selection)"""))
def f6_kelly(spark, d):
    x = priced_book(spark, d)
    k = value.kelly(F.col("prob"), F.col("odds"))
    return x.select("match_id", "market", "selection", r6(k, "kelly"), value.kelly_stake(F.col("prob"), F.col("odds"), F.lit(1000.0), F.lit(0.25)).alias("stake"))


@query("p10_value_view", sql("mp best", """
SELECT match_id, market, selection, round(prob, 6) AS model_prob, odds, round(prob * odds - 1, 6) AS edge, tag FROM (
  SELECT *, CASE WHEN prob >= 0.7e0 AND prob * odds - 1 >= 0.03e0 THEN 'banko_value'
     WHEN prob >= 0.35e0 AND prob < 0.7e0 AND prob * odds - 1 >= 0.05e0 THEN 'kombine_value' ELSE 'no_value' END AS tag
  FROM mp JOIN best USING (match_id, market, selection)) z WHERE tag = 'banko_value'"""))
def p10_value_view(spark, d, mode="banko"):
    """Mode all / banko / kombine of the value surface."""
    x = priced_book(spark, d)
    e = value.edge(F.col("prob"), F.col("odds"))
    x = x.withColumn("edge", e).withColumn("tag", value.tag(F.col("prob"), F.col("edge")))
    x = x.filter(F.col("tag") != "no_value") if mode == "all" else x.filter(F.col("tag") == f"{mode}_value")
    return x.select("match_id", "market", "selection", r6("prob", "model_prob"), "odds", r6("edge", "edge"), "tag")


@query("w16_share_of_max", sql("mp", """
SELECT match_id, market, selection, round(prob / max(prob) OVER (PARTITION BY match_id, market), 6) AS bar FROM mp"""))
def w16_share_of_max(spark, d):
    from pyspark.sql import Window
    p = mk.long_book(D.rates(spark, d))
    top = F.max("prob").over(Window.partitionBy("match_id", "market"))
    return p.select("match_id", "market", "selection", r6(F.col("prob") / top, "bar"))


@query("f16_market_names", sql("odds", """
SELECT market, selection, replace(market, 'OU_', 'over_under_') AS price_market,
  CASE WHEN market LIKE 'OU_%' THEN 'over_under' ELSE market END AS base_market, count(*) AS n
FROM odds GROUP BY market, selection"""))
def f16_market_names(spark, d):
    m = F.col("market")
    return D.odds(spark, d).groupBy("market", "selection").agg(F.count("*").alias("n")).select(
        "market", "selection", naming.price_market(m).alias("price_market"), naming.base_market(m).alias("base_market"), "n")


@query("f30_temperature_apply", sql("mp", """
SELECT match_id, market, selection, round(q / sum(q) OVER (PARTITION BY match_id, market), 6) AS prob
FROM (SELECT *, pow(greatest(prob, 1e-12), 1 / 1.8e0) AS q FROM mp) z"""))
def f30_temperature_apply(spark, d):
    return mk.sharpened_book(D.rates(spark, d), 1.8).select("match_id", "market", "selection", p6("prob"))
