"""Queries: settlement, accuracy, calibration, ROI (M2)."""
from pyspark.sql import functions as F

from touchline.functions import settle
from touchline.operators import calibrate as cal
from touchline.operators import evaluate as ev
from touchline.operators import markets as mk
from touchline.operators import odds as od
from touchline.operators import picks as pk
from touchline.operators import timeline as tl
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, hit_sql, sql
from touchline.plans.q_features import day
from touchline.plans.q_markets import book, r6
from touchline.plans.registry import query
from touchline.session import stored

_ENUM = "(market IN ('1X2', 'double_chance', 'btts', 'odd_even') OR market LIKE 'over_under_%')"
CTE["picked"] = (["mp", "pair_cells"], f"""
  SELECT * FROM (SELECT match_id, league, season, kickoff, ft_home, ft_away, market, selection AS pick, prob AS pick_prob,
    row_number() OVER (PARTITION BY match_id, market ORDER BY round(prob, 12) DESC, ord) AS rn FROM mp WHERE {_ENUM}) z WHERE rn = 1""")
CTE["scored"] = (["picked", "pair_cells"], f"""
  SELECT match_id, league, kickoff, ft_home, ft_away, market, pick, pick_prob, {hit_sql(selection='pick')} AS hit FROM picked WHERE ft_home IS NOT NULL
  UNION ALL
  SELECT match_id, league, kickoff, ft_home, ft_away, 'correct_score', score, p, score = CAST(ft_home AS VARCHAR) || '-' || CAST(ft_away AS VARCHAR)
  FROM m JOIN (SELECT home_team_id, away_team_id, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) AS score, p,
     row_number() OVER (PARTITION BY home_team_id, away_team_id ORDER BY floor(p * 1e12 + 0.5e0) DESC, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) DESC) AS rnk
     FROM pair_cells) t USING (home_team_id, away_team_id) WHERE rnk = 1 AND ft_home IS NOT NULL""")
CTE["cand"] = (["mp", "best", "overround"], f"""
  SELECT match_id, league, kickoff, market, selection, prob, odds, prob / ((1 / odds) / vig) - 1 AS edge, {hit_sql()} AS hit
  FROM mp JOIN best USING (match_id, market, selection) JOIN overround USING (match_id, market)
  WHERE odds > 1.01e0 AND ft_home IS NOT NULL""")
CTE["bets"] = (["mp", "best"], f"""
  SELECT match_id, league, kickoff, market, selection, prob, odds, prob * odds - 1 AS edge, {hit_sql()} AS hit
  FROM mp JOIN best USING (match_id, market, selection) WHERE ft_home IS NOT NULL""")
_RESULT = "CASE WHEN ft_home > ft_away THEN '1' WHEN ft_home < ft_away THEN '2' ELSE 'X' END"
THRESHOLDS = [0.0, 0.03, 0.05, 0.10]
_PNL = "CASE WHEN hit THEN odds - 1 ELSE -1 END"


def played(spark, d):
    m = D.matches(spark, d).filter("status = 'finished' AND ft_home IS NOT NULL AND ft_away IS NOT NULL")
    return D.with_rates(m).select("match_id", "league", "kickoff", "ft_home", "ft_away", "lam", "mu", "rho")


def acc_rows(spark, d):
    return ev.accuracy_rows(played(spark, d))


def cands(spark, d):
    return pk.candidates(played(spark, d), od.best_prices(D.odds(spark, d)))


def bets(spark, d):
    x = book(played(spark, d), od.best_prices(D.odds(spark, d)), ["1X2", "over_under_2.5"])
    return x.select("match_id", "league", "kickoff", "market", "selection", "prob", "odds", F.expr("prob * odds - 1D").alias("edge"),
                    settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away")).alias("hit"))


@query("f14_settlement", sql("mp", f"""
SELECT match_id, string_agg(market || ':' || selection, ' ' ORDER BY market, selection) AS winners
FROM mp WHERE {_ENUM} AND {hit_sql()} GROUP BY match_id"""))
def f14_settlement(spark, d):
    """Which of a match's selections won? Settled inside the row, no shuffle."""
    m = D.matches(spark, d).filter("ft_home IS NOT NULL")
    items = sorted(mk.book_columns(mk.ENUMERATED))
    won = [F.when(settle.hit(F.lit(mkt), F.lit(s), F.col("ft_home"), F.col("ft_away")), f"{mkt}:{s}") for mkt, s in items]
    return m.select("match_id", F.concat_ws(" ", *won).alias("winners"))


@query("f15_actual_outcomes", sql("picked", """
SELECT match_id, market, CASE WHEN market = '1X2' THEN r WHEN market = 'double_chance' THEN CASE r WHEN '1' THEN '12/1X' WHEN '2' THEN '12/X2' ELSE '1X/X2' END
  WHEN market LIKE 'over_under_%' THEN CASE WHEN ft_home + ft_away > CAST(substr(market, 12) AS DOUBLE) THEN 'over' ELSE 'under' END
  WHEN market = 'btts' THEN CASE WHEN ft_home > 0 AND ft_away > 0 THEN 'yes' ELSE 'no' END
  ELSE CASE WHEN (ft_home + ft_away) % 2 = 1 THEN 'odd' ELSE 'even' END END AS actual
FROM (SELECT *, CASE WHEN ft_home > ft_away THEN '1' WHEN ft_home < ft_away THEN '2' ELSE 'X' END AS r FROM picked WHERE ft_home IS NOT NULL) z"""))
def f15_actual_outcomes(spark, d):
    m = D.matches(spark, d).filter("ft_home IS NOT NULL")
    e = m.select("match_id", "ft_home", "ft_away", F.explode(F.array(*[F.lit(x) for x in ev.ARGMAX_MARKETS])).alias("market"))
    return e.select("match_id", "market", settle.actual_label(F.col("market"), F.col("ft_home"), F.col("ft_away")).alias("actual"))


@query("u8_accuracy_rows", sql("scored", """
SELECT match_id, market, pick, round(pick_prob, 6) AS pick_prob, CAST(hit AS INTEGER) AS hit FROM scored"""))
def u8_accuracy_rows(spark, d):
    """Also W10: the argmax selection of each market."""
    return acc_rows(spark, d).select("match_id", "market", "pick", r6("pick_prob", "pick_prob"), F.col("hit").cast("int").alias("hit"))


@query("a15_accuracy_summary", sql("scored", """
SELECT coalesce(market, 'overall') AS market, count(*) AS picks, count(*) FILTER (WHERE hit) AS hits,
  round(count(*) FILTER (WHERE hit) / count(*), 6) AS hit_rate, round(avg(pick_prob), 6) AS avg_prob
FROM scored GROUP BY ROLLUP (market)"""))
def a15_accuracy_summary(spark, d):
    s = ev.accuracy_summary(acc_rows(spark, d))
    return s.select("market", "picks", "hits", r6("hit_rate", "hit_rate"), r6("avg_prob", "avg_prob"))


def _bins_sql(table, prob, edges, labels):
    rows = ", ".join(f"('{name}', {lo}e0, {hi}e0)" for name, lo, hi in zip(labels, edges, edges[1:]))
    return f"""SELECT range, count({prob}) AS picks, count(*) FILTER (WHERE hit) AS hits,
      round(coalesce(count(*) FILTER (WHERE hit) / nullif(count({prob}), 0), 0), 6) AS hit_rate, round(coalesce(avg({prob}), 0), 6) AS avg_prob
      FROM (VALUES {rows}) b(range, lo, hi) LEFT JOIN {table} s ON s.{prob} >= b.lo AND s.{prob} < b.hi GROUP BY range"""


@query("a16_calibration_bins", sql("scored", _bins_sql("scored", "pick_prob", ev.ACCURACY_EDGES, ev.ACCURACY_LABELS)))
def a16_calibration_bins(spark, d):
    b = ev.calibration_bins(acc_rows(spark, d))
    return b.select("range", "picks", "hits", r6("hit_rate", "hit_rate"), r6("avg_prob", "avg_prob"))


def one_x_two_points(spark, d):
    p = mk.long_book(played(spark, d), ["1X2"])
    h = settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away"))
    return p.select("match_id", "market", "prob", h.cast("int").alias("hit"))


@query("a17_reliability", sql("mp", f"""
SELECT CAST(greatest(1, ceil(prob * 10)) AS BIGINT) AS bin, count(*) AS n, round(avg(prob), 6) AS predicted, round(avg(h), 6) AS actual, round(avg(h) - avg(prob), 6) AS gap
FROM (SELECT prob, CASE WHEN selection = {_RESULT} THEN 1e0 ELSE 0e0 END AS h FROM mp WHERE market = '1X2' AND ft_home IS NOT NULL) z GROUP BY 1"""))
def a17_reliability(spark, d):
    r = ev.reliability(one_x_two_points(spark, d))
    return r.select("bin", "n", *[r6(c, c) for c in ("predicted", "actual", "gap")])


@query("a18_brier_log_loss", sql("mp", f"""
SELECT coalesce(league, 'overall') AS league, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(logloss), 6) AS logloss FROM (
  SELECT match_id, league, sum(pow(prob - CASE WHEN selection = {_RESULT} THEN 1 ELSE 0 END, 2)) AS brier,
    -ln(greatest(max(CASE WHEN selection = {_RESULT} THEN prob END), 1e-12)) AS logloss
  FROM mp WHERE market = '1X2' AND ft_home IS NOT NULL GROUP BY match_id, league) z GROUP BY ROLLUP (league)"""))
def a18_brier_log_loss(spark, d):
    s = ev.loss_summary(ev.with_score_losses(mk.wide_book(played(spark, d))))
    return s.select("league", "n", r6("brier", "brier"), r6("logloss", "logloss"))


_TH = "(VALUES " + ", ".join(f"({t}e0)" for t in THRESHOLDS) + ") t(threshold)"


@query("a19_roi_by_threshold", sql("bets", f"""
SELECT k.market, t.threshold, count(b.match_id) AS n, round(count(*) FILTER (WHERE hit) / nullif(count(b.match_id), 0), 6) AS win_rate,
  round(sum({_PNL}) FILTER (WHERE b.match_id IS NOT NULL) / nullif(count(b.match_id), 0), 6) AS roi
FROM (SELECT DISTINCT market FROM bets) k CROSS JOIN {_TH} LEFT JOIN bets b ON b.market = k.market AND b.edge > t.threshold GROUP BY k.market, t.threshold"""))
def a19_roi_by_threshold(spark, d):
    g = ev.roi_by_threshold(bets(spark, d), THRESHOLDS)
    return g.select("market", "threshold", "n", r6("win_rate", "win_rate"), r6("roi", "roi"))


@query("a20_best_roi_per_league", sql("bets", f"""
SELECT league, round(max(roi) FILTER (WHERE n >= 30), 6) AS best_roi FROM (
  SELECT league, market, threshold, count(*) AS n, avg({_PNL}) AS roi FROM bets JOIN {_TH} ON edge > threshold GROUP BY league, market, threshold) z GROUP BY league"""))
def a20_best_roi_per_league(spark, d):
    g = ev.roi_by_threshold(bets(spark, d), THRESHOLDS, ["league", "market"])
    return ev.best_roi(g).select("league", r6("best_roi", "best_roi"))


@query("a21_correct_score_quality", sql("m pair_cells", """,
 t AS (SELECT home_team_id, away_team_id, i, j, p, row_number() OVER (PARTITION BY home_team_id, away_team_id ORDER BY floor(p * 1e12 + 0.5e0) DESC, CAST(i AS VARCHAR) || '-' || CAST(j AS VARCHAR) DESC) AS rnk FROM pair_cells),
 s AS (SELECT k, sum(p) AS mass, count(*) FILTER (WHERE i = least(ft_home, 10) AND j = least(ft_away, 10)) AS hits, count(DISTINCT match_id) AS n
   FROM m JOIN t USING (home_team_id, away_team_id) JOIN (VALUES (1), (3), (5)) v(k) ON rnk <= k WHERE ft_home IS NOT NULL GROUP BY k)
SELECT k, round(mass / n, 6) AS predicted, round(hits / n, 6) AS actual, round(hits / n - mass / n, 6) AS gap, round(hits / mass - 1, 6) AS edge_at_fair FROM s"""))
def a21_correct_score_quality(spark, d):
    q = ev.correct_score_quality(played(spark, d).select("ft_home", "ft_away", "lam", "mu", "rho"))
    return q.select("k", *[r6(c, c) for c in ("predicted", "actual", "gap", "edge_at_fair")])


@query("u7_candidates", sql("cand", """
SELECT match_id, market, selection, round(prob, 6) AS prob, odds, round(edge, 6) AS edge, CAST(hit AS INTEGER) AS hit FROM cand"""))
def u7_candidates(spark, d):
    """Also P11: only prices above 1.01 with a known outcome."""
    c = cands(spark, d)
    return c.select("match_id", "market", "selection", r6("prob", "prob"), "odds", r6("edge", "edge"), F.col("hit").cast("int").alias("hit"))


GROUPS = {"All": None, "Big5": ["L0", "L1"], "Small": ["L2", "L3", "L4"]}


def _grid_cte():
    lg = ", ".join(f"('{g}', '{x}')" for g, ls in GROUPS.items() for x in (ls or ["L0", "L1", "L2", "L3", "L4"]))
    mg = ", ".join(f"('{g}', '{b}')" for g, bs in ev.MARKET_GROUPS.items() for b in bs)
    return f"""SELECT lg AS league_group, mg AS market_group, e AS min_edge, p AS min_prob, count(*) AS n, count(*) FILTER (WHERE hit) / count(*) AS hit_rate,
      avg(odds) AS avg_odds, avg({_PNL}) AS roi
    FROM cand JOIN (VALUES {lg}) a(lg, league) USING (league)
      JOIN (VALUES {mg}) b(mg, base) ON base = CASE WHEN market LIKE 'over_under%' THEN 'over_under' ELSE market END
      JOIN (VALUES {', '.join(f'({x}e0)' for x in ev.EDGE_THRESHOLDS)}) c(e) ON edge >= e JOIN (VALUES {', '.join(f'({x}e0)' for x in ev.PROB_FLOORS)}) dd(p) ON prob >= p
    GROUP BY lg, mg, e, p HAVING count(*) >= 50"""


@query("a22_ev_grid_top30", sql("cand", f""", g AS ({_grid_cte()})
SELECT league_group, market_group, min_edge, min_prob, n, round(hit_rate, 6) AS hit_rate, round(avg_odds, 6) AS avg_odds, round(roi, 6) AS roi
FROM g ORDER BY round(g.roi, 9) DESC, n DESC, league_group DESC, market_group DESC, min_edge DESC, min_prob DESC LIMIT 30"""))
def a22_ev_grid_top30(spark, d):
    """Also J23, T4: candidates against the strategy grid, best thirty."""
    g = ev.ev_grid(cands(spark, d), GROUPS)
    return g.select("league_group", "market_group", "min_edge", "min_prob", "n", *[r6(c, c) for c in ("hit_rate", "avg_odds", "roi")])


def market_points(spark, d):
    """(market, prob, hit) of every enumerated selection of played matches."""
    p = mk.long_book(played(spark, d), [m for m in mk.ENUMERATED if m != "odd_even"])
    h = settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away"))
    return p.select("match_id", "kickoff", "market", "selection", "prob", h.cast("int").alias("hit"))


_PTS = f"SELECT market, prob, CASE WHEN {hit_sql()} THEN 1e0 ELSE 0e0 END AS hit FROM mp WHERE ft_home IS NOT NULL AND market <> 'odd_even' AND {_ENUM}"


@query("a31_market_mean_rates", sql("mp", f"SELECT market, count(*) AS n, round(avg(prob), 6) AS pred_avg, round(avg(hit), 6) AS actual FROM ({_PTS}) z GROUP BY market"))
def a31_market_mean_rates(spark, d):
    r = cal.mean_rates(market_points(spark, d))
    return r.select("market", "n", r6("pred_avg", "pred_avg"), r6("actual", "actual"))


@query("w12_timeline_index", sql("m", """
SELECT match_id, row_number() OVER (ORDER BY kickoff, match_id) - 1 AS idx, row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 1 AS league_idx,
  CASE WHEN row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 1 < 200 THEN -1
    ELSE CAST(floor((row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 201) / 50) AS BIGINT) END AS fold
FROM m WHERE status = 'finished'"""))
def w12_timeline_index(spark, d):
    m = D.matches(spark, d).filter("status = 'finished'").select("match_id", "league", "kickoff")
    x = tl.with_row_index(tl.with_row_index(m, "kickoff", "match_id"), "kickoff", "match_id", "league", "league_idx")
    return x.selectExpr("match_id", "idx", "league_idx", f"{tl.fold_of('league_idx', 200, 50)} AS fold")


@query("p13_sample_every_25th", sql("m", """
SELECT match_id, idx FROM (SELECT match_id, row_number() OVER (ORDER BY kickoff, match_id) - 1 AS idx FROM m WHERE status = 'finished') z WHERE idx % 25 = 0"""))
def p13_sample_every_25th(spark, d):
    m = D.matches(spark, d).filter("status = 'finished'").select("match_id", "kickoff")
    return tl.sample_every(tl.with_row_index(m, "kickoff", "match_id"), "idx", 25).select("match_id", "idx")


TEMPS = [0.5, 0.8, 1.0, 1.25, 1.5, 2.0, 3.0, 5.0, 10.0]


def temperature_rows(spark, d):
    w = mk.wide_book(played(spark, d))
    return w.selectExpr("match_id", "league", "kickoff", "array(`1X2|1`, `1X2|X`, `1X2|2`) AS p",
                        "CASE WHEN ft_home > ft_away THEN 1 WHEN ft_home < ft_away THEN 3 ELSE 2 END AS y")


_TN = "(VALUES " + ", ".join(f"({t}e0)" for t in TEMPS) + ") t(t)"


@query("u4_temperature_nll", sql("mp", f"""
SELECT league, t, count(*) AS n, round(avg(nll), 6) AS nll FROM (
  SELECT league, t, match_id, ln(sum(pow(greatest(prob, 1e-12), 1 / t))) - ln(greatest(max(CASE WHEN selection = {_RESULT} THEN prob END), 1e-12)) / t AS nll
  FROM mp, {_TN} WHERE market = '1X2' AND ft_home IS NOT NULL GROUP BY league, t, match_id) z GROUP BY league, t"""))
def u4_temperature_nll(spark, d):
    g = cal.temperature_nll(temperature_rows(spark, d), ["league"], TEMPS)
    return g.select("league", "t", "n", r6("nll", "nll"))


@query("u4_temperature_fit", sql("mp", f""",
 rows AS (SELECT league, match_id, list(ln(greatest(prob, 1e-12))) AS l, max(CASE WHEN selection = {_RESULT} THEN ln(greatest(prob, 1e-12)) END) AS ly
   FROM mp WHERE market = '1X2' AND ft_home IS NOT NULL GROUP BY league, match_id),
 halved AS (SELECT league, 0 AS step, 0.05e0 AS lo, 20e0 AS hi FROM rows GROUP BY league
   UNION ALL SELECT league, step + 1, CASE WHEN s < 0 THEN mid ELSE lo END, CASE WHEN s < 0 THEN hi ELSE mid END FROM (
     SELECT h.league, h.step, h.lo, h.hi, (h.lo + h.hi) / 2 AS mid,
       sum(list_sum(list_transform(l, lambda x: exp((h.lo + h.hi) / 2 * x) * x)) / list_sum(list_transform(l, lambda x: exp((h.lo + h.hi) / 2 * x))) - ly) AS s
     FROM halved h JOIN rows r USING (league) WHERE h.step < 45 GROUP BY h.league, h.step, h.lo, h.hi) z)
SELECT league, round(2 / (lo + hi), 6) AS T, n FROM halved JOIN (SELECT league, count(*) AS n FROM rows GROUP BY league) c USING (league) WHERE step = 45""").replace("WITH ", "WITH RECURSIVE ", 1))
def u4_temperature_fit(spark, d):
    return cal.fit_temperature(temperature_rows(spark, d), ["league"]).select("league", r6("T", "T"), "n")


EQUAL = 12  # digits; probabilities that differ by less are one point, whatever an engine's last bits are


def iso_points(spark, d):
    return market_points(spark, d).select("market", F.round("prob", EQUAL).alias("prob"), "hit")


# pools all falling stretches of block means at once, again and again until none falls: any order of pooling ends in the same blocks
_ISO = f""", pts AS MATERIALIZED (SELECT market, round(prob, {EQUAL}) AS prob, sum(hit) AS h, count(*) AS n FROM ({_PTS}) q GROUP BY 1, 2),
 blocks AS (
   SELECT 0 AS step, market, prob AS lo, prob AS hi, h, n, TRUE AS moved FROM pts
   UNION ALL
   SELECT step + 1, market, min(lo), max(hi), sum(h), sum(n), bool_or(falls) FROM (
     SELECT *, sum(CASE WHEN falls THEN 0 ELSE 1 END) OVER (PARTITION BY market ORDER BY lo) AS b FROM (
       SELECT *, coalesce(lag(h) OVER w * n >= h * lag(n) OVER w, FALSE) AS falls FROM blocks WINDOW w AS (PARTITION BY market ORDER BY lo)) x) y
   WHERE market IN (SELECT market FROM blocks GROUP BY market HAVING bool_or(moved)) GROUP BY step, market, b),
 iso AS MATERIALIZED (SELECT p.market, p.prob, b.h / b.n AS y FROM (SELECT * FROM blocks QUALIFY step = max(step) OVER (PARTITION BY market)) b
   JOIN pts p ON p.market = b.market AND p.prob BETWEEN b.lo AND b.hi)"""


def _recursive(names: str, body: str) -> str:
    text = sql(names, body)
    return text if text.startswith("WITH RECURSIVE") else text.replace("WITH ", "WITH RECURSIVE ", 1)


@query("u5_isotonic_fit", _recursive("mp", _ISO + """
SELECT market, round(prob, 9) AS prob, round(y, 6) AS y FROM iso"""))
def u5_isotonic_fit(spark, d):
    """Fit per market, evaluated at every distinct raw probability (a constant inside a pooled block)."""
    pts = iso_points(spark, d)
    curve = cal.fit_isotonic(pts)
    at = pts.select("market", "prob").distinct().withColumn("y", F.col("prob"))
    seg = cal.apply_curve(at, curve.withColumn("n_train", F.lit(cal.MIN_SAMPLES).cast("long")), "y")
    return seg.select("market", F.round("prob", 9).alias("prob"), r6("y", "y"))


@query("j26_calibrated_probs", _recursive("mp", _ISO + f""",
 q AS (SELECT match_id, market, selection, round(prob, {EQUAL}) AS prob FROM mp WHERE status = 'scheduled'),
 z AS (SELECT q.*, a.prob AS x0, a.y AS y0, b.prob AS x1, b.y AS y1 FROM q ASOF LEFT JOIN iso a ON a.market = q.market AND q.prob > a.prob
   ASOF LEFT JOIN iso b ON b.market = q.market AND q.prob <= b.prob)
SELECT match_id, market, selection, round(CASE WHEN x0 IS NULL AND x1 IS NULL THEN prob WHEN x0 IS NULL THEN y1 WHEN x1 IS NULL THEN y0 WHEN x1 = x0 THEN y1 ELSE y0 + (prob - x0) / (x1 - x0) * (y1 - y0) END, 6) AS prob FROM z"""))
def j26_calibrated_probs(spark, d):
    """Every market of what is still to play, under the curve of its market; a market without a curve keeps its value."""
    curve = cal.fit_isotonic(iso_points(spark, d))
    up = D.with_rates(D.matches(spark, d).filter("status = 'scheduled'")).select("match_id", "lam", "mu", "rho")
    p = cal.apply_curve(mk.long_book(up).withColumn("prob", F.round("prob", EQUAL)), curve)
    return p.select("match_id", "market", "selection", r6("prob", "prob"))


@query("t2_recent_details", sql("scored", """
SELECT match_id, market, CAST(ft_home AS VARCHAR) || '-' || CAST(ft_away AS VARCHAR) AS score, pick, CAST(hit AS INTEGER) AS hit
FROM scored ORDER BY kickoff DESC, match_id DESC, market LIMIT 200"""))
def t2_recent_details(spark, d):
    a = acc_rows(spark, d).orderBy(F.desc("kickoff"), F.desc("match_id"), "market").limit(200)
    return a.select("match_id", "market", F.concat_ws("-", F.col("ft_home").cast("string"), F.col("ft_away").cast("string")).alias("score"),
                    "pick", F.col("hit").cast("int").alias("hit"))
