"""Queries: rolling calibration, calibrated predictions, bets and reports of the walk-forward back-test (U3, W13, J14, A17-A21)."""
from pyspark.sql import functions as F

from touchline.operators import evaluate as ev
from touchline.operators import odds as od
from touchline.operators import rolling
from touchline.operators import timeline as tl
from touchline.plans import backtest as bt
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, sql
from touchline.plans.q_markets import r6
from touchline.plans.registry import query
from touchline.session import stored

# Predictions with given rates: matches past the training start of their league; pairs of teams whose numbers add up to a
# multiple of nine stand for teams a fit has not seen, so the timelines have holes.
CTE["outs"] = (["mp"], """
  SELECT *, row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 1 AS seq FROM (
    SELECT match_id, league, kickoff, ft_home, ft_away, idx, gidx, max(CASE WHEN k = '1X21' THEN prob END) AS p1, max(CASE WHEN k = '1X2X' THEN prob END) AS px,
      max(CASE WHEN k = '1X22' THEN prob END) AS p2, max(CASE WHEN k = 'over_under_2.5over' THEN prob END) AS po, max(CASE WHEN k = 'over_under_2.5under' THEN prob END) AS pu
    FROM (SELECT mp.*, market || selection AS k, i.idx, i.gidx FROM mp JOIN (SELECT match_id, row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 1 AS idx,
            row_number() OVER (ORDER BY kickoff, match_id) - 1 AS gidx FROM m WHERE status = 'finished') i USING (match_id))
    WHERE idx >= 200 AND (home_team_id + away_team_id) % 9 <> 0 GROUP BY match_id, league, kickoff, ft_home, ft_away, idx, gidx)""")


def _chain(clock):
    return f"""
  SELECT league, CAST(0 AS BIGINT) AS k, min({clock}) AS c FROM outs WHERE seq >= {rolling.MINIMUM - 1} GROUP BY league
  UNION ALL SELECT f.league, f.k + 1, min(p.{clock}) FROM {{me}} f JOIN outs p ON p.league = f.league AND p.{clock} >= f.c + {rolling.EVERY} GROUP BY f.league, f.k, f.c"""


CTE["fitted"] = (["outs"], _chain("idx").format(me="fitted"))
CTE["gfitted"] = (["outs"], _chain("gidx").format(me="gfitted"))
CTE["book"] = (["outs", "fitted"], """
  SELECT p.match_id, p.league, p.idx, p.seq, f.k AS serves, x.market, x.l, x.y FROM outs p ASOF LEFT JOIN fitted f ON p.league = f.league AND p.idx > f.c,
    LATERAL (VALUES ('1X2', [ln(greatest(p1, 1e-12)), ln(greatest(px, 1e-12)), ln(greatest(p2, 1e-12))], CASE WHEN ft_home > ft_away THEN 1 WHEN ft_home < ft_away THEN 3 ELSE 2 END),
      ('over_under_2.5', [ln(greatest(po, 1e-12)), ln(greatest(pu, 1e-12))], CASE WHEN ft_home + ft_away > 2.5 THEN 1 ELSE 2 END)) x(market, l, y)""")
CTE["trained"] = (["book"], f"""
  SELECT f.league, f.k AS fit, b.market, b.l, b.y FROM fitted f JOIN outs p ON p.league = f.league AND p.idx = f.c
    JOIN book b ON b.league = f.league AND b.seq <= p.seq AND b.seq > p.seq - {rolling.WINDOW}""")
# the mean likelihood is convex in 1/T, so its slope is cut in half again and again
CTE["halved"] = (["trained"], """
  SELECT league, fit, market, 0 AS step, 0.05e0 AS lo, 20e0 AS hi FROM trained GROUP BY league, fit, market
  UNION ALL SELECT league, fit, market, step + 1, CASE WHEN s < 0 THEN mid ELSE lo END, CASE WHEN s < 0 THEN hi ELSE mid END FROM (
    SELECT h.league, h.fit, h.market, h.step, h.lo, h.hi, (h.lo + h.hi) / 2 AS mid,
      sum(list_sum(list_transform(t.l, lambda x: exp((h.lo + h.hi) / 2 * x) * x)) / list_sum(list_transform(t.l, lambda x: exp((h.lo + h.hi) / 2 * x))) - t.l[t.y]) AS s
    FROM halved h JOIN trained t ON h.league = t.league AND h.fit = t.fit AND h.market = t.market WHERE h.step < 42 GROUP BY h.league, h.fit, h.market, h.step, h.lo, h.hi) z""")
CTE["temps"] = (["halved"], """
  SELECT h.league, h.fit, h.market, 2 / (h.lo + h.hi) AS T, c.n FROM halved h JOIN (SELECT league, fit, market, count(*) AS n FROM trained GROUP BY league, fit, market) c USING (league, fit, market)
  WHERE step = 42""")
CTE["calibrated"] = (["temps"], """
  SELECT match_id, league, market, selection, q / sum(q) OVER (PARTITION BY match_id, market) AS prob, y = pos AS won FROM (
    SELECT match_id, league, market, y, unnest(CASE WHEN market = '1X2' THEN ['1', 'X', '2'] ELSE ['over', 'under'] END) AS selection,
      unnest(range(1, len(l) + 1)) AS pos, unnest(list_transform(l, lambda x: exp(x / coalesce(T, 1)))) AS q
    FROM book LEFT JOIN (SELECT league, fit AS serves, market, T FROM temps) t USING (league, serves, market)) z""")


def given(spark, d):
    """Out-of-sample rows with given rates, on their league's timeline (idx) and the one of all leagues (gidx)."""
    m = D.matches(spark, d).filter("status = 'finished'").select("match_id", "league", "kickoff", "home_team_id", "away_team_id", "ft_home", "ft_away")
    x = tl.with_row_index(tl.with_row_index(m, "kickoff", "match_id", "league", "idx"), "kickoff", "match_id", name="gidx")
    return D.with_rates(x.filter(f"idx >= {bt.MIN_TRAIN} AND (home_team_id + away_team_id) % 9 <> 0"))


@query("w13_rolling_calibration", sql("temps", "SELECT league, fit, market, round(T, 6) AS T, n FROM temps"))
def w13_rolling_calibration(spark, d):
    """Temperatures per league and market from the last 500 predictions, at every refit."""
    _, fits = bt.calibrate(given(spark, d))
    return fits.select("league", "fit", "market", r6("T", "T"), "n")


@query("w13_pooled_refits", sql("gfitted", """
SELECT p.match_id, f.k AS serves, p.gidx IN (SELECT c FROM gfitted) AS refit FROM outs p ASOF LEFT JOIN gfitted f ON p.league = f.league AND p.gidx > f.c"""))
def w13_pooled_refits(spark, d):
    """Refits of each league's calibrator when the distance between them is counted on the timeline of all leagues."""
    rows = tl.with_row_index(given(spark, d).select("match_id", "league", "kickoff", "gidx"), "kickoff", "match_id", "league", "seq")
    return rolling.refits(rows.drop("kickoff"), "league", "seq", "gidx").select("match_id", "serves", "refit")


@query("j14_calibrated_predictions", sql("calibrated", "SELECT match_id, market, selection, round(prob, 6) AS prob FROM calibrated"))
def j14_calibrated_predictions(spark, d):
    """Every out-of-sample prediction under the newest calibrator fitted before it."""
    cal, _ = bt.calibrate(given(spark, d))
    both = cal.selectExpr("match_id", "market", "inline(arrays_zip(IF(market = '1X2', array('1', 'X', '2'), array('over', 'under')), p))")
    return both.toDF("match_id", "market", "selection", "prob").withColumn("prob", F.round("prob", 6))


@query("u3_calibrated_losses", sql("calibrated", """
SELECT coalesce(league, 'overall') AS league, count(*) AS n, round(avg(brier), 6) AS brier, round(avg(logloss), 6) AS logloss FROM (
  SELECT match_id, league, sum(pow(prob - CASE WHEN won THEN 1 ELSE 0 END, 2)) AS brier, -ln(greatest(max(CASE WHEN won THEN prob END), 1e-12)) AS logloss
  FROM calibrated WHERE market = '1X2' GROUP BY match_id, league) z GROUP BY GROUPING SETS ((league), ())"""))
def u3_calibrated_losses(spark, d):
    cal, _ = bt.calibrate(given(spark, d))
    return bt.losses(cal).select("league", "n", r6("brier", "brier"), r6("logloss", "logloss"))


def _bet_sql(sources):
    """Bets at the price whose source comes first in the list, as ROI by threshold."""
    rank = " ".join(f"WHEN '{x}' THEN {i}" for i, x in enumerate(sources))
    return f""",
 t AS (SELECT * FROM (VALUES (0.0e0), (0.01e0), (0.02e0), (0.03e0), (0.05e0), (0.08e0)) v(threshold)),
 price AS (SELECT match_id, market, selection, decimal_odds AS odds FROM (SELECT match_id, replace(market, 'OU_', 'over_under_') AS market, selection, decimal_odds, row_number() OVER (
    PARTITION BY match_id, market, selection ORDER BY CASE source {rank} ELSE 99 END, odds_id) AS rn FROM odds) z WHERE rn = 1),
 b AS (SELECT league, market, prob * odds - 1 AS edge, odds, won FROM calibrated JOIN price USING (match_id, market, selection) WHERE prob * odds - 1 > 0),
 g AS (SELECT DISTINCT league, market FROM b)
SELECT g.league, g.market, t.threshold, count(b.edge) AS n, round(avg(CASE WHEN won THEN 1e0 WHEN NOT won THEN 0e0 END), 6) AS win_rate, round(avg(CASE WHEN won THEN odds - 1 ELSE -1 END) FILTER (WHERE b.edge IS NOT NULL), 6) AS roi
FROM g CROSS JOIN t LEFT JOIN b ON b.league = g.league AND b.market = g.market AND b.edge > t.threshold GROUP BY g.league, g.market, t.threshold"""


def _bets(spark, d, priority):
    cal, _ = bt.calibrate(given(spark, d))
    g = ev.roi_by_threshold(bt.bets(cal, D.odds(spark, d), priority=priority), group=["league", "market"])
    return g.select("league", "market", "threshold", "n", r6("win_rate", "win_rate"), r6("roi", "roi"))


@query("u3_bets_by_threshold", sql("calibrated odds", _bet_sql(["B365", "B365C", "PSC"])))
def u3_bets_by_threshold(spark, d):
    """Bets of calibrated predictions at opening prices: ROI per league, market and edge threshold."""
    return _bets(spark, d, od.OPENING_PRIORITY)


@query("u3_bets_at_closing", sql("calibrated odds", _bet_sql(["B365C", "PSC", "B365"])))
def u3_bets_at_closing(spark, d):
    """The same at closing prices."""
    return _bets(spark, d, od.CLOSING_PRIORITY)


@query("u3_reliability", sql("calibrated", """
SELECT greatest(1, CAST(ceil(prob * 10) AS BIGINT)) AS bin, count(*) AS n, round(avg(prob), 6) AS predicted, round(avg(CASE WHEN won THEN 1e0 ELSE 0e0 END), 6) AS actual
FROM calibrated WHERE market = '1X2' GROUP BY 1"""))
def u3_reliability(spark, d):
    cal, _ = bt.calibrate(given(spark, d))
    return bt.reliability(cal).select("bin", "n", r6("predicted", "predicted"), r6("actual", "actual"))


def _walked(spark, d, **how):
    cal, fits = bt.calibrate(bt.walk_forward(D.matches(spark, d), **how))
    x = bt.report(cal, fits, stored(bt.bets(cal, D.odds(spark, d))))
    return x.select("league", "n", *[r6(c, c) for c in ("brier", "logloss")], "fits", *[r6(c, c) for c in ("t_1x2", "t_ou25")], "bets", *[r6(c, c) for c in ("roi", "best_roi")])


@query("u3_walk_forward_league")
def u3_walk_forward_league(spark, d):
    """Per-league walk-forward, refitted every 20 matches from the 200th on: losses, calibrators, bets."""
    return _walked(spark, d)


@query("u3_walk_forward_pooled")
def u3_walk_forward_pooled(spark, d):
    """One model of all leagues on their common timeline; calibrators per league, with distances on that timeline."""
    return _walked(spark, d, pooled=True)
