"""Queries: upserts, diffs, reconciliation, retention, live folds, set operations (M7, M8 batch twins)."""
from pyspark.sql import functions as F

from touchline.operators import compose as co
from touchline.operators import odds as od
from touchline.operators import sync as sy
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, sql
from touchline.plans.q_coupons import coupons, legs
from touchline.plans.q_markets import NOW_SQL
from touchline.plans.q_model import stale
from touchline.plans.registry import query

LIVE_SQL = f"TIMESTAMP '{D.NOW_LIVE}'"

# wanted state of keyed events: two thirds of the stored keys (a third of them changed) plus new keys
CTE["ev_old"] = (["sev"], "SELECT external_ref, sport, home_team, status FROM sev WHERE external_ref IS NOT NULL")
CTE["ev_new"] = (["sev"], """
  SELECT CASE WHEN event_id % 3 = 0 THEN 'new:' || event_id ELSE external_ref END AS external_ref, CASE WHEN event_id % 6 = 4 THEN '' ELSE sport END AS sport, home_team,
    CASE WHEN event_id % 3 = 1 AND event_id % 2 = 1 THEN 'cancelled' ELSE status END AS status FROM sev WHERE external_ref IS NOT NULL""")
COLS = ["sport", "home_team", "status"]


def ev_old(spark, d):
    return D.sport_events(spark, d).filter("external_ref IS NOT NULL").select("external_ref", *COLS)


def ev_new(spark, d):
    return D.sport_events(spark, d).filter("external_ref IS NOT NULL").selectExpr(
        "IF(event_id % 3 = 0, concat('new:', event_id), external_ref) AS external_ref", "IF(event_id % 6 = 4, '', sport) AS sport", "home_team",
        "IF(event_id % 3 = 1 AND event_id % 2 = 1, 'cancelled', status) AS status")


@query("s18_upsert", sql("ev_old ev_new", """
SELECT coalesce(n.external_ref, o.external_ref) AS external_ref, CASE WHEN n.external_ref IS NULL THEN o.sport ELSE n.sport END AS sport,
  CASE WHEN n.external_ref IS NULL THEN o.home_team ELSE n.home_team END AS home_team, CASE WHEN n.external_ref IS NULL THEN o.status ELSE n.status END AS status
FROM ev_old o FULL OUTER JOIN ev_new n ON o.external_ref = n.external_ref"""))
def s18_upsert(spark, d):
    return sy.upsert(ev_old(spark, d), ev_new(spark, d), "external_ref", COLS)


@query("s18_upsert_outcomes", sql("ev_old ev_new", """
SELECT CASE WHEN o.external_ref IS NULL THEN 'create' WHEN o.sport <> n.sport OR o.home_team <> n.home_team OR o.status <> n.status THEN 'update' ELSE 'keep' END AS action, count(*) AS n
FROM ev_new n LEFT JOIN ev_old o ON o.external_ref = n.external_ref GROUP BY 1"""))
def s18_upsert_outcomes(spark, d):
    return sy.upsert_counts(ev_old(spark, d), ev_new(spark, d), "external_ref", COLS)


@query("j21_diff", sql("ev_old ev_new", """
SELECT coalesce(n.external_ref, o.external_ref) AS external_ref, CASE WHEN o.external_ref IS NULL THEN 'create' WHEN n.external_ref IS NULL THEN 'absent'
  WHEN (n.sport <> '' AND o.sport <> n.sport) OR o.home_team <> n.home_team OR o.status <> n.status THEN 'update' ELSE 'keep' END AS action
FROM ev_old o FULL OUTER JOIN ev_new n ON o.external_ref = n.external_ref"""))
def j21_diff(spark, d):
    """An empty wanted sport never overwrites a stored one."""
    return sy.diff(ev_old(spark, d), ev_new(spark, d), "external_ref", COLS, keep_when_empty=["sport"]).select("external_ref", "action")


@query("s18_fixture_outcomes", sql("lm", """
SELECT CASE WHEN match_id % 4 = 0 THEN 'inserted' WHEN status = 'finished' THEN 'skipped' ELSE 'updated' END AS outcome, count(*) AS n FROM lm GROUP BY 1"""))
def s18_fixture_outcomes(spark, d):
    """Also ST5: a finished match is never downgraded."""
    m = D.live_matches(spark, d)
    fx = m.selectExpr("match_id AS k", "league", "kickoff")
    out = sy.upsert_fixtures(m.filter("match_id % 4 <> 0").selectExpr("match_id AS k", "status"), fx, ["k"])
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


@query("s19_replace_predictions", sql("m", """
SELECT match_id, CASE WHEN match_id % 3 = 0 THEN 'new' ELSE 'old' END AS version, count(*) AS n FROM (
  SELECT match_id FROM m WHERE match_id % 3 <> 0 UNION ALL SELECT match_id FROM m WHERE match_id % 3 <> 0 UNION ALL SELECT match_id FROM m WHERE match_id % 3 = 0) z GROUP BY 1, 2"""))
def s19_replace_predictions(spark, d):
    m = D.matches(spark, d)
    stored = m.selectExpr("match_id", "explode(array('old', 'old')) AS version")
    fresh = m.filter("match_id % 3 = 0").selectExpr("match_id", "'new' AS version")
    return sy.replace_predictions(stored, fresh).groupBy("match_id", "version").agg(F.count("*").alias("n"))


@query("s19_skip_predicted", sql("m", "SELECT match_id FROM m WHERE status = 'finished' AND match_id % 3 <> 0"))
def s19_skip_predicted(spark, d):
    m = D.matches(spark, d)
    return m.filter("status = 'finished'").join(m.filter("match_id % 3 = 0").select("match_id"), "match_id", "left_anti").select("match_id")


CTE["sigs"] = (["legs"], """
  SELECT generated_on, coupon_id, substr(sha256(string_agg(leg_match || '|' || market || '|' || selection, '||' ORDER BY leg_match || '|' || market || '|' || selection)), 1, 32) AS signature FROM legs GROUP BY generated_on, coupon_id""")


@query("s20_new_coupons", sql("sigs", "SELECT DISTINCT generated_on, signature FROM sigs WHERE coupon_id % 2 = 1"))
def s20_new_coupons(spark, d):
    """Also ST10: the even coupons are stored, everything is offered twice, only the rest is new."""
    h = co.coupon_headers(legs(spark, d), ["generated_on", "coupon_id"]).select("generated_on", "coupon_id", "signature")
    stored = h.filter("coupon_id % 2 = 0").select("generated_on", "signature")
    return sy.append_new(stored, h.unionByName(h).select("generated_on", "signature"), ["generated_on", "signature"])


@query("s21_bulk_totals", sql("m", "SELECT league, count(*) AS matches, count(DISTINCT season) AS seasons FROM m WHERE league IN ('L0', 'L1', 'L3') AND league <> 'L3' GROUP BY league"))
def s21_bulk_totals(spark, d):
    from touchline.sources import landed
    return landed.league_totals(D.matches(spark, d), only=["L0", "L1", "L3"], skip=["L3"])


@query("s22_purge_report", sql("m", f"""
SELECT count(*) FILTER (WHERE status = 'scheduled' AND kickoff < {NOW_SQL}) AS deleted, count(*) FILTER (WHERE status = 'finished') AS kept_finished,
  count(*) FILTER (WHERE status = 'scheduled' AND kickoff >= {NOW_SQL}) AS kept_future FROM m"""))
def s22_purge_report(spark, d):
    return sy.purge_report(D.matches(spark, d), D.now())


@query("s22_purged_matches", sql("m", f"SELECT match_id FROM m WHERE NOT (status = 'scheduled' AND kickoff < {NOW_SQL})"))
def s22_purged_matches(spark, d):
    return sy.purge(D.matches(spark, d), D.now()).select("match_id")


@query("j22_ghosts", sql("sev", f"""
SELECT event_id FROM sev WHERE status = 'scheduled' AND kickoff >= {LIVE_SQL} AND kickoff < {LIVE_SQL} + INTERVAL 3 DAY AND external_ref IS NOT NULL AND event_id % 5 = 0"""))
def j22_ghosts(spark, d):
    e = D.sport_events(spark, d).filter("external_ref IS NOT NULL")
    n = D.now(D.NOW_LIVE)
    return sy.ghosts(e, e.filter("event_id % 5 <> 0").select("external_ref"), n, n + F.expr("INTERVAL 3 DAYS")).select("event_id")


@query("j22_ghosts_nothing_listed", sql("sev", "SELECT event_id FROM sev WHERE FALSE"))
def j22_ghosts_nothing_listed(spark, d):
    e = D.sport_events(spark, d).filter("external_ref IS NOT NULL")
    n = D.now(D.NOW_LIVE)
    return sy.ghosts(e, e.filter("sport = 'chess'").select("external_ref"), n, n + F.expr("INTERVAL 3 DAYS")).select("event_id")


@query("st8_retention", sql("sev", f"""
SELECT event_id FROM sev WHERE kickoff < {LIVE_SQL} - INTERVAL 2 DAY OR (external_ref IS NULL AND kickoff >= {LIVE_SQL} - INTERVAL 2 DAY AND kickoff <= {LIVE_SQL} + INTERVAL 7 DAY)"""))
def st8_retention(spark, d):
    return sy.prunable(D.sport_events(spark, d), D.now(D.NOW_LIVE)).select("event_id")


@query("u_1_union_events", sql("sev m", """
SELECT source, count(*) AS n, count(away_team) AS with_away, count(venue) AS with_venue FROM (
  SELECT 'sport' AS source, external_ref, away_team, NULL AS venue FROM sev UNION ALL SELECT 'football', 'm:' || match_id, NULL, 'Ground ' || home_team_id FROM m) z GROUP BY source"""))
def u_1_union_events(spark, d):
    a = D.sport_events(spark, d).selectExpr("'sport' AS source", "external_ref", "away_team")
    b = D.matches(spark, d).selectExpr("'football' AS source", "concat('m:', match_id) AS external_ref", "concat('Ground ', home_team_id) AS venue")
    u = a.unionByName(b, allowMissingColumns=True)
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count("away_team").alias("with_away"), F.count("venue").alias("with_venue"))


@query("u_3_code_intersection", sql("m", "SELECT DISTINCT league FROM m WHERE league IN (SELECT DISTINCT league FROM m WHERE home_team_id < 300) AND league IN ('L1', 'L2', 'L9')"))
def u_3_code_intersection(spark, d):
    m = D.matches(spark, d)
    return m.filter("league IN ('L1', 'L2', 'L9')").select("league").intersect(m.filter("home_team_id < 300").select("league"))


@query("u_4_wanted_minus_done", sql("m", "SELECT home_team_id AS team_id FROM m EXCEPT SELECT away_team_id FROM m WHERE match_id % 7 = 0 AND away_team_id % 3 <> 0"))
def u_4_wanted_minus_done(spark, d):
    m = D.matches(spark, d)
    return m.selectExpr("home_team_id AS team_id").distinct().join(m.filter("match_id % 7 = 0 AND away_team_id % 3 <> 0").selectExpr("away_team_id AS team_id").distinct(), "team_id", "left_anti")


@query("u_5_map_merge", sql("prov", """
SELECT row_id, CASE WHEN row_id % 20 = 0 THEN away_name ELSE home_name END AS name FROM prov WHERE row_id % 20 = 0 OR NOT regexp_matches(home_name, ' City$')"""))
def u_5_map_merge(spark, d):
    """The right map wins; left entries on the deny pattern are evicted before the merge."""
    p = D.provider_rows(spark, d)
    left = p.filter("NOT (home_name RLIKE ' City$')").selectExpr("row_id", "home_name AS name")
    return sy.merge_maps(left, p.filter("row_id % 20 = 0").selectExpr("row_id", "away_name AS name"), "row_id")


CTE["folded"] = (["feed"], """
  SELECT match_id, CASE WHEN closed THEN 'finished' WHEN ls = 'PAUSED' THEN 'paused' ELSE 'in_play' END AS status, CASE WHEN closed THEN NULL ELSE lm END AS live_minute,
    CASE WHEN closed THEN NULL ELSE lh END AS live_home, CASE WHEN closed THEN NULL ELSE la END AS live_away, fh AS ft_home, fa AS ft_away FROM (
   SELECT match_id, bool_or(status = 'FINISHED') AS closed, arg_max(status, event_id) FILTER (WHERE status <> 'FINISHED') AS ls,
    arg_max(event_id % 90 + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END, event_id) FILTER (WHERE status <> 'FINISHED') AS lm, arg_max(home_goals, event_id) FILTER (WHERE status <> 'FINISHED') AS lh,
    arg_max(away_goals, event_id) FILTER (WHERE status <> 'FINISHED') AS la, arg_min(home_goals, event_id) FILTER (WHERE status = 'FINISHED' AND home_goals IS NOT NULL) AS fh, arg_min(away_goals, event_id) FILTER (WHERE status = 'FINISHED' AND away_goals IS NOT NULL) AS fa
   FROM feed WHERE status IN ('IN_PLAY', 'PAUSED', 'FINISHED') GROUP BY match_id) z""")


@query("st1_live_fold", sql("folded", "SELECT match_id, status, live_minute, live_home, live_away, ft_home, ft_away FROM folded"))
def st1_live_fold(spark, d):
    """Batch twin of the live stream; also S12."""
    return sy.fold_live(D.live_feed(spark, d))


@query("st3_finalise_stuck", sql("lm", f"""
SELECT match_id, CASE WHEN x THEN 'finished' ELSE status END AS status, CASE WHEN x THEN live_home ELSE ft_home END AS ft_home, CASE WHEN x THEN live_away ELSE ft_away END AS ft_away,
  CASE WHEN x THEN NULL ELSE live_home END AS live_home FROM (
 SELECT *, status IN ('paused', 'in_play') AND kickoff < {NOW_SQL} - INTERVAL 6 HOUR AND (ft_home IS NULL OR ft_away IS NULL) AND live_home IS NOT NULL AND live_away IS NOT NULL AS x FROM lm) z"""))
def st3_finalise_stuck(spark, d):
    return sy.finalise_stuck(D.live_matches(spark, d), D.now()).select("match_id", "status", "ft_home", "ft_away", "live_home")


@query("st5_insert_once_prices", sql("odds", """
SELECT match_id, source, market, selection, count(*) AS n, round(arg_min(decimal_odds, odds_id), 6) AS odds FROM odds GROUP BY 1, 2, 3, 4"""))
def st5_insert_once_prices(spark, d):
    """Every price arrives again later with another value; each key is stored once, with its first price."""
    o = D.odds(spark, d).select("match_id", "source", "market", "selection", "decimal_odds", "fetched_at", "odds_id")
    key = ["match_id", "source", "market", "selection"]
    again = o.withColumns({"decimal_odds": F.col("decimal_odds") + 1, "fetched_at": F.col("fetched_at") + F.expr("INTERVAL 5 HOURS")})
    kept = sy.append_new(o.filter("FALSE"), again.unionByName(o), key, ["fetched_at", "odds_id"])
    return kept.groupBy(*key).agg(F.count("*").alias("n"), F.round(F.first("decimal_odds"), 6).alias("odds"))


@query("st5_status_guard", sql("lm", """
SELECT match_id, CASE WHEN status = 'finished' OR match_id % 2 = 0 THEN 'finished' ELSE 'in_play' END AS status, CASE WHEN status = 'finished' THEN ft_home WHEN match_id % 2 = 0 THEN 7 ELSE ft_home END AS ft_home FROM lm"""))
def st5_status_guard(spark, d):
    """A running row comes for every match and a final one for every even match, twice: finished rows and their scores stay."""
    m = D.live_matches(spark, d).select("match_id", "status", F.col("ft_home").cast("int").alias("ft_home"), F.col("ft_away").cast("int").alias("ft_away"))
    late = m.selectExpr("match_id", "'in_play' AS status", "CAST(NULL AS INT) AS ft_home", "CAST(NULL AS INT) AS ft_away")
    final = m.filter("match_id % 2 = 0").selectExpr("match_id", "'finished' AS status", "7 AS ft_home", "7 AS ft_away")
    cols = ["status", "ft_home", "ft_away"]
    once = sy.upsert_matches(m, late.unionByName(final).unionByName(late), "match_id", cols)
    return sy.upsert_matches(once, late, "match_id", cols).select("match_id", "status", "ft_home")


@query("s18_fixture_table", sql("lm", """
SELECT match_id AS k, CASE WHEN match_id % 4 = 0 THEN 'scheduled' ELSE status END AS status, CASE WHEN match_id % 4 <> 0 AND status = 'finished' THEN 'old' ELSE 'new' END AS league FROM lm"""))
def s18_fixture_table(spark, d):
    """The table a fixture load leaves: a quarter of the rows is new, finished rows stay as they are."""
    m = D.live_matches(spark, d)
    before = m.filter("match_id % 4 <> 0").selectExpr("match_id AS k", "status", "'old' AS league")
    return sy.fixture_table(before, m.selectExpr("match_id AS k", "'new' AS league"), ["k"], ["league"]).select("k", "status", "league")


@query("st6_closed_coupons", sql("coup", "SELECT coupon_id, CAST(hit AS INTEGER) AS hit FROM coup WHERE hit IS NOT NULL"))
def st6_closed_coupons(spark, d):
    """Also ST7: one row per coupon that closed."""
    return coupons(spark, d).filter("hit IS NOT NULL").selectExpr("coupon_id", "CAST(hit AS INT) AS hit")


@query("st9_latest_prices", sql("odds", """
SELECT match_id, market, selection, decimal_odds AS odds FROM (SELECT match_id, replace(market, 'OU_', 'over_under_') AS market, selection, decimal_odds,
  row_number() OVER (PARTITION BY match_id, market, selection ORDER BY fetched_at DESC, odds_id DESC) AS rn FROM odds) z WHERE rn = 1"""))
def st9_latest_prices(spark, d):
    return od.latest_prices(D.odds(spark, d))
