"""Queries: fits, walk-forward, predictions, training frames, match listings (M5, U6, P1-P7)."""
import datetime
import zoneinfo

from pyspark.sql import functions as F

from touchline.functions import times
from touchline.operators import evaluate as ev
from touchline.operators import features as ft
from touchline.operators import fit
from touchline.operators import markets as mk
from touchline.plans import backtest as bt
from touchline.plans import derive as D
from touchline.plans import predict as pr
from touchline.plans.oracle import CTE, sql
from touchline.plans.q_markets import NOW_SQL, r6
from touchline.plans.registry import query
from touchline.session import stored

XI, L2 = 0.0018, 2.0


def full_fit(spark, d):
    """One pooled fit on everything finished before NOW, goal signal from xG where both sides have it: (statistics, parameters)."""
    m = D.matches(spark, d).filter(F.col("kickoff") < D.now())
    stats = stored(fit.pair_stats(fit.training_frame(m), XI, D.NOW))
    return stats, fit.fit_pooled(stats, L2)


@query("u1_full_fit")
def u1_full_fit(spark, d):
    return full_fit(spark, d)[1].drop("fold")


@query("u1_fit_properties", sql("m", f"""
SELECT coalesce(league, 'all') AS league, parameter, count(*) AS parameters, 1 AS flat FROM (
  SELECT league, unnest(['attack', 'defence']) AS parameter FROM (SELECT league, home_team_id AS t FROM m WHERE status = 'finished' AND kickoff < {NOW_SQL}
    UNION SELECT league, away_team_id FROM m WHERE status = 'finished' AND kickoff < {NOW_SQL}) z
  UNION ALL SELECT DISTINCT league, unnest(['gamma', 'delta']) FROM m WHERE status = 'finished' AND kickoff < {NOW_SQL}
  UNION ALL SELECT NULL, 'rho') y GROUP BY 1, 2"""))
def u1_fit_properties(spark, d):
    """At the fitted parameters the likelihood is flat in every direction, seen by Spark's own sums over the pair statistics."""
    g = fit.slopes(*full_fit(spark, d), L2)
    return g.groupBy(F.coalesce("league", F.lit("all")).alias("league"), "parameter").agg(
        F.count("*").alias("parameters"), F.min((F.abs("slope") <= 1e-6 * F.greatest("weight", F.lit(1.0))).cast("int")).alias("flat"))


@query("u1_fit_beats_start", sql("m", "SELECT DISTINCT 'all' AS grp, 1 AS better FROM m"))
def u1_fit_beats_start(spark, d):
    """The fitted likelihood against the one at the starting values."""
    stats, params = full_fit(spark, d)
    lam, mu, rho = f"exp({fit.START_GAMMA}D)", "1D", f"{fit.START_RHO}D"
    start = stats.groupBy("grp").agg(F.expr(
        f"-sum(wh * ln({lam}) - w * {lam} - w * {mu} + w00 * ln(1 - {lam} * {mu} * {rho}) + w01 * ln(1 + {lam} * {rho}) + w10 * ln(1 + {mu} * {rho}) + w11 * ln(1 - {rho}))").alias("at_start"))
    return params.groupBy("grp").agg(F.first("nll").alias("nll")).join(start, "grp").selectExpr("grp", "CAST(nll < at_start AS INT) AS better")


@query("u1_pair_statistics", sql("m", f"""
SELECT league, home_team_id, away_team_id, round(sum(w), 6) AS w, round(sum(w * hg), 6) AS wh, round(sum(w * ag), 6) AS wa,
  round(sum(CASE WHEN hg = 0 AND ag = 0 THEN w ELSE 0 END), 6) AS w00, round(sum(CASE WHEN hg = 1 AND ag = 1 THEN w ELSE 0 END), 6) AS w11
FROM (SELECT league, home_team_id, away_team_id, exp(-0.0018e0 * date_diff('day', kickoff, {NOW_SQL})) AS w,
    CASE WHEN xg_home IS NOT NULL THEN xg_home ELSE ft_home END AS hg, CASE WHEN xg_home IS NOT NULL THEN xg_away ELSE ft_away END AS ag
  FROM m WHERE status = 'finished' AND kickoff < {NOW_SQL}) z GROUP BY league, home_team_id, away_team_id"""))
def u1_pair_statistics(spark, d):
    m = D.matches(spark, d).filter(F.col("kickoff") < D.now())
    s = fit.pair_stats(fit.training_frame(m), XI, D.NOW)
    return s.select("league", "home_team_id", "away_team_id", *[r6(c, c) for c in ("w", "wh", "wa", "w00", "w11")])


_IDX = "row_number() OVER (PARTITION BY league ORDER BY kickoff, match_id) - 1"


@query("u3_fold_training_sums", sql("m", f""",
 x AS (SELECT *, {_IDX} AS idx, CASE WHEN {_IDX} < 100 THEN -1 ELSE CAST(floor(({_IDX} - 100) / 200) AS BIGINT) END AS fold FROM m WHERE status = 'finished'),
 st AS (SELECT league, fold, arg_min(kickoff, idx) AS t, min(idx) AS i0 FROM x WHERE fold >= 0 GROUP BY league, fold)
SELECT st.league, st.fold, count(DISTINCT x.home_team_id * 100000 + x.away_team_id) AS pairs, round(sum(exp(-0.0018e0 * date_diff('day', x.kickoff, st.t))), 6) AS w,
  round(sum(exp(-0.0018e0 * date_diff('day', x.kickoff, st.t)) * x.ft_home), 6) AS wh
FROM st JOIN x ON x.league = st.league AND x.idx < st.i0 GROUP BY st.league, st.fold"""))
def u3_fold_training_sums(spark, d):
    """Running fold sums equal the sums over each fold's whole prefix."""
    rows = bt.numbered(D.matches(spark, d), pooled=False, min_train=100, refit_every=200)
    s = fit.fold_stats(rows, XI).groupBy("league", "fold").agg(F.count("*").alias("pairs"), F.sum("w").alias("w"), F.sum("wh").alias("wh"))
    return s.select("league", "fold", "pairs", r6("w", "w"), r6("wh", "wh"))


@query("u2_gauge_fix", sql("teams", """
SELECT league, team_id, round(a - avg(a) OVER (PARTITION BY league), 6) AS attack, round(b - avg(b) OVER (PARTITION BY league), 6) AS defence,
  round(0.1e0 + avg(a) OVER (PARTITION BY league) + avg(b) OVER (PARTITION BY league), 6) AS delta
FROM (SELECT league, team_id, ((team_id * 37) % 21 - 10) / 25.0e0 AS a, ((team_id * 53) % 21 - 10) / 25.0e0 AS b FROM teams) z"""))
def u2_gauge_fix(spark, d):
    t = D.teams(spark, d).selectExpr("league", "team_id", "((team_id * 37) % 21 - 10) / 25D AS attack",
                                     "((team_id * 53) % 21 - 10) / 25D AS defence", "0.1D AS delta")
    return fit.gauge_fix(t).select("league", "team_id", *[r6(c, c) for c in ("attack", "defence", "delta")])


@query("t8_strongest_teams", sql("teams", """
SELECT 'attack' AS side, team_id, round(((team_id * 37) % 21 - 10) / 25.0e0, 6) AS strength FROM teams
QUALIFY row_number() OVER (ORDER BY (team_id * 37) % 21 DESC, team_id) <= 5
UNION ALL SELECT 'defence', team_id, round(((team_id * 53) % 21 - 10) / 25.0e0, 6) FROM teams
QUALIFY row_number() OVER (ORDER BY (team_id * 53) % 21, team_id) <= 5"""))
def t8_strongest_teams(spark, d):
    t = D.teams(spark, d).selectExpr("team_id", "((team_id * 37) % 21 - 10) / 25D AS attack", "((team_id * 53) % 21 - 10) / 25D AS defence")
    a = t.orderBy(F.desc("attack"), "team_id").limit(5).selectExpr("'attack' AS side", "team_id", "round(attack, 6) AS strength")
    b = t.orderBy("defence", "team_id").limit(5).selectExpr("'defence' AS side", "team_id", "round(defence, 6) AS strength")
    return a.unionByName(b)


CTE["adj"] = (["r", "sig"], """
  SELECT match_id, rho, lam * greatest(0.85e0, least(1.15e0, (1 + 0.08e0 * h_rel) * (1 + 0.06e0 * h_tit) * (1 + 0.04e0 * h_eur) * (1 - 0.1e0 * h_dead))) * (1 + 0.05e0 * a_dead) AS lam,
    mu * greatest(0.85e0, least(1.15e0, (1 + 0.08e0 * a_rel) * (1 + 0.06e0 * a_tit) * (1 + 0.04e0 * a_eur) * (1 - 0.1e0 * a_dead))) * (1 + 0.05e0 * h_dead) AS mu
  FROM r JOIN sig USING (match_id) WHERE status <> 'finished' AND kickoff >= TIMESTAMP '2001-01-01 00:00:00'""")


# the markets of the pair tables, for the adjusted rates of single matches
for _name in ("cells", "wide", "long"):
    _text = CTE[f"pair_{_name}"][1].replace("w.home_team_id, w.away_team_id", "w.match_id").replace("home_team_id, away_team_id", "match_id")
    CTE[f"adj_{_name}"] = ([{"cells": "adj", "wide": "adj_cells", "long": "adj_wide"}[_name]],
                           _text.replace("pair_rates", "adj").replace("pair_cells", "adj_cells").replace("pair_wide", "adj_wide"))


@query("u6_prediction_batch", sql("adj_long", "SELECT match_id, market, selection, round(prob, 6) AS prob FROM adj_long"))
def u6_prediction_batch(spark, d):
    """Rates, motivation, matrix and all markets of everything still to play."""
    m = D.matches(spark, d)
    p = pr.market_rows(pr.predict(D.with_rates(pr.select_targets(m, D.NOW)), m))
    return p.select("match_id", "market", "selection", r6("prob", "prob"))


@query("f32_prediction_context")
def f32_prediction_context(spark, d):
    m = D.matches(spark, d)
    return pr.context_json(pr.predict(D.with_rates(pr.select_targets(m, D.NOW)), m).transform(
        lambda x: ft.attach_sides(x.drop(*[f"{p}_{c}" for p in "ha" for c in ft.SIGNALS]), ft.motivation_before(m), ft.SIGNALS, "mot")))


@query("f27_model_version", sql("m", """
SELECT 'dc-pooled-l2_2.0-xi_0.0018-xg' || count(xg_home) || '-mot-n_' || count(*) || '-20010101' AS model_version FROM m WHERE status = 'finished'"""))
def f27_model_version(spark, d):
    return pr.model_version(D.matches(spark, d).filter("status = 'finished'"), D.NOW)


@query("p15_training_frame", sql("m", f"""
SELECT match_id, league, CASE WHEN xg_home IS NOT NULL AND xg_away IS NOT NULL THEN xg_home ELSE ft_home END AS home_goals,
  CASE WHEN xg_home IS NOT NULL AND xg_away IS NOT NULL THEN xg_away ELSE ft_away END AS away_goals, greatest(0, date_diff('day', kickoff, {NOW_SQL})) AS days_ago
FROM m WHERE status = 'finished'"""))
def p15_training_frame(spark, d):
    t = fit.training_frame(D.matches(spark, d))
    return t.select("match_id", "league", F.col("hg").alias("home_goals"), F.col("ag").alias("away_goals"),
                    times.days_between(D.now(), F.col("kickoff")).alias("days_ago"))


@query("p16_training_frame_modes", sql("m", """
SELECT 'side' AS mode, league, count(*) AS n, round(sum(coalesce(xg_home, ft_home)), 6) AS hg, round(sum(coalesce(xg_away, ft_away)), 6) AS ag FROM m WHERE status = 'finished' GROUP BY league
UNION ALL SELECT 'off', league, count(*), round(sum(ft_home), 6), round(sum(ft_away), 6) FROM m WHERE status = 'finished' GROUP BY league"""))
def p16_training_frame_modes(spark, d):
    out = None
    for mode in ("side", "off"):
        g = fit.training_frame(D.matches(spark, d), mode).groupBy("league").agg(F.count("*").alias("n"), F.round(F.sum("hg"), 6).alias("hg"), F.round(F.sum("ag"), 6).alias("ag"))
        g = g.withColumn("mode", F.lit(mode))
        out = g if out is None else out.unionByName(g)
    return out


VIRTUAL = {"live": ("in_play", "paused")}


def list_matches(m, *, league=None, status=None, upcoming=True, limit=50, now=D.NOW, most=200):
    """Listing by league and status; ``live`` covers both running states; finished is newest first.

    A page holds 1 to ``most`` rows; a limit outside of that is an error.
    """
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}, not {limit}")
    if league:
        m = m.filter(F.col("league") == league)
    order = [F.asc("kickoff"), F.asc("match_id")]
    if status:
        m = m.filter(F.col("status").isin(*VIRTUAL.get(status, (status,))))
        if status == "finished":
            order = [F.desc("kickoff"), F.asc("match_id")]
    elif upcoming:
        m = m.filter(F.col("kickoff") >= D.now(now))
    return m.orderBy(*order).limit(limit)


@query("p1_list_finished", sql("lm", "SELECT match_id, league, status FROM lm WHERE league = 'L1' AND status = 'finished' ORDER BY kickoff DESC, match_id LIMIT 200"))
def p1_list_finished(spark, d):
    return list_matches(D.live_matches(spark, d), league="L1", status="finished", limit=200).select("match_id", "league", "status")


@query("p1_list_upcoming", sql("lm", f"SELECT match_id, league, status FROM lm WHERE kickoff >= {NOW_SQL} ORDER BY kickoff, match_id LIMIT 50"))
def p1_list_upcoming(spark, d):
    return list_matches(D.live_matches(spark, d)).select("match_id", "league", "status")


@query("p2_live_matches", sql("lm", "SELECT match_id, status, live_minute, live_home, live_away FROM lm WHERE status IN ('in_play', 'paused')"))
def p2_live_matches(spark, d):
    return D.live_matches(spark, d).filter("status IN ('in_play', 'paused')").select("match_id", "status", "live_minute", "live_home", "live_away")


@query("p2_match_by_id", sql("lm", "SELECT match_id, league, season, status, ft_home, ft_away FROM lm WHERE match_id = 77"))
def p2_match_by_id(spark, d):
    return D.live_matches(spark, d).filter("match_id = 77").select("match_id", "league", "season", "status", "ft_home", "ft_away")


@query("p3_sport_events", sql("sev", """
SELECT event_id, sport, league FROM sev WHERE sport = 'basketball' AND league = 'NBA' AND kickoff >= TIMESTAMP '2024-01-30 00:00:00' ORDER BY kickoff, event_id LIMIT 200"""))
def p3_sport_events(spark, d):
    return list_events(D.sport_events(spark, d), sport="basketball", league="NBA", limit=200).select("event_id", "sport", "league")


def list_events(e, *, sport=None, league=None, limit=200, now=D.NOW_LIVE, most=500):
    """Events still to come by sport and league, at most ``most`` a page."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be 1 to {most}, not {limit}")
    e = e.filter(F.col("kickoff") >= D.now(now))
    e = e.filter(F.col("sport") == sport) if sport else e
    e = e.filter(F.col("league") == league) if league else e
    return e.orderBy("kickoff", "event_id").limit(limit)


@query("p4_horizon", sql("m", f"SELECT match_id FROM m WHERE status = 'scheduled' AND kickoff > {NOW_SQL} AND kickoff <= {NOW_SQL} + INTERVAL 14 DAY"))
def p4_horizon(spark, d):
    m = D.matches(spark, d)
    return m.filter((F.col("status") == "scheduled") & (F.col("kickoff") > D.now()) & (F.col("kickoff") <= D.now() + F.expr("INTERVAL 14 DAYS"))).select("match_id")


def stale(m, now=D.NOW, days_back=60):
    n = D.now(now)
    return m.filter(F.col("status").isin("scheduled", "paused", "in_play") & (F.col("kickoff") < n - F.expr("INTERVAL 3 HOURS"))
                    & (F.col("kickoff") >= n - F.make_dt_interval(F.lit(days_back))))


CTE["stale"] = (["lm"], f"SELECT * FROM lm WHERE status IN ('scheduled', 'paused', 'in_play') AND kickoff < {NOW_SQL} - INTERVAL 3 HOUR AND kickoff >= {NOW_SQL} - INTERVAL 60 DAY")


@query("p5_stale_matches", sql("stale", "SELECT match_id, status FROM stale"))
def p5_stale_matches(spark, d):
    """Also ST4 in batch form."""
    return stale(D.live_matches(spark, d)).select("match_id", "status")


@query("p6_missing_xg", sql("m", f"""
SELECT match_id FROM m WHERE status = 'finished' AND (xg_home IS NULL OR xg_away IS NULL) AND league IN ('L0', 'L2') AND kickoff >= {NOW_SQL} - INTERVAL 365 DAY AND kickoff < {NOW_SQL}"""))
def p6_missing_xg(spark, d):
    m = D.matches(spark, d).filter("status = 'finished' AND (xg_home IS NULL OR xg_away IS NULL)")
    return m.filter(F.col("league").isin("L0", "L2") & (F.col("kickoff") >= D.now() - F.expr("INTERVAL 365 DAYS")) & (F.col("kickoff") < D.now())).select("match_id")


@query("p7_recent_targets", sql("m", "SELECT match_id FROM m WHERE status = 'finished' AND league IN ('L0', 'L3') ORDER BY kickoff DESC, match_id DESC LIMIT 100"))
def p7_recent_targets(spark, d):
    """Also T9."""
    return pr.select_targets(D.matches(spark, d), D.NOW, recent=100, leagues=["L0", "L3"]).select("match_id")


@query("p7_upcoming_targets", sql("m", f"SELECT match_id FROM m WHERE status <> 'finished' AND kickoff >= {NOW_SQL}"))
def p7_upcoming_targets(spark, d):
    return pr.select_targets(D.matches(spark, d), D.NOW).select("match_id")


@query("a30_distinct_sets", sql("m", """
SELECT league, count(DISTINCT season) AS seasons, string_agg(DISTINCT season, ',' ORDER BY season) AS labels, count(DISTINCT home_team_id) AS home_teams FROM m GROUP BY league"""))
def a30_distinct_sets(spark, d):
    g = D.matches(spark, d).groupBy("league", "season", "home_team_id").agg(F.lit(1).alias("x"))
    return g.groupBy("league").agg(F.count_distinct("season").alias("seasons"), F.array_join(F.array_sort(F.collect_set("season")), ",").alias("labels"),
                                   F.count_distinct("home_team_id").alias("home_teams"))


@query("a34_day_league_listing", sql("m", """
SELECT strftime(kickoff, '%Y-%m-%d') AS day, league, count(*) AS n, min(match_id) AS first_match FROM m GROUP BY 1, 2"""))
def a34_day_league_listing(spark, d):
    """Two-level listing with counts; members are listed by the caller's page, not collected here."""
    m = D.matches(spark, d)
    return m.groupBy(F.date_format("kickoff", "yyyy-MM-dd").alias("day"), "league").agg(F.count("*").alias("n"), F.min("match_id").alias("first_match"))


@query("a32_season_sample", sql("m", """
SELECT league, season, count(*) AS n, strftime(arg_min(kickoff, match_id), '%Y-%m-%d') AS sample FROM m GROUP BY league, season"""))
def a32_season_sample(spark, d):
    g = D.matches(spark, d).groupBy("league", "season").agg(F.count("*").alias("n"), F.min_by("kickoff", "match_id").alias("s"))
    return g.select("league", "season", "n", F.date_format("s", "yyyy-MM-dd").alias("sample"))


@query("j1_match_prediction_teams", sql("mp teams", """
SELECT mp.match_id, h.name AS home_team, a.name AS away_team, round(mp.prob, 6) AS home_win FROM mp JOIN teams h ON h.team_id = mp.home_team_id JOIN teams a ON a.team_id = mp.away_team_id
WHERE market = '1X2' AND selection = '1'"""))
def j1_match_prediction_teams(spark, d):
    m = D.matches(spark, d)
    p = mk.wide_book(D.rates(spark, d)).selectExpr("match_id", "round(`1X2|1`, 6) AS home_win")
    t = D.teams(spark, d)
    h, a = t.selectExpr("team_id AS home_team_id", "name AS home_team"), t.selectExpr("team_id AS away_team_id", "name AS away_team")
    return m.join(p, "match_id").join(h, "home_team_id").join(a, "away_team_id").select("match_id", "home_team", "away_team", "home_win")


def predictions(spark, d):
    """Up to three stored predictions per match, some at the same instant."""
    return D.matches(spark, d).selectExpr("match_id", "kickoff", "explode(sequence(1, CAST(match_id % 3 + 1 AS INT))) AS k").selectExpr(
        "match_id * 10 + k AS prediction_id", "match_id", "kickoff - make_dt_interval(0, CAST((match_id + k) % 2 AS INT)) AS created_at", "concat('v', k) AS model_version")


CTE["preds"] = (["m"], "SELECT match_id * 10 + k AS prediction_id, match_id, kickoff - to_hours((match_id + k) % 2) AS created_at, 'v' || k AS model_version FROM m, range(1, 4) g(k) WHERE k <= match_id % 3 + 1")


def latest_prediction(p):
    """Newest prediction per match, the later id on equal times; partial maxima before the shuffle."""
    cols = [c for c in p.columns if c not in ("match_id", "created_at", "prediction_id")]
    best = p.groupBy("match_id").agg(F.max(F.struct("created_at", "prediction_id", *cols)).alias("b"))
    return best.select("match_id", "b.*")


@query("j2_latest_prediction", sql("preds", """
SELECT match_id, prediction_id, model_version FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, prediction_id DESC) AS rn FROM preds) z WHERE rn = 1"""))
def j2_latest_prediction(spark, d):
    return latest_prediction(predictions(spark, d)).select("match_id", "prediction_id", "model_version")


@query("j4_matches_with_odds", sql("m odds", "SELECT match_id FROM m WHERE match_id IN (SELECT match_id FROM odds WHERE source = 'PSC')"))
def j4_matches_with_odds(spark, d):
    return D.matches(spark, d).join(D.odds(spark, d).filter("source = 'PSC'"), "match_id", "left_semi").select("match_id")


@query("j5_matches_without_odds", sql("m odds", "SELECT match_id FROM m WHERE match_id NOT IN (SELECT match_id FROM odds WHERE source = 'PSC')"))
def j5_matches_without_odds(spark, d):
    return D.matches(spark, d).join(D.odds(spark, d).filter("source = 'PSC'"), "match_id", "left_anti").select("match_id")


@query("j14_fold_of_prediction", sql("m", f"""
SELECT match_id, CASE WHEN idx < 200 THEN -1 ELSE CAST(floor((idx - 200) / 50) AS BIGINT) END AS fold FROM (SELECT match_id, {_IDX} AS idx FROM m WHERE status = 'finished') z"""))
def j14_fold_of_prediction(spark, d):
    return bt.numbered(D.matches(spark, d), pooled=False, min_train=200, refit_every=50).select("match_id", "fold")


@query("u_2_older_plus_window", sql("m", """
SELECT match_id, part FROM (SELECT match_id, 'older' AS part FROM m WHERE status = 'finished' AND kickoff < TIMESTAMP '2000-01-01' UNION ALL
 SELECT match_id, 'window' FROM m WHERE status = 'finished' AND kickoff >= TIMESTAMP '2000-01-01') z"""))
def u_2_older_plus_window(spark, d):
    m = D.matches(spark, d).filter("status = 'finished'")
    cut = D.now("2000-01-01 00:00:00")
    older = m.filter(F.col("kickoff") < cut).select("match_id", F.lit("older").alias("part"))
    return older.unionByName(m.filter(F.col("kickoff") >= cut).select("match_id", F.lit("window").alias("part")))


def _summer_time(zone="Europe/Istanbul", years=range(1990, 2011)):
    """SQL text: whether a UTC kickoff falls into the zone's summer time, from the public time zone database."""
    tz, spans, start = zoneinfo.ZoneInfo(zone), [], None
    hour = datetime.datetime(years[0], 1, 1, tzinfo=datetime.UTC)
    while hour.year <= years[-1]:
        summer = bool(hour.astimezone(tz).dst())
        if summer and start is None:
            start = hour
        if not summer and start is not None:
            spans.append(f"(kickoff >= TIMESTAMP '{start:%Y-%m-%d %H:%M:%S}' AND kickoff < TIMESTAMP '{hour:%Y-%m-%d %H:%M:%S}')")
            start = None
        hour += datetime.timedelta(hours=1)
    return "(" + " OR ".join(spans) + ")"


_SUMMER = _summer_time()


@query("f29_display_texts", sql("mp", """
SELECT match_id, printf('%.0f%%', prob * 100) AS pct, printf('%.2f%%', prob * 100) AS pct2,
  strftime(l, '%d') || ' ' || (['Oca','Şub','Mar','Nis','May','Haz','Tem','Ağu','Eyl','Eki','Kas','Ara'])[CAST(month(l) AS INTEGER)] || ' ' ||
  (['Paz','Pzt','Sal','Çar','Per','Cum','Cmt'])[CAST(dayofweek(l) AS INTEGER) + 1] || strftime(l, ' %H:%M') AS local
FROM (SELECT match_id, prob, kickoff + CASE WHEN """ + _SUMMER + """ THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END AS l
  FROM mp WHERE market = '1X2' AND selection = '1') z"""))
def f29_display_texts(spark, d):
    m = D.with_rates(D.matches(spark, d))
    w = mk.wide_book(m.select("match_id", "kickoff", "lam", "mu", "rho"))
    p = F.col("`1X2|1`")
    return w.select("match_id", times.percent(p).alias("pct"), times.percent(p, 2).alias("pct2"), times.local_display(F.col("kickoff")).alias("local"))
