"""Queries: feed parsing, text functions, name resolution, feed-to-match joins (M4)."""
from pyspark.sql import functions as F

from touchline.functions import naming, times
from touchline.operators import resolve as rs
from touchline.operators import sync as sy
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, sql
from touchline.plans.q_markets import NOW_SQL, r6
from touchline.plans.q_model import stale
from touchline.plans.registry import query
from touchline.sources import feeds, landed
from touchline.session import literal_rows

TS = "yyyy-MM-dd HH:mm:ss"


def ts(c, name):
    return F.date_format(c, TS).alias(name)


def odds_docs(spark, d):
    """Bookmaker documents as a provider would send them, one per match with its first bookmaker's bets."""
    return D.table(spark, d, "orders").selectExpr("o_orderkey AS match_id", """concat(
      '[{"name":', IF(o_orderkey % 7 = 0, 'null', concat('"Book', o_orderkey % 3, '"')), ',"bets":[{"name":"Match Winner","values":[{"value":"Home","odd":"', 1.5 + o_orderkey % 50 / 20, '"},{"value":"Draw","odd":"',
      IF(o_orderkey % 5 = 0, 'n/a', '3.25'), '"},{"value":"Away","odd":"', IF(o_orderkey % 6 = 0, '1.01', '2.75'), '"}]},{"name":"Goals Over/Under","values":[{"value":"Over 2.5","odd":"1.9"},{"value":"Under 2.5","odd":"1.8"},{"value":"Exactly 3","odd":"9"},{"value":"Over","odd":"2"}]},',
      '{"name":"Both Teams Score","values":[{"value":"Yes","odd":"1.7"},{"value":"Maybe","odd":"5"}]},{"name":"Double Chance","values":[{"value":"Home/Draw","odd":"1.2"}]},',
      '{"name":"Corners","values":[{"value":"Over 9","odd":"1.9"}]},{"name":"Exact Score","values":[{"value":"2-1","odd":"8.5"}]}]},{"name":"Second","bets":[{"name":"Match Winner","values":[{"value":"Home","odd":"9.9"}]}]}]') AS doc""")


_DOC_ROWS = """
 SELECT o_orderkey AS match_id, CASE WHEN o_orderkey % 7 = 0 THEN 'api-football' ELSE 'Book' || CAST(o_orderkey % 3 AS VARCHAR) END AS source, market, selection,
   CASE kind WHEN 1 THEN 1.5e0 + (o_orderkey % 50) / 20e0 WHEN 2 THEN CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 3.25e0 END WHEN 3 THEN CASE WHEN o_orderkey % 6 = 0 THEN 1.01e0 ELSE 2.75e0 END ELSE v END AS decimal_odds
 FROM orders, (VALUES ('1X2', '1', 1, 0e0), ('1X2', 'X', 2, 0e0), ('1X2', '2', 3, 0e0), ('OU_2.5', 'over', 0, 1.9e0), ('OU_2.5', 'under', 0, 1.8e0), ('BTTS', 'yes', 0, 1.7e0), ('DC', '1X', 0, 1.2e0), ('CS', '2-1', 0, 8.5e0)) x(market, selection, kind, v)"""


@query("s6_odds_documents", f"SELECT match_id, source, market, selection, round(decimal_odds, 6) AS decimal_odds FROM ({_DOC_ROWS}) z WHERE decimal_odds IS NOT NULL")
def s6_odds_documents(spark, d):
    return feeds.odds_rows(odds_docs(spark, d)).select("match_id", "source", "market", "selection", r6("decimal_odds", "decimal_odds"))


@query("s7_prematch_documents", f"""SELECT match_id, 'AFP' AS source, CASE market WHEN 'BTTS' THEN 'btts' WHEN 'DC' THEN 'double_chance' ELSE market END AS market, selection, round(decimal_odds, 6) AS decimal_odds
FROM ({_DOC_ROWS}) z WHERE decimal_odds > 1.01e0 AND market <> 'CS'""")
def s7_prematch_documents(spark, d):
    return feeds.odds_rows(odds_docs(spark, d), prematch=True).select("match_id", "source", "market", "selection", r6("decimal_odds", "decimal_odds"))


@query("s10_xg_documents", sql("m", """
SELECT match_id, CASE WHEN match_id % 4 = 0 THEN NULL WHEN match_id % 4 = 1 THEN NULL ELSE xg_home END AS xg_home, CASE WHEN match_id % 4 = 0 THEN NULL ELSE xg_away END AS xg_away FROM m"""))
def s10_xg_documents(spark, d):
    doc = """CASE WHEN match_id % 4 = 0 THEN '{"response":[{"statistics":[{"type":"Expected Goals","value":"1.5"}]}]}'
      ELSE concat('{"response":[{"statistics":[{"type":"Shots","value":"7"},{"type":" Expected_Goals ","value":', IF(match_id % 4 = 1, '"n/a"', coalesce(concat('"', xg_home, '"'), 'null')),
        '}]},{"statistics":[{"type":"expected goals","value":', coalesce(concat('"', xg_away, '"'), 'null'), '}]}]}') END AS doc"""
    return feeds.xg_values(D.matches(spark, d).selectExpr("match_id", doc))


def injury_docs(spark, d):
    return D.absences(spark, d).selectExpr("match_id", "team_id", "idx", """to_json(struct(
      struct(name, position, IF(idx % 2 = 0, reason, '') AS reason, reason AS type) AS player, struct(concat('T', team_id) AS name) AS team,
      struct(concat(date_format(kickoff, "yyyy-MM-dd'T'HH:mm:ss"), IF(idx % 3 = 0, 'Z', '+00:00')) AS date) AS fixture)) AS doc""")


@query("s11_absence_documents", sql("absn", """
SELECT match_id, team_id, idx, name, position, CASE WHEN reason IN ('Suspended', 'Red Card') THEN 'suspension' ELSE 'injury' END AS reason, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff FROM absn"""))
def s11_absence_documents(spark, d):
    a = feeds.absence_rows(injury_docs(spark, d))
    return a.select("match_id", "team_id", "idx", "name", "position", "reason", ts("kickoff", "kickoff"))


@query("s13_scoreboard", """
SELECT 'espn:nba:' || CAST(event_id AS VARCHAR) AS external_ref, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS kickoff, 'H' || (user_id % 9) AS home_team, 'A' || (event_id % 7) AS away_team,
  CASE WHEN event_id % 4 = 0 THEN '' ELSE 'Arena ' || (event_id % 5) END AS venue,
  CASE WHEN event_type = 'purchase' THEN 'finished' WHEN event_type = 'click' THEN 'in_play' WHEN event_type = 'view' THEN 'finished' ELSE 'scheduled' END AS status
FROM events WHERE event_id % 11 <> 0""")
def s13_scoreboard(spark, d):
    """Even games label their sides (away first), odd ones rely on order; every eleventh is undecided."""
    doc = D.table(spark, d, "events").selectExpr("""concat('{"id":"', event_id, '","date":"', date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), 'Z","status":{"type":{"completed":', event_type = 'purchase',
      ',"state":"', CASE event_type WHEN 'click' THEN 'in' WHEN 'view' THEN 'post' ELSE 'pre' END, '"}},"competitions":[{', IF(event_id % 4 = 0, '', concat('"venue":{"fullName":"Arena ', event_id % 5, '"},')), '"competitors":[',
      IF(event_id % 2 = 0, concat('{"homeAway":"away","team":{"displayName":"A', event_id % 7, '"}},{"homeAway":"home","team":{"displayName":"', IF(event_id % 11 = 0, 'tbd ', concat('H', user_id % 9)), '"}}'),
        concat('{"team":{"displayName":"', IF(event_id % 11 = 0, 'TBD', concat('H', user_id % 9)), '"}},{"team":{"displayName":"A', event_id % 7, '"}}')), ']}]}') AS doc""")
    e = feeds.scoreboard_events(doc)
    return e.select("external_ref", ts("kickoff", "kickoff"), "home_team", "away_team", "venue", "status")


@query("s14_games", """
SELECT 'apisports:basketball:' || CAST(event_id AS VARCHAR) AS external_ref, CASE user_id % 3 WHEN 0 THEN 'NBA' WHEN 1 THEN 'EuroLeague' ELSE 'BSL' END AS league, CASE WHEN event_id % 3 = 0 THEN 'Country' ELSE 'Hall' END AS venue,
  CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'click' THEN 'in_play' WHEN 'error' THEN 'cancelled' ELSE 'scheduled' END AS status FROM events""")
def s14_games(spark, d):
    x = D.table(spark, d, "events").selectExpr("CASE user_id % 3 WHEN 0 THEN 'NBA' WHEN 1 THEN 'EuroLeague' ELSE 'BSL' END AS league", "'2025-2026' AS season", """to_json(struct(event_id AS id,
      date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX") AS date, struct(CASE event_type WHEN 'purchase' THEN 'ft' WHEN 'click' THEN 'Q3' WHEN 'error' THEN 'Canc' ELSE 'NS' END AS short) AS status,
      struct('Country' AS name) AS country, IF(event_id % 3 = 0, '', 'Hall') AS venue, struct(struct('H' AS name) AS home, struct('A' AS name) AS away) AS teams)) AS doc""".replace("ssXXX", "ss'Z'"))
    return feeds.game_rows(x).select("external_ref", "league", "venue", "status")


@query("s15_class_calendar", """
SELECT slug || ':2026:' || s_suppkey || ':Race' AS external_ref, s_name || ' — ' || label || ' Yarışı' AS title, strftime(DATE '2026-01-01' + CAST(s_suppkey AS INTEGER) + to_hours(h - 3), '%Y-%m-%d %H:%M:%S') AS kickoff
FROM supplier, (VALUES ('motogp', 'MotoGP', 14), ('moto2', 'Moto2', 12), ('moto3', 'Moto3', 11)) c(slug, label, h)""")
def s15_class_calendar(spark, d):
    r = D.table(spark, d, "supplier").selectExpr("s_suppkey AS round", "s_name AS name", "date_add(DATE '2026-01-01', CAST(s_suppkey AS INT)) AS day")
    return feeds.class_calendar(r).select("external_ref", "title", ts("kickoff", "kickoff"))


@query("s15_session_calendar", """
SELECT 'wsbk:2026:' || s_suppkey || ':' || k AS external_ref, strftime(DATE '2026-01-01' + CAST(s_suppkey AS INTEGER) + to_days(o) + to_hours(h - 3), '%Y-%m-%d %H:%M:%S') AS kickoff
FROM supplier, (VALUES ('Race1', -1, 14), ('Superpole', 0, 13), ('Race2', 0, 16)) c(k, o, h)""")
def s15_session_calendar(spark, d):
    r = D.table(spark, d, "supplier").selectExpr("s_suppkey AS round", "s_name AS name", "date_add(DATE '2026-01-01', CAST(s_suppkey AS INT)) AS day")
    return feeds.session_calendar(r).select("external_ref", ts("kickoff", "kickoff"))


@query("s16_race_sessions", """
SELECT 'f1:2026:' || s_suppkey || ':' || k AS external_ref, 'GP ' || s_name || ' — ' || label AS title FROM supplier, (VALUES ('FP1', 'Antrenman 1', 0), ('FP2', 'Antrenman 2', 1), ('Sprint', 'Sprint', 2), ('Quali', 'Sıralama', 0), ('Race', 'Yarış', 0)) c(k, label, need)
WHERE need = 0 OR (need = 1 AND s_suppkey % 2 = 0) OR (need = 2 AND s_suppkey % 3 = 0)""")
def s16_race_sessions(spark, d):
    doc = D.table(spark, d, "supplier").selectExpr("""concat('{"season":"2026","round":"', s_suppkey, '","raceName":"GP ', s_name, '","date":"2026-05-03","time":"13:00:00Z","Circuit":{"circuitName":"C"},"FirstPractice":{"date":"2026-05-01","time":"11:30:00Z"},',
      IF(s_suppkey % 2 = 0, '"SecondPractice":{"date":"2026-05-01","time":"15:00:00Z"},', '"SecondPractice":{"date":"2026-05-01"},'), IF(s_suppkey % 3 = 0, '"Sprint":{"date":"2026-05-02","time":"11:00:00Z"},', ''), '"Qualifying":{"date":"2026-05-02","time":"15:00:00Z"}}') AS doc""")
    return feeds.race_sessions(doc).select("external_ref", "title")


@query("s23_wrapper_strip", """
SELECT page_id, length(html) AS body_chars, page_id % 2 AS wrapped FROM pages""")
def s23_wrapper_strip(spark, d):
    """Wrap every second page, strip all: the body must be what it was."""
    p = D.table(spark, d, "pages").selectExpr("page_id", "ltrim(html) AS h", "length(html) - length(ltrim(html)) AS lead",
                                              "IF(page_id % 2 = 1, concat('Title: x\n\nMarkdown Content:\n', html), html) AS doc")
    body = landed.strip_wrapper(F.col("doc"))
    return p.select("page_id", F.length(body).cast("long").alias("body_chars"), (F.col("page_id") % 2).alias("wrapped"))


@query("s5_fixture_documents", sql("m", """
SELECT match_id, league, 'T' || home_team_id AS home_name, strftime(kickoff - to_hours(2), '%Y-%m-%d %H:%M:%S') AS kickoff, ft_home AS home_goals FROM m"""))
def s5_fixture_documents(spark, d):
    x = D.matches(spark, d).selectExpr("league", "season", """to_json(struct(struct(match_id AS id, concat(date_format(kickoff, "yyyy-MM-dd'T'HH:mm:ss"), '+02:00') AS date, struct('FT' AS short) AS status) AS fixture,
      struct(struct(concat('T', home_team_id) AS name) AS home, struct(concat('T', away_team_id) AS name) AS away) AS teams, struct(ft_home AS home, ft_away AS away) AS goals)) AS doc""")
    f = feeds.fixture_rows(x, F.col("league"), F.col("season"))
    return f.select(F.col("fixture_id").alias("match_id"), "league", "home_name", ts("kickoff", "kickoff"), "home_goals")


@query("s8_second_fixtures", sql("m", """
SELECT 'T' || home_team_id AS home_name, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff, lpad(CAST(year(kickoff) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(kickoff) + 1) % 100 AS VARCHAR), 2, '0') AS season,
  CASE WHEN match_id % 3 = 0 THEN NULL ELSE match_id % 90 + CASE WHEN match_id % 5 = 0 THEN 2 ELSE 0 END END AS minute, ft_home AS home_goals, count(*) AS n FROM m GROUP BY ALL"""))
def s8_second_fixtures(spark, d):
    x = D.matches(spark, d).selectExpr("""to_json(struct(concat(date_format(kickoff, "yyyy-MM-dd'T'HH:mm:ss"), 'Z') AS utcDate, 'FINISHED' AS status,
      IF(match_id % 3 = 0, NULL, concat(match_id % 90, IF(match_id % 5 = 0, '+2', ''))) AS minute, struct(concat(season, '-08-01') AS startDate) AS season, struct(concat('T', home_team_id) AS name) AS homeTeam,
      struct(concat('T', away_team_id) AS name) AS awayTeam, struct(struct(ft_home AS home, ft_away AS away) AS fullTime) AS score)) AS doc""")
    f = feeds.second_fixture_rows(x)
    return f.groupBy("home_name", ts("kickoff", "kickoff"), "season", "minute", "home_goals").agg(F.count("*").alias("n"))


@query("s9_xg_pages", sql("m", """
SELECT 'T' || home_team_id AS home_name, strftime(kickoff, '%Y-%m-%d %H:%M:%S') AS kickoff, xg_home, CASE WHEN match_id % 2 = 0 THEN ft_home END AS ft_home, count(*) AS n FROM m WHERE xg_home IS NOT NULL GROUP BY ALL"""))
def s9_xg_pages(spark, d):
    """One landed page per match, its JSON escaped as the site does."""
    j = """to_json(array(struct(CAST(match_id AS STRING) AS id, match_id % 2 = 0 AS isResult, date_format(kickoff, 'yyyy-MM-dd HH:mm:ss') AS datetime, struct(concat('T', home_team_id) AS title) AS h, struct('A' AS title) AS a,
      struct(CAST(ft_home AS STRING) AS h, CAST(ft_away AS STRING) AS a) AS goals, struct(CAST(xg_home AS STRING) AS h, CAST(xg_away AS STRING) AS a) AS xG)))"""
    x = D.matches(spark, d).selectExpr("league", "season", f"concat('<script>var datesData = JSON.parse(\\'', replace(replace({j}, '\"', '\\\\x22'), '{{', '\\\\x7B'), '\\')</script>') AS doc")
    p = feeds.xg_pages(x)
    return p.groupBy("home_name", ts("kickoff", "kickoff"), "xg_home", "ft_home").agg(F.count("*").alias("n"))


# ---- text and time functions ----

_FOLD = f"translate(name, '{naming.FOLD_FROM}', '{naming.FOLD_TO}')"
_FEED = (rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({_FOLD}), '\b({'|'.join(naming.FEED_STOPWORDS)})\b', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))")
_ENT = f"trim(regexp_replace(replace(lower({_FOLD}), 'ı', 'i'), '[^a-z0-9]+', ' ', 'g'))"
CTE["pnames"] = (["prov"], "SELECT DISTINCT league, home_name AS name FROM prov UNION SELECT DISTINCT league, away_name FROM prov")
CTE["pn"] = (["pnames"], f"SELECT *, {_FEED} AS norm FROM pnames")
CTE["tk"] = (["teams"], f"SELECT league, norm AS key, min(team_id) AS team_id FROM (SELECT *, {_FEED} AS norm FROM teams) z GROUP BY league, norm")


def provider_names(spark, d):
    p = D.provider_rows(spark, d)
    return p.select("league", F.explode(F.array("home_name", "away_name")).alias("name")).distinct()


def alias_rows(spark):
    return literal_rows(spark, list(D.ALIASES.items()), "alias, name")


@query("f17_normalised_names", sql("pn", f"SELECT league, name, norm, {_ENT} AS entity FROM pn"))
def f17_normalised_names(spark, d):
    n = F.col("name")
    return provider_names(spark, d).select("league", "name", naming.feed_name(n).alias("norm"), naming.entity_name(n).alias("entity"))


@query("f18_slugs", sql("pnames", rf"""
SELECT league, name, 'team:' || league || ':' || trim(regexp_replace(lower({_FOLD}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-') AS team_ref, 'league:' || league AS competition_ref FROM pnames"""))
def f18_slugs(spark, d):
    return provider_names(spark, d).select("league", "name", naming.team_ref(F.col("league"), F.col("name")).alias("team_ref"), naming.competition_ref(F.col("league")).alias("competition_ref"))


DISPLAY = {"Man United": "Manchester United", "Wolves": "Wolverhampton", "Nott'm Forest": "Nottingham Forest", "Paris SG": "Paris Saint-Germain"}


@query("f19_display_names", sql("teams", """
SELECT team_id, CASE name WHEN 'Man United' THEN 'Manchester United' WHEN 'Wolves' THEN 'Wolverhampton' WHEN 'Nott''m Forest' THEN 'Nottingham Forest' WHEN 'Paris SG' THEN 'Paris Saint-Germain' ELSE name END AS display FROM teams"""))
def f19_display_names(spark, d):
    return D.teams(spark, d).select("team_id", naming.lookup_or_self(F.col("name"), DISPLAY).alias("display"))


@query("f20_kickoff_texts", sql("m", """
SELECT match_id, CASE WHEN match_id % 5 = 4 THEN NULL ELSE strftime(kickoff + CASE WHEN match_id % 2 = 0 THEN to_minutes(15 * 60 + 30) ELSE to_minutes(0) END, '%Y-%m-%d %H:%M:%S') END AS kickoff FROM m"""))
def f20_kickoff_texts(spark, d):
    x = D.matches(spark, d).selectExpr("match_id", """CASE match_id % 5 WHEN 0 THEN date_format(kickoff, 'dd/MM/yyyy') WHEN 1 THEN date_format(kickoff, 'yyyy-MM-dd') WHEN 2 THEN date_format(kickoff, 'dd/MM/yy')
      WHEN 4 THEN 'postponed' ELSE date_format(kickoff, 'dd/MM/yyyy') END AS dt""", "IF(match_id % 2 = 0, '15:30', '') AS tm")
    return x.select("match_id", ts(times.kickoff(F.col("dt"), F.col("tm")), "kickoff"))


@query("f21_iso_times", sql("m", "SELECT match_id, strftime(kickoff - CASE match_id % 3 WHEN 0 THEN to_minutes(0) WHEN 1 THEN to_minutes(180) ELSE to_minutes(-330) END, '%Y-%m-%d %H:%M:%S') AS kickoff FROM m"))
def f21_iso_times(spark, d):
    x = D.matches(spark, d).selectExpr("match_id", """concat(date_format(kickoff, "yyyy-MM-dd'T'HH:mm:ss"), CASE match_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+03:00' ELSE '-05:30' END) AS t""")
    return x.select("match_id", ts(times.iso_utc(F.col("t")), "kickoff"))


@query("f22_season_labels", sql("m", """
SELECT match_id, lpad(CAST(y % 100 AS VARCHAR), 2, '0') || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0') AS label,
  (lpad(CAST((year(kickoff) - 3) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(kickoff) - 2) % 100 AS VARCHAR), 2, '0')) AS first_recent
FROM (SELECT *, CASE WHEN month(kickoff) >= 8 THEN year(kickoff) ELSE year(kickoff) - 1 END AS y FROM m) z"""))
def f22_season_labels(spark, d):
    return D.matches(spark, d).select("match_id", times.season_of(F.col("kickoff")).alias("label"), times.recent_seasons(F.year("kickoff"), 3)[0].alias("first_recent"))


@query("f23_normalised_seasons", sql("m", """
SELECT match_id, CASE match_id % 3 WHEN 0 THEN lpad(CAST(year(kickoff) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(kickoff) + 1) % 100 AS VARCHAR), 2, '0') WHEN 1 THEN '2425'
  ELSE lpad(CAST((year(kickoff) - CASE WHEN month(kickoff) >= 7 THEN 0 ELSE 1 END) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(kickoff) + CASE WHEN month(kickoff) >= 7 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') END AS season FROM m"""))
def f23_normalised_seasons(spark, d):
    label = F.expr("CASE match_id % 3 WHEN 0 THEN concat(year(kickoff), '/', year(kickoff) + 1) WHEN 1 THEN '2425' ELSE CAST(year(kickoff) AS STRING) END")
    return D.matches(spark, d).select("match_id", times.normalise_season(label, F.col("kickoff")).alias("season"))


@query("f24_minutes", sql("feed", """
SELECT event_id, event_id % 90 + CASE WHEN event_id % 5 = 0 THEN 2 ELSE 0 END AS minute FROM feed"""))
def f24_minutes(spark, d):
    return D.live_feed(spark, d).select("event_id", times.minute(F.col("minute")).alias("minute"))


@query("f25_status_words", """
SELECT event_type, CASE event_type WHEN 'click' THEN 'in_play' WHEN 'view' THEN 'finished' WHEN 'purchase' THEN 'finished' ELSE 'scheduled' END AS board,
  CASE event_type WHEN 'click' THEN 'in_play' WHEN 'view' THEN 'finished' WHEN 'error' THEN 'cancelled' ELSE 'scheduled' END AS games, count(*) AS n FROM events GROUP BY 1""")
def f25_status_words(spark, d):
    e = D.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    t = F.col("event_type")
    return e.select("event_type", times.scoreboard_status(t == "purchase", F.when(t == "click", "in").when(t == "view", "post")).alias("board"),
                    times.games_status(F.when(t == "click", "Ht").when(t == "view", "aot").when(t == "error", "Postp").otherwise("NS")).alias("games"), "n")


# ---- names to teams ----

CTE["rex"] = (["pn", "tk", "alias"], f"""
  SELECT p.league, p.name, p.norm, coalesce(t1.team_id, t2.team_id) AS team_id, CASE WHEN t1.team_id IS NOT NULL THEN 'alias' WHEN t2.team_id IS NOT NULL THEN 'exact' END AS method
  FROM pn p LEFT JOIN (SELECT alias, {_FEED} AS anorm FROM alias) a ON a.alias = p.name LEFT JOIN tk t1 ON t1.league = p.league AND t1.key = a.anorm LEFT JOIN tk t2 ON t2.league = p.league AND t2.key = p.norm""")
CTE["rexl"] = (["rex", "tk"], """
  SELECT league, name, team_id, method FROM rex WHERE team_id IS NOT NULL UNION ALL
  SELECT r.league, r.name, min(t.team_id), 'contains' FROM rex r JOIN tk t ON t.league = r.league AND length(r.norm) >= 3 AND length(t.key) >= 3 AND (contains(r.norm, t.key) OR contains(t.key, r.norm))
  WHERE r.team_id IS NULL GROUP BY r.league, r.name""")


@query("j15_names_exact", sql("rex", "SELECT league, name, team_id, method FROM rex"))
def j15_names_exact(spark, d):
    return rs.resolve_exact(provider_names(spark, d), D.teams(spark, d), alias_rows(spark)).select("league", "name", "team_id", "method")


@query("j15_names_fuzzy")
def j15_names_fuzzy(spark, d):
    """Also U9: the whole strict ladder with similarity on the leftovers."""
    return rs.resolve(provider_names(spark, d), D.teams(spark, d), alias_rows(spark))


@query("j16_names_loose", sql("rexl", "SELECT league, name, team_id, method FROM rexl"))
def j16_names_loose(spark, d):
    """The loose ladder; its similarity step is left to j16_names_loose_fuzzy."""
    r = rs.resolve(provider_names(spark, d), D.teams(spark, d), alias_rows(spark), cutoff=rs.LOOSE_CUTOFF, containment=True)
    return r.filter("method <> 'fuzzy'")


@query("j16_names_loose_fuzzy")
def j16_names_loose_fuzzy(spark, d):
    return rs.resolve(provider_names(spark, d), D.teams(spark, d), alias_rows(spark), cutoff=rs.LOOSE_CUTOFF, containment=True)


def entities(spark, d):
    """The second provider's club list: every spelling it uses, as an entity of its country."""
    return provider_names(spark, d).selectExpr("concat('C', substr(league, 2)) AS country", "name", "concat(league, '/', name) AS entity_id")


def _core(stop, col="name", syn=False):
    ent = _ENT if col == "name" else _ENT.replace("translate(name,", f"translate({col},")
    if syn:
        ent = ent.replace("'ı', 'i')", "'ı', 'i')").replace(f"replace(lower(translate({col},", f"replace(replace(lower(translate({col},")
        ent = f"trim(regexp_replace(replace(replace(lower(translate({col}, '{naming.FOLD_FROM}', '{naming.FOLD_TO}')), 'ı', 'i'), 'ß', 'ss'), '[^a-z0-9]+', ' ', 'g'))"
    toks = f"str_split({ent}, ' ')"
    if syn:
        toks = f"list_transform({toks}, lambda t: CASE t " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in naming.TOKEN_SYNONYMS.items()) + " ELSE t END)"
    words = "[" + ", ".join(f"'{w}'" for w in stop) + "]"
    return f"array_to_string(list_filter({toks}, lambda t: t <> '' AND NOT list_contains({words}, t)), ' ')"


CTE["oursn"] = (["teams"], f"SELECT DISTINCT country, name, {_ENT} AS n, {_core(naming.ENTITY_STOPWORDS)} AS s, {_core(naming.ENTITY_STOPWORDS_WIDE, syn=True)} AS w FROM teams")
CTE["theirn"] = (["pnames"], f"SELECT 'C' || substr(league, 2) AS country, league || '/' || name AS entity_id, name, {_ENT} AS n, {_core(naming.ENTITY_STOPWORDS)} AS s, {_core(naming.ENTITY_STOPWORDS_WIDE, syn=True)} AS w FROM pnames")
CTE["pass1"] = (["oursn", "theirn"], """
  SELECT country, name, coalesce(e1, e2, e3) AS entity_id, CASE WHEN e1 IS NOT NULL THEN 'exact' WHEN e2 IS NOT NULL THEN 'stripped' ELSE 'contains' END AS method FROM (
   SELECT o.country, o.name, (SELECT min(entity_id) FROM theirn t WHERE t.country = o.country AND t.n = o.n) AS e1, (SELECT min(entity_id) FROM theirn t WHERE t.country = o.country AND t.s = o.s AND t.s <> '') AS e2,
    (SELECT CASE WHEN count(*) = 1 THEN min(entity_id) END FROM theirn t WHERE t.country = o.country AND length(t.s) >= 5 AND length(o.s) >= 5 AND (contains(t.s, o.s) OR contains(o.s, t.s))) AS e3 FROM oursn o) z
  WHERE coalesce(e1, e2, e3) IS NOT NULL""")


def ours(spark, d):
    return D.teams(spark, d).select("country", "name")


@query("j17_entities_exact", sql("pass1", "SELECT country, name, entity_id, method FROM pass1"))
def j17_entities_exact(spark, d):
    return rs.entity_exact(ours(spark, d), entities(spark, d))


@query("a33_match_methods", sql("pass1", "SELECT method, count(*) AS n FROM pass1 GROUP BY method"))
def a33_match_methods(spark, d):
    return rs.entity_exact(ours(spark, d), entities(spark, d)).groupBy("method").agg(F.count("*").alias("n"))


@query("j18_entities_scored", sql("oursn theirn", """,
 t AS (SELECT country, w, min(entity_id) AS entity_id FROM theirn WHERE w <> '' AND NOT regexp_matches(trim(name), '\\s(W|Res\\.?|II|B)$') GROUP BY country, w),
 p AS (SELECT o.country, o.name, t.entity_id, o.w AS s, t.w AS c, list_intersect(str_split(o.w, ' '), str_split(t.w, ' ')) AS inter,
    least(len(list_distinct(str_split(o.w, ' '))), len(list_distinct(str_split(t.w, ' ')))) AS smaller FROM oursn o JOIN t USING (country) WHERE o.w <> ''),
 x AS (SELECT *, CASE WHEN c = s THEN 100 WHEN levenshtein(c, s) <= 2 AND length(s) >= 5 THEN 90 WHEN (contains(c, s) OR contains(s, c)) AND least(length(c), length(s)) >= 4 THEN 80
    WHEN len(inter) > 0 AND len(inter) = smaller THEN 60 + 5 * len(inter) WHEN len(list_filter(inter, lambda v: length(v) >= 6)) > 0 THEN 40 + 5 * len(inter) ELSE 0 END AS score FROM p)
SELECT country, name, min(entity_id) AS entity_id, CAST(max(score) AS BIGINT) AS score FROM (SELECT *, max(score) OVER (PARTITION BY country, name) AS best FROM x WHERE score > 0) y
WHERE score = best AND score >= 40 GROUP BY country, name HAVING count(*) = 1"""))
def j18_entities_scored(spark, d):
    """Also W14: a shared top score is no match."""
    return rs.entity_scored(ours(spark, d), entities(spark, d)).select("country", "name", "entity_id", F.col("score").cast("long").alias("score"))


COUNTRY_ALIASES = [("Nation 1", "NATION_11", 0), ("Nation 1", "NATION_12", 1), ("Nation 2", "No Such", 0), ("Nation 2", "NATION_13", 1)]


@query("j19_countries", """
WITH o AS (SELECT DISTINCT CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Nation 1' WHEN 2 THEN 'Nation 2' ELSE n_name || ' Republic' END AS country, CASE n_nationkey % 4 WHEN 3 THEN 3 ELSE n_nationkey % 4 END AS kind FROM nation),
 t AS (SELECT n_name AS theirs, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')) AS n FROM nation)
SELECT country, CASE kind WHEN 0 THEN country WHEN 1 THEN 'NATION_1' WHEN 2 THEN 'NATION_2' ELSE (SELECT min(theirs) FROM t WHERE contains(lower(replace(country, '_', ' ')), t.n) OR contains(t.n, lower(replace(country, '_', ' ')))) END AS theirs FROM o""")
def j19_countries(spark, d):
    n = D.table(spark, d, "nation")
    mine = n.selectExpr("CASE n_nationkey % 4 WHEN 0 THEN n_name WHEN 1 THEN 'Nation 1' WHEN 2 THEN 'Nation 2' ELSE concat(n_name, ' Republic') END AS country")
    return rs.resolve_country(mine, n.selectExpr("n_name AS country"), literal_rows(spark, COUNTRY_ALIASES, "country, alias, pos")).select("country", "theirs")


@query("w15_keep_first", sql("prov", """
SELECT league, key, row_id FROM (SELECT league, upper(substr(home_name, 1, 4)) AS key, row_id, row_number() OVER (PARTITION BY league, upper(substr(home_name, 1, 4)) ORDER BY row_id) AS rn FROM prov) z WHERE rn = 1"""))
def w15_keep_first(spark, d):
    p = D.provider_rows(spark, d).withColumn("key", F.upper(F.substring("home_name", 1, 4)))
    return sy.keep_first(p, ["league", "key"], ["row_id"]).select("league", "key", "row_id")


# ---- feed rows to matches ----

def feed_with_ids(spark, d, mapping):
    """Provider rows with both teams resolved."""
    p = D.provider_rows(spark, d)
    h = mapping.selectExpr("league", "name AS home_name", "team_id AS home_team_id")
    a = mapping.selectExpr("league", "name AS away_name", "team_id AS away_team_id")
    return p.join(h, ["league", "home_name"]).join(a, ["league", "away_name"])


CTE["alias_map"] = (["pnames", "teams", "alias"], """
  SELECT n.league, n.name, t.team_id, CASE WHEN t.name = n.name THEN 0 ELSE 1 END AS how FROM pnames n LEFT JOIN alias a ON a.alias = n.name JOIN teams t ON t.league = n.league AND (t.name = n.name OR t.name = a.name)""")


@query("j6_live_row_to_match", sql("prov alias_map m", """
SELECT row_id, match_id FROM (SELECT p.row_id, m.match_id, row_number() OVER (PARTITION BY p.row_id ORDER BY greatest(h.how, a.how), m.match_id) AS rn FROM prov p
  JOIN alias_map h ON h.league = p.league AND h.name = p.home_name JOIN alias_map a ON a.league = p.league AND a.name = p.away_name
  JOIN m ON m.league = p.league AND m.home_team_id = h.team_id AND m.away_team_id = a.team_id AND m.kickoff BETWEEN p.kickoff - INTERVAL 4 HOUR AND p.kickoff + INTERVAL 4 HOUR) z WHERE rn = 1"""))
def j6_live_row_to_match(spark, d):
    """Also ST2: equal or aliased names and a kickoff at most four hours apart."""
    n, t = provider_names(spark, d), D.teams(spark, d)
    n = n.join(alias_rows(spark).selectExpr("alias AS name", "name AS plain"), "name", "left")
    same = n.join(t.select("league", "name", "team_id"), ["league", "name"]).selectExpr("league", "name", "team_id", "0 AS how")
    other = n.filter("plain IS NOT NULL").join(t.selectExpr("league", "name AS plain", "team_id"), ["league", "plain"]).selectExpr("league", "name", "team_id", "1 AS how")
    m = same.unionByName(other)
    p = D.provider_rows(spark, d)
    x = p.join(m.selectExpr("league", "name AS home_name", "team_id AS home_team_id", "how AS hh"), ["league", "home_name"]) \
        .join(m.selectExpr("league", "name AS away_name", "team_id AS away_team_id", "how AS ah"), ["league", "away_name"]).withColumn("how", F.greatest("hh", "ah"))
    return rs.interval_join(x, D.matches(spark, d), ["league", "home_team_id", "away_team_id"], 4, strict=False, rank=["how"])


CTE["lenient"] = (["pn", "teams", "alias"], f"""
  SELECT DISTINCT n.league, n.name, t.team_id FROM (SELECT p.league, p.name, {_FEED.replace('translate(name,', 'translate(coalesce(a.name, p.name),')} AS k FROM pnames p LEFT JOIN alias a ON a.alias = p.name) n
  JOIN (SELECT *, {_FEED} AS key FROM teams) t ON t.league = n.league AND n.k <> '' AND t.key <> '' AND (n.k = t.key OR contains(n.k, t.key) OR contains(t.key, n.k))""")


@query("j7_stale_by_lenient_names", sql("prov lenient stale", """
SELECT match_id, row_id FROM (SELECT s.match_id, p.row_id, row_number() OVER (PARTITION BY s.match_id ORDER BY p.row_id) AS rn FROM prov p JOIN lenient h ON h.league = p.league AND h.name = p.home_name
  JOIN lenient a ON a.league = p.league AND a.name = p.away_name JOIN stale s ON s.league = p.league AND s.home_team_id = h.team_id AND s.away_team_id = a.team_id
  AND abs(epoch_us(s.kickoff) - epoch_us(p.kickoff)) < 4 * 3600000000) z WHERE rn = 1"""))
def j7_stale_by_lenient_names(spark, d):
    m = rs.names_match(provider_names(spark, d), D.teams(spark, d), alias_rows(spark))
    x = feed_with_ids(spark, d, m)
    s = stale(D.live_matches(spark, d)).select("league", "home_team_id", "away_team_id", "match_id", "kickoff")
    j = rs.interval_join(x, s, ["league", "home_team_id", "away_team_id"], 4, strict=True, rank=None)
    return j.groupBy("match_id").agg(F.min("row_id").alias("row_id"))


@query("j8_stale_by_day_window", sql("prov rexl stale", """
SELECT match_id, row_id FROM (SELECT s.match_id, p.row_id, row_number() OVER (PARTITION BY s.match_id ORDER BY CAST(p.kickoff AS DATE), p.row_id) AS rn FROM prov p JOIN rexl h ON h.league = p.league AND h.name = p.home_name
  JOIN rexl a ON a.league = p.league AND a.name = p.away_name JOIN stale s ON s.league = p.league AND s.home_team_id = h.team_id AND s.away_team_id = a.team_id
  AND abs(epoch_us(s.kickoff) - epoch_us(p.kickoff)) <= 36 * 3600000000 AND abs(date_diff('day', s.kickoff, p.kickoff)) <= 1) z WHERE rn = 1"""))
def j8_stale_by_day_window(spark, d):
    m = rs.resolve(provider_names(spark, d), D.teams(spark, d), alias_rows(spark), cutoff=rs.LOOSE_CUTOFF, containment=True).filter("method <> 'fuzzy'")
    x = feed_with_ids(spark, d, m).withColumn("day", F.to_date("kickoff"))
    s = stale(D.live_matches(spark, d)).selectExpr("league", "home_team_id", "away_team_id", "match_id", "kickoff AS mk",
                                                   "explode(array(date_sub(CAST(kickoff AS DATE), 1), CAST(kickoff AS DATE), date_add(CAST(kickoff AS DATE), 1))) AS day")
    j = x.join(s, ["league", "home_team_id", "away_team_id", "day"]).filter(
        "abs(unix_micros(CAST(mk AS TIMESTAMP)) - unix_micros(CAST(kickoff AS TIMESTAMP))) <= 36L * 3600000000")
    return j.groupBy("match_id").agg(F.min_by("row_id", F.struct("day", "row_id")).alias("row_id"))


@query("j9_absence_to_match", sql("absn tm", """
SELECT row_id, match_id FROM (SELECT a.match_id * 10000 + a.team_id * 10 + a.idx AS row_id, t.match_id, row_number() OVER (PARTITION BY a.match_id, a.team_id, a.idx ORDER BY t.match_id) AS rn
  FROM absn a JOIN tm t ON t.team_id = a.team_id AND abs(epoch_us(t.kickoff) - epoch_us(a.kickoff) - 3600000000) < 4 * 3600000000) z WHERE rn = 1"""))
def j9_absence_to_match(spark, d):
    """The team plays at home or away: matches are unpivoted to one row per team, no OR join."""
    a = D.absences(spark, d).selectExpr("match_id * 10000 + team_id * 10 + idx AS row_id", "team_id", "kickoff + INTERVAL 1 HOUR AS kickoff")
    return rs.interval_join(a, rs.by_team(D.matches(spark, d)), ["team_id"], 4, strict=True, rank=["0 AS z"])


@query("j10_xg_same_day", sql("prov rex m", """
SELECT p.row_id, min(m.match_id) AS match_id FROM prov p JOIN rex h ON h.league = p.league AND h.name = p.home_name JOIN rex a ON a.league = p.league AND a.name = p.away_name
JOIN m ON m.league = p.league AND m.home_team_id = h.team_id AND m.away_team_id = a.team_id AND CAST(m.kickoff AS DATE) = CAST(p.kickoff AS DATE) GROUP BY p.row_id"""))
def j10_xg_same_day(spark, d):
    m = rs.resolve_exact(provider_names(spark, d), D.teams(spark, d), alias_rows(spark)).filter("team_id IS NOT NULL").select("league", "name", "team_id")
    x = feed_with_ids(spark, d, m).withColumn("day", F.to_date("kickoff"))
    g = D.matches(spark, d).select("league", "home_team_id", "away_team_id", F.to_date("kickoff").alias("day"), "match_id")
    return x.join(g, ["league", "home_team_id", "away_team_id", "day"]).groupBy("row_id").agg(F.min("match_id").alias("match_id"))


# ---- landed files: the same lines a file reader delivers, derived from the match table ----

_MAIN_HEAD = "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,HTHG,HTAG,B365H,B365D,B365A,PSCH,PSCD,PSCA,B365>2.5,B365<2.5"
_NEW_HEAD = "Country,League,Season,Date,Time,Home,Away,HG,AG,PSCH,PSCD,PSCA"


def landed_lines(spark, d, head, line, file):
    """One header line per file plus one line per match; every 13th line carries a field too many."""
    m = D.matches(spark, d)
    body = m.selectExpr(f"{file} AS file", f"concat({line}, IF(match_id % 13 = 0, repeat(',x', 20), '')) AS line")
    heads = m.selectExpr(f"{file} AS file").distinct().selectExpr("file", f"'{head}' AS line")
    return heads.unionByName(body)


_CODE = "array('E0', 'D1', 'I1', 'SP1', 'ZZ')[CAST(substr(league, 2) AS INT)]"
_LAND = "array('Austria', 'sweden', 'NORWAY', 'Finland', 'Atlantis')[CAST(substr(league, 2) AS INT)]"
_CODE_SQL = "(['E0', 'D1', 'I1', 'SP1', 'ZZ'])[CAST(substr(league, 2) AS INTEGER) + 1]"
_NEW_SQL = "(['AUT', 'SWE', 'NOR', 'FIN', NULL])[CAST(substr(league, 2) AS INTEGER) + 1]"
_MAIN_LINE = """concat_ws(',', 'X', date_format(kickoff, IF(match_id % 2 = 0, 'dd/MM/yyyy', 'dd/MM/yy')), IF(match_id % 4 = 0, '19:45', ''), concat('T', home_team_id), CASE WHEN match_id % 17 = 0 THEN '' WHEN match_id % 19 = 0 THEN concat('"T', away_team_id, ', ""City""', '"') ELSE concat('T', away_team_id) END,
   coalesce(CAST(ft_home AS STRING), ''), coalesce(CAST(ft_away AS STRING), ''), '0', '', '1.9', IF(match_id % 3 = 0, '', '3.4'), '4.1', '2.05', '3.3', '3.9', '1.8', '2.0')"""
_YEAR2 = "CASE WHEN match_id % 2 = 0 THEN 0 ELSE 1 END"


def main_lines(spark, d):
    return landed_lines(spark, d, _MAIN_HEAD, _MAIN_LINE, f"concat('landed/', season, '/', {_CODE}, '.csv')")


# every second date has a two-digit year, and some away teams stand in quotes with a comma and quotes inside
_MAIN_KICK = "kickoff + CASE WHEN match_id % 4 = 0 THEN to_minutes(1185) ELSE to_minutes(0) END"


@query("s1_season_files", sql("m", f"""
SELECT {_CODE_SQL} AS league, season, strftime({_MAIN_KICK}, '%Y-%m-%d %H:%M:%S') AS kickoff, 'T' || home_team_id AS home_team, 'T' || away_team_id || CASE WHEN match_id % 19 = 0 THEN ', "City"' ELSE '' END AS away_team, ft_home, ft_away, CASE WHEN match_id % 3 = 0 THEN 5 ELSE 8 END AS prices, count(*) AS n
FROM m WHERE ft_home IS NOT NULL AND match_id % 17 <> 0 AND match_id % 13 <> 0 GROUP BY ALL"""))
def s1_season_files(spark, d):
    r = landed.season_results(main_lines(spark, d))
    return r.groupBy("league", "season", ts("kickoff", "kickoff"), "home_team", "away_team", "ft_home", "ft_away", F.size("prices").alias("prices")).agg(F.count("*").alias("n"))


def country_lines(spark, d, season="IF(match_id % 5 = 0, '', concat(season, '/', CAST(season AS INT) + 1))"):
    line = f"""concat_ws(',', {_LAND}, 'Top', {season}, date_format(kickoff, 'yyyy-MM-dd'), '18:00', concat('T', home_team_id), concat('T', away_team_id),
       coalesce(CAST(ft_home AS STRING), ''), coalesce(CAST(ft_away AS STRING), ''), '2.05', '3.3', '3.9')"""
    return landed_lines(spark, d, _NEW_HEAD, line, f"concat('landed/', {_LAND}, '.csv')")


@query("s2_country_files", sql("m", """
SELECT (['Austria', 'sweden', 'NORWAY', 'Finland', 'Atlantis'])[CAST(substr(league, 2) AS INTEGER) + 1] AS league, season || '/' || (CAST(season AS INTEGER) + 1) AS season, 'T' || home_team_id AS home_team, count(*) AS n, CAST(sum(ft_home) AS BIGINT) AS goals
FROM m WHERE ft_home IS NOT NULL AND match_id % 13 <> 0 AND match_id % 5 <> 0 AND season IN ('1996', '1997', '1998', '1999') GROUP BY ALL"""))
def s2_country_files(spark, d):
    """Seasons are wanted by year: any of the years inside the label is enough."""
    r = landed.country_results(country_lines(spark, d), seasons=["1997", "1999"])
    return r.groupBy("league", "season", "home_team").agg(F.count("*").alias("n"), F.sum("ft_home").alias("goals"))


@query("s3_main_fixtures", sql("m", f"""
SELECT {_CODE_SQL} AS league, lpad(CAST((year(kickoff) - CASE WHEN month(kickoff) >= 8 THEN 0 ELSE 1 END) % 100 AS VARCHAR), 2, '0') || lpad(CAST((year(kickoff) + CASE WHEN month(kickoff) >= 8 THEN 1 ELSE 0 END) % 100 AS VARCHAR), 2, '0') AS season,
  'T' || home_team_id AS home_team, count(*) AS n FROM m WHERE league <> 'L4' AND match_id % 13 <> 0 GROUP BY ALL"""))
def s3_main_fixtures(spark, d):
    """Unknown league codes (ZZ) drop out by a semi join with the catalog."""
    line = f"concat_ws(',', {_CODE}, date_format(kickoff, 'dd/MM/yyyy'), '20:00', concat('T', home_team_id), concat('T', away_team_id))"
    f = landed.main_fixtures(landed_lines(spark, d, "Div,Date,Time,HomeTeam,AwayTeam", line, "'landed/fixtures.csv'"))
    return f.groupBy("league", "season", "home_team").agg(F.count("*").alias("n"))


@query("s4_new_fixtures", sql("m", f"""
SELECT {_NEW_SQL} AS league, CASE WHEN match_id % 5 = 0 THEN CAST(year(kickoff) AS VARCHAR) ELSE season || '/' || (CAST(season AS INTEGER) + 1) END AS season, 'T' || home_team_id AS home_team, count(*) AS n
FROM m WHERE league <> 'L4' AND match_id % 13 <> 0 GROUP BY ALL"""))
def s4_new_fixtures(spark, d):
    """Leagues come from the country name in any case; a missing season falls back to the kickoff year."""
    f = landed.new_fixtures(country_lines(spark, d))
    return f.groupBy("league", "season", "home_team").agg(F.count("*").alias("n"))
