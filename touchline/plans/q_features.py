"""Queries: as-of standings, ranks, motivation, form, rate adjustment (M3)."""
from pyspark.sql import functions as F

from touchline.operators import features as ft
from touchline.plans import derive as D
from touchline.plans.oracle import CTE, sql
from touchline.plans.registry import query

_DONE = "status = 'finished' AND gf IS NOT NULL AND ga IS NOT NULL"
_RANGE = "OVER (PARTITION BY league, season, team_id ORDER BY epoch_us(kickoff) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_STAT = {
    "played": f"CASE WHEN {_DONE} THEN 1 ELSE 0 END", "wins": f"CASE WHEN {_DONE} AND gf > ga THEN 1 ELSE 0 END",
    "draws": f"CASE WHEN {_DONE} AND gf = ga THEN 1 ELSE 0 END", "losses": f"CASE WHEN {_DONE} AND gf < ga THEN 1 ELSE 0 END",
    "gf": f"CASE WHEN {_DONE} THEN gf ELSE 0 END", "ga": f"CASE WHEN {_DONE} THEN ga ELSE 0 END",
}
_SUMS = ", ".join(f"CAST(coalesce(sum({e}), 0) AS BIGINT) AS {k}" for k, e in _STAT.items())
_RUN = ", ".join(f"CAST(coalesce(sum({e}) {_RANGE}, 0) AS BIGINT) AS {k}" for k, e in _STAT.items())
DAY = "strftime(kickoff, '%Y-%m-%d')"


def day(df, col="kickoff"):
    return F.date_format(col, "yyyy-MM-dd").alias("day")


# full as-of table: grid of kickoffs and teams, running sums, rank
CTE["fulltab"] = (["tm"], f"""
  SELECT league, season, kickoff, team_id, plays, played, wins, draws, losses, gf, ga, 3 * wins + draws AS points, gf - ga AS gd,
    row_number() OVER (PARTITION BY league, season, kickoff ORDER BY 3 * wins + draws DESC, gf - ga DESC, gf DESC, team_id) AS rnk
  FROM (SELECT g.league, g.season, g.kickoff, g.team_id, s.team_id IS NOT NULL AS plays, """ + ", ".join(
    f"CAST(coalesce(sum(s.{k}) OVER (PARTITION BY g.league, g.season, g.team_id ORDER BY g.kickoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS {k}"
    for k in _STAT) + f"""
    FROM (SELECT * FROM (SELECT DISTINCT league, season, kickoff FROM tm) k JOIN (SELECT DISTINCT league, season, team_id FROM tm) t USING (league, season)) g
    LEFT JOIN (SELECT league, season, kickoff, team_id, {_SUMS} FROM tm GROUP BY league, season, kickoff, team_id) s
      ON g.league = s.league AND g.season = s.season AND g.kickoff = s.kickoff AND g.team_id = s.team_id) z""")
CTE["mot"] = (["fulltab"], """
  SELECT *, greatest(relegation_risk, title_push, europe_push) * (1 - dead_rubber) AS intensity FROM (
   SELECT *, CASE WHEN played >= 5 AND played / basis >= 0.75e0 AND relegation_risk < 0.1e0 AND title_push < 0.1e0 AND europe_push < 0.15e0
      THEN least(1, (played / basis - 0.75e0) * 4) ELSE 0e0 END AS dead_rubber FROM (
    SELECT *,
     CASE WHEN played < 5 OR left_ = 0 THEN 0e0 WHEN rnk > n - 3 THEN least(1, 0.6e0 + 0.4e0 * (p_safe - points) / (3e0 * left_))
       WHEN points - p_zone >= 3 * left_ THEN 0e0 ELSE greatest(0, 1 - (points - p_zone) / (3e0 * left_)) END AS relegation_risk,
     CASE WHEN played < 5 OR left_ = 0 OR rnk > 4 THEN 0e0
       WHEN rnk = 1 THEN CASE WHEN points - p2 >= 3 * left_ THEN 0.2e0 ELSE least(1, 0.7e0 + 0.3e0 * (1 - (points - p2) / (3e0 * left_))) END
       WHEN p1 - points >= 3 * left_ THEN 0e0 ELSE greatest(0, 1 - (p1 - points) / (3e0 * left_)) END AS title_push,
     CASE WHEN played < 5 OR left_ = 0 OR rnk > 9 THEN 0e0
       WHEN rnk <= 6 THEN CASE WHEN points - p_out >= 3 * left_ THEN 0.1e0 ELSE least(1, 0.5e0 + 0.5e0 * (1 - (points - p_out) / (3e0 * left_))) END
       WHEN p_in - points >= 3 * left_ THEN 0e0 ELSE greatest(0, 1 - (p_in - points) / (3e0 * left_)) END AS europe_push
    FROM (SELECT *, greatest(0, basis - played) AS left_ FROM (
      SELECT f.*, n, greatest((n - 1) * 2, mx) AS basis, p1, p2, p_safe, p_zone, p_in, p_out FROM fulltab f JOIN (
        SELECT league, season, kickoff, n, mx, max(CASE WHEN rnk = 1 THEN points END) AS p1, max(CASE WHEN rnk = 2 THEN points END) AS p2,
          max(CASE WHEN rnk = n - 3 THEN points END) AS p_safe, max(CASE WHEN rnk = n - 2 THEN points END) AS p_zone,
          max(CASE WHEN rnk = 6 THEN points END) AS p_in, max(CASE WHEN rnk = 7 THEN points END) AS p_out
        FROM (SELECT *, count(*) OVER (PARTITION BY league, season, kickoff) AS n, max(played) OVER (PARTITION BY league, season, kickoff) AS mx FROM fulltab) y
        GROUP BY league, season, kickoff, n, mx) a USING (league, season, kickoff)) x) w) v) u""")
CTE["form"] = (["tm"], f"""
  SELECT t.league, t.season, t.kickoff, t.team_id, count(*) AS games,
    sum(CASE WHEN p.gf > p.ga THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN p.gf = p.ga THEN 1 ELSE 0 END) AS draws,
    sum(CASE WHEN p.gf < p.ga THEN 1 ELSE 0 END) AS losses,
    avg(CASE WHEN p.ga = 0 THEN 1e0 ELSE 0e0 END) AS clean_sheet_rate, avg(CASE WHEN p.gf = 0 THEN 1e0 ELSE 0e0 END) AS fail_to_score_rate,
    avg(p.gf) AS gf_per_game, avg(p.ga) AS ga_per_game,
    coalesce(avg(p.gf) FILTER (WHERE p.is_home = 1), 0) AS home_gf_per_game, coalesce(avg(p.ga) FILTER (WHERE p.is_home = 1), 0) AS home_ga_per_game,
    coalesce(avg(p.gf) FILTER (WHERE p.is_home = 0), 0) AS away_gf_per_game, coalesce(avg(p.ga) FILTER (WHERE p.is_home = 0), 0) AS away_ga_per_game
  FROM (SELECT DISTINCT league, season, kickoff, team_id, hi FROM (
      SELECT league, season, kickoff, team_id, CAST(count(CASE WHEN {_DONE} THEN 1 END) {_RANGE} AS BIGINT) AS hi FROM tm) a) t
  JOIN (SELECT *, row_number() OVER (PARTITION BY league, season, team_id ORDER BY kickoff, match_id) AS pos FROM tm WHERE {_DONE}) p
    ON t.league = p.league AND t.season = p.season AND t.team_id = p.team_id AND p.pos > t.hi - 6 AND p.pos <= t.hi
  GROUP BY t.league, t.season, t.kickoff, t.team_id""")
CTE["form_full"] = (["form", "tm"], f"""
  SELECT f.*, b.n AS season_games, CASE WHEN b.n >= f.games + 3 THEN greatest(-1, least(1, 0.5e0 * (
     (gf_per_game - bgf) / greatest(bgf, 0.5e0) + (bga - ga_per_game) / greatest(bga, 0.5e0)))) ELSE 0e0 END AS form_delta
  FROM form f JOIN (SELECT DISTINCT league, season, kickoff, team_id, n, sgf / n AS bgf, sga / n AS bga FROM (
    SELECT league, season, kickoff, team_id, count(CASE WHEN {_DONE} THEN 1 END) {_RANGE} AS n,
      sum(CASE WHEN {_DONE} THEN gf END) {_RANGE} AS sgf, sum(CASE WHEN {_DONE} THEN ga END) {_RANGE} AS sga FROM tm) z WHERE n > 0) b
  USING (league, season, kickoff, team_id)""")


# both sides' signals of a match: each side meets the features of its kickoff once, then a match's two rows become one
_SIGNALS = {"rel": "relegation_risk", "tit": "title_push", "eur": "europe_push", "dead": "dead_rubber", "int": "intensity", "fd": "coalesce(form_delta, 0)"}
CTE["sig"] = (["tm", "mot", "form_full"], "SELECT match_id, " + ", ".join(
    f"max(CASE WHEN is_home = {n} THEN {e} END) AS {p}_{c}" for p, n in (("h", 1), ("a", 0)) for c, e in _SIGNALS.items()) + """
  FROM (SELECT match_id, is_home, league, season, kickoff, team_id FROM tm) t JOIN (SELECT * FROM mot WHERE plays) g USING (league, season, kickoff, team_id)
    LEFT JOIN (SELECT league, season, kickoff, team_id, form_delta FROM form_full) f USING (league, season, kickoff, team_id) GROUP BY match_id""")


@query("w1_record_before_kickoff", sql("tm", f"""
SELECT DISTINCT league, season, team_id, {DAY} AS day, played, wins, draws, losses, gf, ga FROM (
  SELECT league, season, team_id, kickoff, {_RUN} FROM tm) z"""))
def w1_record_before_kickoff(spark, d):
    r = ft.record_before(D.matches(spark, d))
    return r.select("league", "season", "team_id", day(r), *ft.STATS)


@query("a1_league_table", sql("tm", f"""
SELECT league, season, team_id, {_SUMS},
  CAST(3 * sum({_STAT['wins']}) + sum({_STAT['draws']}) AS BIGINT) AS points, CAST(sum({_STAT['gf']}) - sum({_STAT['ga']}) AS BIGINT) AS gd
FROM tm GROUP BY league, season, team_id"""))
def a1_league_table(spark, d):
    return ft.full_season_table(D.matches(spark, d)).drop("rnk")


@query("w2_table_rank", sql("tm", f"""
SELECT league, season, team_id, CAST(row_number() OVER (PARTITION BY league, season ORDER BY 3 * wins + draws DESC, gf - ga DESC, gf DESC, team_id) AS INTEGER) AS rnk
FROM (SELECT league, season, team_id, {_SUMS} FROM tm GROUP BY league, season, team_id) z"""))
def w2_table_rank(spark, d):
    return ft.full_season_table(D.matches(spark, d)).select("league", "season", "team_id", "rnk")


@query("a2_match_totals", sql("m", """
SELECT league, season, count(*) FILTER (WHERE status = 'finished') AS played, count(*) AS scheduled,
  count(*) FILTER (WHERE status <> 'finished') AS remaining FROM m GROUP BY league, season"""))
def a2_match_totals(spark, d):
    done = "count_if(status = 'finished' AND ft_home IS NOT NULL AND ft_away IS NOT NULL)"
    return D.matches(spark, d).groupBy("league", "season").agg(
        F.expr(f"{done} AS played"), F.count("*").alias("scheduled"), F.expr(f"count(*) - {done} AS remaining"))


@query("j12_table_before_kickoff", sql("fulltab", f"""
SELECT league, season, {DAY} AS day, team_id, CAST(rnk AS INTEGER) AS rnk, points, gd, gf, played FROM fulltab"""))
def j12_table_before_kickoff(spark, d):
    t = ft.table_before(D.matches(spark, d))
    return t.select("league", "season", day(t), "team_id", "rnk", "points", "gd", "gf", "played")


@query("w3_points_at_rank", sql("fulltab", f"""
SELECT league, season, {DAY} AS day, CAST(max(played) AS BIGINT) AS max_played, max(CASE WHEN rnk = 1 THEN points END) AS leader,
  max(CASE WHEN rnk = 2 THEN points END) AS runner_up, max(CASE WHEN rnk = 6 THEN points END) AS last_in, max(CASE WHEN rnk = 7 THEN points END) AS first_out
FROM fulltab GROUP BY league, season, kickoff"""))
def w3_points_at_rank(spark, d):
    """Value at a fixed rank, and W4 (most games played)."""
    t = ft.table_before(D.matches(spark, d))
    at = lambda k, n: F.expr(f"max(IF(rnk = {k}, points, NULL)) AS {n}")
    g = t.groupBy("league", "season", "kickoff").agg(
        F.max("played").alias("max_played"), at(1, "leader"), at(2, "runner_up"), at(6, "last_in"), at(7, "first_out"))
    return g.select("league", "season", day(g), "max_played", "leader", "runner_up", "last_in", "first_out")


@query("f7_motivation", sql("mot", f"""
SELECT league, season, {DAY} AS day, team_id, CAST(rnk AS INTEGER) AS rnk, CAST(left_ AS BIGINT) AS matches_left,
  round(relegation_risk, 6) AS relegation_risk, round(title_push, 6) AS title_push, round(europe_push, 6) AS europe_push,
  round(dead_rubber, 6) AS dead_rubber, round(intensity, 6) AS intensity FROM mot WHERE plays"""))
def f7_motivation(spark, d):
    m = ft.motivation_before(D.matches(spark, d))
    return m.select("league", "season", day(m), "team_id", "rnk", "matches_left", *[F.round(c, 6).alias(c) for c in ft.SIGNALS])


@query("f28_motivation_reasons", sql("mot", f"""
SELECT league, season, {DAY} AS day, team_id, concat_ws(' / ',
  CASE WHEN relegation_risk >= 0.5e0 THEN 'Küme düşme hattına çok yakın (T' || team_id || ' ' || rnk || '. sırada, ' || left_ || ' maç kaldı)'
       WHEN relegation_risk >= 0.2e0 THEN 'Küme hattıyla puan farkı az (' || left_ || ' maç kaldı)' END,
  CASE WHEN title_push >= 0.5e0 THEN 'Şampiyonluk yarışında (' || rnk || '. sırada, ' || left_ || ' maç kaldı)' END,
  CASE WHEN europe_push >= 0.5e0 THEN 'Avrupa kupası hattında yarışıyor (' || rnk || '. sırada)' END,
  CASE WHEN dead_rubber >= 0.5e0 THEN 'Sezon biterken oynayacağı bir şey kalmadı (dead rubber)' END) AS reasons FROM mot WHERE plays"""))
def f28_motivation_reasons(spark, d):
    m = ft.motivation_before(D.matches(spark, d))
    return m.select("league", "season", day(m), "team_id",
                    F.array_join(F.expr(ft.motivation_reasons("concat('T', team_id)")), " / ").alias("reasons"))


@query("a3_form", sql("form", f"""
SELECT league, season, {DAY} AS day, team_id, games, CAST(wins AS BIGINT) AS wins, CAST(draws AS BIGINT) AS draws, CAST(losses AS BIGINT) AS losses,
  round(clean_sheet_rate, 6) AS clean_sheet_rate, round(fail_to_score_rate, 6) AS fail_to_score_rate, round(gf_per_game, 6) AS gf_per_game,
  round(ga_per_game, 6) AS ga_per_game, round(home_gf_per_game, 6) AS home_gf_per_game, round(home_ga_per_game, 6) AS home_ga_per_game,
  round(away_gf_per_game, 6) AS away_gf_per_game, round(away_ga_per_game, 6) AS away_ga_per_game FROM form"""))
def a3_form(spark, d):
    """Also J13 and W5: the last six matches before each kickoff."""
    f = ft.form_before(D.matches(spark, d))
    rates = ["clean_sheet_rate", "fail_to_score_rate", "gf_per_game", "ga_per_game", "home_gf_per_game", "home_ga_per_game",
             "away_gf_per_game", "away_ga_per_game"]
    return f.select("league", "season", day(f), "team_id", "games", "wins", "draws", "losses", *[F.round(c, 6).alias(c) for c in rates])


@query("a4_form_delta", sql("form_full", f"""
SELECT league, season, {DAY} AS day, team_id, CAST(season_games AS BIGINT) AS season_games, round(form_delta, 6) AS form_delta FROM form_full"""))
def a4_form_delta(spark, d):
    """Also W6: the season-to-date baseline."""
    f = ft.form_before(D.matches(spark, d))
    return f.select("league", "season", day(f), "team_id", "season_games", F.round("form_delta", 6).alias("form_delta"))


@query("f28_form_reasons", sql("form_full", f"""
SELECT league, season, {DAY} AS day, team_id, concat_ws(' / ',
  CASE WHEN games >= 3 AND form_delta >= 0.25e0 THEN 'formda' WHEN games >= 3 AND form_delta <= -0.25e0 THEN 'düşüşte' END,
  CASE WHEN games >= 4 AND clean_sheet_rate >= 0.5e0 THEN 'Son ' || games || ' maçın %' || CAST(trunc(clean_sheet_rate * 100) AS INTEGER) || '''ında gol yemedi' END,
  CASE WHEN games >= 4 AND fail_to_score_rate >= 0.5e0 THEN 'Son ' || games || ' maçın %' || CAST(trunc(fail_to_score_rate * 100) AS INTEGER) || '''ında gol atamadı' END) AS reasons
FROM form_full"""))
def f28_form_reasons(spark, d):
    f = ft.form_before(D.matches(spark, d))
    text = F.array_join(F.expr(ft.form_reasons()), " / ")
    short = F.regexp_replace(text, r"Son \d+ maçta (formda|düşüşte) \([^)]*\)", "$1")
    return f.select("league", "season", day(f), "team_id", short.alias("reasons"))


@query("f8_adjusted_rates", sql("r sig", """
SELECT match_id, round(lam * greatest(0.85e0, least(1.15e0, (1 + 0.08e0 * h_rel) * (1 + 0.06e0 * h_tit) * (1 + 0.04e0 * h_eur) * (1 - 0.1e0 * h_dead))) * (1 + 0.05e0 * a_dead), 6) AS lam,
  round(mu * greatest(0.85e0, least(1.15e0, (1 + 0.08e0 * a_rel) * (1 + 0.06e0 * a_tit) * (1 + 0.04e0 * a_eur) * (1 - 0.1e0 * a_dead))) * (1 + 0.05e0 * h_dead), 6) AS mu
FROM r JOIN sig USING (match_id)"""))
def f8_adjusted_rates(spark, d):
    m = D.matches(spark, d)
    both = ft.attach_sides(D.with_rates(m), ft.motivation_before(m), ft.SIGNALS, "mot")
    return ft.adjust_rates(both).select("match_id", F.round("lam", 6).alias("lam"), F.round("mu", 6).alias("mu"))
