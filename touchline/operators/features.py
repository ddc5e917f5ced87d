"""As-of features: league table, motivation and form strictly before each kickoff.

Rows are first summed per (league, season, team, kickoff), so windows run over distinct
kickoffs of a season (bounded by the calendar, whatever the number of rows) and equal
kickoffs can never see each other.
"""
from pyspark.sql import DataFrame

TEAM_KEYS = ["league", "season", "team_id"]
FORM_WINDOW = 6
STATS = ["played", "wins", "draws", "losses", "gf", "ga"]
# How many places matter per league (from the bottom, for Europe, for the title).
POSITION_HINTS = {"E1": (3, 2, 2)}
DEFAULT_HINTS = (3, 6, 2)
# Effect of each stake on the goal rate.
STAKE_EFFECTS = {"relegation_risk": 0.08, "title_push": 0.06, "europe_push": 0.04, "dead_rubber": -0.10}


def team_rows(matches: DataFrame) -> DataFrame:
    """Two rows per match, one from each side's view."""
    return matches.selectExpr(
        "league", "season", "kickoff", "match_id",
        "status = 'finished' AND ft_home IS NOT NULL AND ft_away IS NOT NULL AS done",
        "inline(array(struct(home_team_id AS team_id, 1 AS is_home, ft_home AS gf, ft_away AS ga),"
        " struct(away_team_id AS team_id, 0 AS is_home, ft_away AS gf, ft_home AS ga)))",
    )


def team_kickoffs(matches: DataFrame) -> DataFrame:
    """Result sums per team and kickoff; kickoffs without a finished match are kept with zeros."""
    t = team_rows(matches)
    return t.groupBy(*TEAM_KEYS, "kickoff").agg(*[_e(x) for x in (
        "count_if(done) AS played", "count_if(done AND gf > ga) AS wins", "count_if(done AND gf = ga) AS draws",
        "count_if(done AND gf < ga) AS losses", "coalesce(sum(IF(done, gf, 0)), 0) AS gf",
        "coalesce(sum(IF(done, ga, 0)), 0) AS ga", "count(*) AS fixtures")])


def _e(text):
    from pyspark.sql import functions as F
    return F.expr(text)


_BEFORE = "OVER (PARTITION BY league, season, team_id ORDER BY kickoff ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def record_before(matches: DataFrame) -> DataFrame:
    """Each team's record from matches that kicked off strictly earlier in the season."""
    return team_kickoffs(matches).selectExpr(
        *TEAM_KEYS, "kickoff", *[f"coalesce(sum({s}) {_BEFORE}, 0) AS {s}" for s in STATS])


def full_season_table(matches: DataFrame) -> DataFrame:
    """Final table per league and season, teams without a game included, ranked."""
    t = team_rows(matches).groupBy(*TEAM_KEYS).agg(*[_e(x) for x in (
        "count_if(done) AS played", "count_if(done AND gf > ga) AS wins", "count_if(done AND gf = ga) AS draws",
        "count_if(done AND gf < ga) AS losses", "coalesce(sum(IF(done, gf, 0)), 0) AS gf",
        "coalesce(sum(IF(done, ga, 0)), 0) AS ga")])
    return _ranked(t, "league, season")


def _ranked(t: DataFrame, group: str) -> DataFrame:
    t = t.selectExpr("*", "3 * wins + draws AS points", "gf - ga AS gd")
    return t.selectExpr("*", f"row_number() OVER (PARTITION BY {group} ORDER BY points DESC, gd DESC, gf DESC, team_id) AS rnk")


def table_before(matches: DataFrame) -> DataFrame:
    """The whole table as it stood just before each kickoff of a league season.

    One row per (kickoff, team of the league season): distinct kickoffs times a league's
    teams, however many match rows there are. ``fixtures`` > 0 marks the teams that play.
    """
    tk = team_kickoffs(matches)
    kicks = tk.select("league", "season", "kickoff").distinct()
    teams = tk.select(*TEAM_KEYS).distinct()
    grid = kicks.join(teams, ["league", "season"])
    zero = grid.selectExpr(*TEAM_KEYS, "kickoff", *[f"0L AS {s}" for s in STATS], "0L AS fixtures")
    dense = tk.selectExpr(*TEAM_KEYS, "kickoff", *STATS, "fixtures").unionByName(zero)
    # hash by team once: both the sum per kickoff and the running window are satisfied by it
    dense = dense.repartition(*TEAM_KEYS).groupBy(*TEAM_KEYS, "kickoff").agg(
        *[_e(f"sum({s}) AS {s}") for s in STATS + ["fixtures"]])
    run = dense.selectExpr(
        *TEAM_KEYS, "kickoff", "fixtures", *[f"coalesce(sum({s}) {_BEFORE}, 0) AS {s}" for s in STATS])
    return _ranked(run, "league, season, kickoff")


def _hint(pos: int) -> str:
    cases = " ".join(f"WHEN '{lg}' THEN {h[pos]}" for lg, h in POSITION_HINTS.items())
    return f"CASE league {cases} ELSE {DEFAULT_HINTS[pos]} END"


def motivation(table: DataFrame, group: str = "league, season, kickoff") -> DataFrame:
    """Stakes of every table row: relegation, title, Europe, dead rubber, intensity, reasons."""
    w = f"OVER (PARTITION BY {group})"

    def points_at(rank):
        return f"max(IF(rnk = {rank}, points, NULL)) {w}"

    t = table.selectExpr("*", f"{_hint(0)} AS rel", f"{_hint(1)} AS eu", f"{_hint(2)} AS ti", f"count(*) {w} AS n",
                         f"max(played) {w} AS max_played")
    t = t.selectExpr(
        "*", f"{points_at(1)} AS p1", f"{points_at(2)} AS p2", f"{points_at('n - rel')} AS p_safe",
        f"{points_at('n - rel + 1')} AS p_zone", f"{points_at('eu')} AS p_in", f"{points_at('eu + 1')} AS p_out",
        "greatest(IF(n > 1, (n - 1) * 2, 0), max_played) AS basis")
    t = t.selectExpr("*", "greatest(0, basis - played) AS matches_left", "3D * greatest(0, basis - played) AS mp")
    live = "played >= 5 AND matches_left > 0"
    t = t.selectExpr(
        "*",
        f"""CASE WHEN NOT ({live}) THEN 0D
             WHEN rnk > n - rel THEN least(1D, 0.6D + 0.4D * coalesce((p_safe - points) / mp, 0D))
             WHEN points - p_zone >= mp THEN 0D ELSE greatest(0D, 1D - (points - p_zone) / mp) END AS relegation_risk""",
        f"""CASE WHEN NOT ({live}) OR rnk > ti + 2 THEN 0D
             WHEN rnk = 1 THEN CASE WHEN n < 2 THEN 1D WHEN points - p2 >= mp THEN 0.2D
                                    ELSE least(1D, 0.7D + 0.3D * (1D - (points - p2) / mp)) END
             WHEN p1 - points >= mp THEN 0D ELSE greatest(0D, 1D - (p1 - points) / mp) END AS title_push""",
        f"""CASE WHEN NOT ({live}) OR eu <= ti OR rnk > eu + 3 THEN 0D
             WHEN rnk <= eu THEN CASE WHEN n <= eu THEN 0.3D WHEN points - p_out >= mp THEN 0.1D
                                      ELSE least(1D, 0.5D + 0.5D * (1D - (points - p_out) / mp)) END
             WHEN p_in - points >= mp THEN 0D ELSE greatest(0D, 1D - (p_in - points) / mp) END AS europe_push""",
        "played / CAST(greatest(basis, 1) AS DOUBLE) AS progress")
    t = t.selectExpr(
        "*", """IF(played >= 5 AND progress >= 0.75D AND relegation_risk < 0.1D AND title_push < 0.1D AND europe_push < 0.15D,
             least(1D, (progress - 0.75D) * 4D), 0D) AS dead_rubber""")
    return t.selectExpr(
        *[c for c in table.columns], "matches_left", "relegation_risk", "title_push", "europe_push", "dead_rubber",
        "greatest(relegation_risk, title_push, europe_push) * (1D - dead_rubber) AS intensity")


def motivation_reasons(team_name: str = "team_name") -> str:
    """SQL text: user-facing reasons of a motivation row."""
    return f"""array_compact(array(
      CASE WHEN relegation_risk >= 0.5D THEN format_string('Küme düşme hattına çok yakın (%s %d. sırada, %d maç kaldı)', {team_name}, rnk, matches_left)
           WHEN relegation_risk >= 0.2D THEN format_string('Küme hattıyla puan farkı az (%d maç kaldı)', matches_left) END,
      IF(title_push >= 0.5D, format_string('Şampiyonluk yarışında (%d. sırada, %d maç kaldı)', rnk, matches_left), NULL),
      IF(europe_push >= 0.5D, format_string('Avrupa kupası hattında yarışıyor (%d. sırada)', rnk), NULL),
      IF(dead_rubber >= 0.5D, 'Sezon biterken oynayacağı bir şey kalmadı (dead rubber)', NULL)))"""


def motivation_before(matches: DataFrame) -> DataFrame:
    """Motivation of the teams that play, at each of their kickoffs."""
    return motivation(table_before(matches)).filter("fixtures > 0").drop("fixtures")


_L6 = {
    "games": "1", "f_wins": "IF(gf > ga, 1, 0)", "f_draws": "IF(gf = ga, 1, 0)", "f_losses": "IF(gf < ga, 1, 0)",
    "f_gf": "gf", "f_ga": "ga", "clean": "IF(ga = 0, 1, 0)", "blank": "IF(gf = 0, 1, 0)", "h_games": "is_home",
    "h_gf": "IF(is_home = 1, gf, 0)", "h_ga": "IF(is_home = 1, ga, 0)",
}


def form_before(matches: DataFrame, window: int = FORM_WINDOW) -> DataFrame:
    """Form over the last ``window`` matches before each kickoff, and its delta to the season so far.

    A kickoff can add at most ``window`` matches to a form line, so each kickoff keeps only its
    newest ``window`` rows (a ranked filter, cut before the shuffle); season sums keep all rows.
    """
    rows = team_rows(matches).filter("done").selectExpr(
        "*", "row_number() OVER (PARTITION BY league, season, team_id, kickoff ORDER BY match_id DESC) AS rn",
    ).filter(f"rn <= {window}")
    by_time = "PARTITION BY league, season, team_id ORDER BY kickoff, match_id"
    frame = f"OVER ({by_time} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)"
    last = rows.selectExpr(
        *TEAM_KEYS, "kickoff", *[f"sum({e}) {frame} AS {k}" for k, e in _L6.items()],
        f"lead(kickoff) OVER ({by_time}) AS nxt",
    ).filter("nxt IS NULL OR nxt > kickoff").selectExpr(
        *TEAM_KEYS, "kickoff", f"struct({', '.join(_L6)}) AS l6")
    tk = team_kickoffs(matches).join(last, [*TEAM_KEYS, "kickoff"], "left")
    f = tk.selectExpr(
        *TEAM_KEYS, "kickoff", f"last_value(l6, true) {_BEFORE} AS l6",
        f"coalesce(sum(played) {_BEFORE}, 0) AS season_games", f"sum(gf) {_BEFORE} AS season_gf",
        f"sum(ga) {_BEFORE} AS season_ga",
    ).filter("l6 IS NOT NULL").selectExpr(*TEAM_KEYS, "kickoff", "season_games", "season_gf", "season_ga", "l6.*")
    g = "CAST(games AS DOUBLE)"
    f = f.selectExpr(
        *TEAM_KEYS, "kickoff", "games", "f_wins AS wins", "f_draws AS draws", "f_losses AS losses",
        f"f_wins / {g} AS win_rate", f"clean / {g} AS clean_sheet_rate", f"blank / {g} AS fail_to_score_rate",
        f"f_gf / {g} AS gf_per_game", f"f_ga / {g} AS ga_per_game",
        "IF(h_games > 0, h_gf / CAST(h_games AS DOUBLE), 0D) AS home_gf_per_game",
        "IF(h_games > 0, h_ga / CAST(h_games AS DOUBLE), 0D) AS home_ga_per_game",
        "IF(games > h_games, (f_gf - h_gf) / CAST(games - h_games AS DOUBLE), 0D) AS away_gf_per_game",
        "IF(games > h_games, (f_ga - h_ga) / CAST(games - h_games AS DOUBLE), 0D) AS away_ga_per_game",
        "season_games", "season_gf / CAST(season_games AS DOUBLE) AS base_gf", "season_ga / CAST(season_games AS DOUBLE) AS base_ga")
    return f.selectExpr(
        "*", """IF(season_games >= games + 3, greatest(-1D, least(1D, 0.5D * (
             (gf_per_game - base_gf) / greatest(base_gf, 0.5D) + (base_ga - ga_per_game) / greatest(base_ga, 0.5D)))), 0D) AS form_delta""")


def form_reasons() -> str:
    """SQL text: user-facing reasons of a form row."""
    return """array_compact(array(
      CASE WHEN games >= 3 AND form_delta >= 0.25D THEN format_string('Son %d maçta formda (%.1f attığı – %.1f yediği gol)', games, gf_per_game, ga_per_game)
           WHEN games >= 3 AND form_delta <= -0.25D THEN format_string('Son %d maçta düşüşte (%.1f attığı – %.1f yediği gol)', games, gf_per_game, ga_per_game) END,
      IF(games >= 4 AND clean_sheet_rate >= 0.5D, format_string("Son %d maçın %%%d'ında gol yemedi", games, CAST(clean_sheet_rate * 100 AS INT)), NULL),
      IF(games >= 4 AND fail_to_score_rate >= 0.5D, format_string("Son %d maçın %%%d'ında gol atamadı", games, CAST(fail_to_score_rate * 100 AS INT)), NULL)))"""


def multiplier(prefix: str) -> str:
    """SQL text: goal-rate multiplier of one side, clipped to [0.85, 1.15]."""
    parts = " * ".join(f"(1D + {e}D * coalesce({prefix}{k}, 0D))" for k, e in STAKE_EFFECTS.items())
    return f"greatest(0.85D, least(1.15D, {parts}))"


SIGNALS = ["relegation_risk", "title_push", "europe_push", "dead_rubber", "intensity"]


def attach_sides(matches: DataFrame, feature: DataFrame, cols, tag: str) -> DataFrame:
    """Join a per-(team, kickoff) feature to both sides of each match as ``h_<c>`` / ``a_<c>``."""
    out = matches
    for side, p in (("home", "h"), ("away", "a")):
        f = feature.selectExpr("league", "season", "kickoff", f"team_id AS {side}_team_id",
                               *[f"{c} AS {p}_{c}" for c in cols])
        out = out.join(f, ["league", "season", "kickoff", f"{side}_team_id"], "left")
    return out


def adjust_rates(df: DataFrame) -> DataFrame:
    """Replace lam and mu by their motivation-adjusted values (needs h_/a_ signals)."""
    rest = [f"`{c}`" for c in df.columns if c not in ("lam", "mu")]
    return df.selectExpr(
        *rest,
        f"lam * {multiplier('h_')} * (1D + 0.05D * coalesce(a_dead_rubber, 0D)) AS lam",
        f"mu * {multiplier('a_')} * (1D + 0.05D * coalesce(h_dead_rubber, 0D)) AS mu")
