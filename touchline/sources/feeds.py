"""Provider JSON feeds as columns: each takes rows with a JSON text column ``doc``."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import naming, times

# Provider vocabulary.
BETS = {"Match Winner": "1X2", "Goals Over/Under": "OU", "Both Teams Score": "BTTS", "Double Chance": "DC", "Exact Score": "CS"}
SELECTIONS = {
    "1X2": {"Home": "1", "Draw": "X", "Away": "2"}, "BTTS": {"Yes": "yes", "No": "no"},
    "DC": {"Home/Draw": "1X", "Home/Away": "12", "Draw/Away": "X2"},
}
PREMATCH_SOURCE, PREMATCH_MIN_ODDS = "AFP", 1.01
ABSENCE_REASONS = {"Missing Fixture": "injury", "Questionable": "injury", "Suspended": "suspension", "Red Card": "suspension"}

BOOK = "array<struct<name:string,bets:array<struct<name:string,values:array<struct<value:string,odd:string>>>>>>"


def odds_rows(df: DataFrame, *, prematch: bool = False) -> DataFrame:
    """Price rows of the first bookmaker; ``df`` has match_id and doc (the bookmaker list).

    The stored vocabulary keeps BTTS/DC/CS; the pre-match variant names the model's markets,
    has no exact scores, a fixed source label and only prices above 1.01.
    """
    x = df.select("match_id", F.from_json("doc", BOOK)[0].alias("b"))
    x = x.select("match_id", F.coalesce("b.name", F.lit("api-football")).alias("source"), F.explode("b.bets").alias("bet"))
    x = x.select("match_id", "source", naming.lookup(F.col("bet.name"), BETS).alias("base"), F.explode("bet.values").alias("v"))
    odd, raw = F.col("v.odd").try_cast("double"), F.col("v.value")
    parts = F.split(raw, r"\s+")
    is_line = (F.size(parts) == 2) & parts[0].isin("Over", "Under")
    sel = F.when(F.col("base") == "OU", F.when(is_line, F.lower(parts[0]))).when(F.col("base") == "CS", raw)
    for base, table in SELECTIONS.items():
        sel = F.when(F.col("base") == base, naming.lookup(raw, table)).otherwise(sel)
    market = F.when(F.col("base") == "OU", F.concat(F.lit("OU_"), F.get(parts, F.lit(1)))).otherwise(F.col("base"))
    if prematch:
        market = F.when(F.col("base") == "BTTS", "btts").when(F.col("base") == "DC", "double_chance").otherwise(market)
    out = x.select("match_id", F.lit(PREMATCH_SOURCE).alias("source") if prematch else F.col("source"), "base",
                   market.alias("market"), sel.alias("selection"), odd.alias("decimal_odds"))
    out = out.filter("base IS NOT NULL AND selection IS NOT NULL AND decimal_odds IS NOT NULL")
    if prematch:
        out = out.filter((F.col("decimal_odds") > PREMATCH_MIN_ODDS) & (F.col("base") != "CS"))
    return out.drop("base")


FIXTURE = "struct<fixture:struct<id:long,date:string,status:struct<short:string>>,teams:struct<home:struct<name:string>,away:struct<name:string>>,goals:struct<home:int,away:int>>"


def fixture_rows(df: DataFrame, league: Column, season: Column) -> DataFrame:
    """Nested fixtures of the first provider."""
    x = df.select(F.from_json("doc", FIXTURE).alias("f"), league.alias("league"), season.alias("season"))
    return x.selectExpr("f.fixture.id AS fixture_id", "league", "season", "f.fixture.date AS date", "f.teams.home.name AS home_name",
                        "f.teams.away.name AS away_name", "f.fixture.status.short AS status_short", "f.goals.home AS home_goals",
                        "f.goals.away AS away_goals").withColumn("kickoff", times.iso_utc(F.col("date"))).drop("date") \
        .filter("home_name IS NOT NULL AND away_name IS NOT NULL AND kickoff IS NOT NULL")


FIXTURE2 = "struct<utcDate:string,status:string,minute:string,season:struct<startDate:string>,homeTeam:struct<name:string>,awayTeam:struct<name:string>,score:struct<fullTime:struct<home:int,away:int>>>"


def second_fixture_rows(df: DataFrame, *keep: str) -> DataFrame:
    """Fixtures and live scores of the second provider; season label from the season's start date. Columns ``keep`` stay."""
    x = df.select(*keep, F.from_json("doc", FIXTURE2).alias("f"))
    return x.select(*keep,
        times.season_from_start(F.coalesce("f.season.startDate", F.lit(""))).alias("season"), times.iso_utc(F.col("f.utcDate")).alias("kickoff"),
        F.col("f.homeTeam.name").alias("home_name"), F.col("f.awayTeam.name").alias("away_name"), F.col("f.status").alias("status"),
        times.minute(F.col("f.minute")).alias("minute"), F.col("f.score.fullTime.home").alias("home_goals"), F.col("f.score.fullTime.away").alias("away_goals"))


STATS = "struct<response:array<struct<statistics:array<struct<type:string,value:string>>>>>"


def xg_values(df: DataFrame) -> DataFrame:
    """(match_id, xg_home, xg_away) from a statistics document; fewer than two teams gives nulls."""
    def xg(i):
        return (f"CASE WHEN size(s.response) >= 2 THEN try_cast(get(filter(s.response[{i}].statistics,"
                " t -> lower(trim(t.type)) IN ('expected_goals', 'expected goals')), 0).value AS DOUBLE) END")
    return df.select("match_id", F.from_json("doc", STATS).alias("s")).selectExpr("match_id", f"{xg(0)} AS xg_home", f"{xg(1)} AS xg_away")


INJURY = "struct<player:struct<name:string,position:string,reason:string,type:string>,team:struct<name:string>,fixture:struct<date:string>>"


def absence_rows(df: DataFrame) -> DataFrame:
    """Injury documents to (team_name, kickoff, name, position, reason bucket)."""
    x = df.select(*[c for c in df.columns if c != "doc"], F.from_json("doc", INJURY).alias("i"))
    raw = F.coalesce(F.nullif("i.player.reason", F.lit("")), "i.player.type", F.lit(""))
    return x.select(*[c for c in df.columns if c != "doc"], F.col("i.team.name").alias("team_name"), times.iso_utc(F.col("i.fixture.date")).alias("kickoff"),
                    F.col("i.player.name").alias("name"), F.col("i.player.position").alias("position"),
                    F.coalesce(naming.lookup(raw, ABSENCE_REASONS), F.lit("injury")).alias("reason")).filter("team_name IS NOT NULL AND kickoff IS NOT NULL")


BOARD = ("struct<id:string,date:string,status:struct<type:struct<completed:boolean,state:string>>,competitions:array<struct<venue:struct<fullName:string>,"
         "competitors:array<struct<homeAway:string,team:struct<displayName:string>>>>>>")


def scoreboard_events(df: DataFrame) -> DataFrame:
    """Scoreboard games; sides by label, else by position; undecided (TBD) games dropped."""
    x = df.select(F.from_json("doc", BOARD).alias("g")).selectExpr("g.*", "g.competitions[0] AS c").filter("size(c.competitors) >= 2")

    def side(label, pos):
        return (f"coalesce(element_at(filter(transform(filter(c.competitors, x -> x.homeAway = '{label}'), x -> x.team.displayName), n -> n <> ''), -1),"
                f" c.competitors[{pos}].team.displayName)")
    named = x.filter("size(filter(c.competitors, x -> x.team.displayName <> '')) > 0")
    y = named.selectExpr(
        "id", "date", "status", "c.venue.fullName AS venue",
        side("home", 0).replace("element_at(", "try_element_at(") + " AS home_team", side("away", 1).replace("element_at(", "try_element_at(") + " AS away_team")
    y = y.withColumn("kickoff", times.iso_utc(F.col("date"))).filter(
        "id IS NOT NULL AND kickoff IS NOT NULL AND home_team IS NOT NULL AND away_team IS NOT NULL"
        " AND upper(trim(home_team)) <> 'TBD' AND upper(trim(away_team)) <> 'TBD'")
    return y.select(F.concat(F.lit("espn:nba:"), "id").alias("external_ref"), F.lit("basketball").alias("sport"), F.lit("NBA").alias("league"), "kickoff",
                    "home_team", "away_team", F.coalesce("venue", F.lit("")).alias("venue"),
                    times.scoreboard_status(F.col("status.type.completed"), F.col("status.type.state")).alias("status"))


GAME = "struct<id:long,date:string,status:struct<short:string>,country:struct<name:string>,venue:string,teams:struct<home:struct<name:string>,away:struct<name:string>>>"


def game_rows(df: DataFrame) -> DataFrame:
    """Games of several leagues (league, season, doc); an empty venue falls back to the country."""
    x = df.select("league", "season", F.from_json("doc", GAME).alias("g"))
    y = x.select(F.concat(F.lit("apisports:basketball:"), F.col("g.id").cast("string")).alias("external_ref"), F.lit("basketball").alias("sport"),
                 "league", "season", times.iso_utc(F.col("g.date")).alias("kickoff"), F.col("g.teams.home.name").alias("home_team"),
                 F.col("g.teams.away.name").alias("away_team"), F.coalesce(F.nullif("g.venue", F.lit("")), "g.country.name").alias("venue"),
                 times.games_status(F.coalesce("g.status.short", F.lit(""))).alias("status"))
    return y.filter("external_ref IS NOT NULL AND kickoff IS NOT NULL AND home_team <> '' AND away_team <> ''")


XG_PAGE = "array<struct<id:string,isResult:boolean,datetime:string,h:struct<title:string>,a:struct<title:string>,goals:struct<h:string,a:string>,xG:struct<h:string,a:string>>>"


def xg_pages(df: DataFrame) -> DataFrame:
    """Match xG embedded in a page (league, season, doc): unescape the quoted blob, then plain JSON."""
    import pandas as pd

    @F.pandas_udf("string")
    def unescape(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else t.encode("utf-8").decode("unicode_escape"))

    blob = F.regexp_extract("doc", r"var\s+datesData\s*=\s*JSON\.parse\('([^']+)'\)", 1)
    x = df.select("league", "season", blob.alias("b")).filter("b <> ''")
    x = x.select("league", "season", F.explode(F.from_json(unescape("b"), XG_PAGE)).alias("r"))
    return x.selectExpr(
        "league", "season", "CAST(try_to_timestamp(r.datetime, 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS kickoff", "r.h.title AS home_name", "r.a.title AS away_name",
        "try_cast(r.xG.h AS DOUBLE) AS xg_home", "try_cast(r.xG.a AS DOUBLE) AS xg_away", "IF(r.isResult, try_cast(r.goals.h AS INT), NULL) AS ft_home",
        "IF(r.isResult, try_cast(r.goals.a AS INT), NULL) AS ft_away").filter("xg_home IS NOT NULL AND xg_away IS NOT NULL AND kickoff IS NOT NULL")


# Named sessions of a race weekend, in order.
SESSIONS = [("FirstPractice", "FP1", "Antrenman 1"), ("SecondPractice", "FP2", "Antrenman 2"), ("SprintQualifying", "SprintQuali", "Sprint Sıralama"),
            ("ThirdPractice", "FP3", "Antrenman 3"), ("Sprint", "Sprint", "Sprint"), ("Qualifying", "Quali", "Sıralama")]
_S = "struct<date:string,time:string>"
RACE = ("struct<season:string,round:string,raceName:string,date:string,time:string,Circuit:struct<circuitName:string>,"
        + ",".join(f"{k}:{_S}" for k, _, _ in SESSIONS) + ">")


def race_sessions(df: DataFrame) -> DataFrame:
    """One row per named session of a race document that has a date and a time."""
    items = [f"struct('{k}' AS session, '{l}' AS label, r.{f}.date AS d, r.{f}.time AS t)" for f, k, l in SESSIONS]
    items.append("struct('Race' AS session, 'Yarış' AS label, r.date AS d, r.time AS t)")
    x = df.select(F.from_json("doc", RACE).alias("r")).selectExpr("r.season AS season", "r.round AS round", "coalesce(r.raceName, 'Grand Prix') AS race",
                                                                  "coalesce(r.Circuit.circuitName, '') AS venue", f"inline(array({', '.join(items)}))")
    x = x.filter("d <> '' AND t <> ''").withColumn("kickoff", times.iso_utc(F.concat_ws("T", "d", "t"))).filter("kickoff IS NOT NULL")
    return x.selectExpr("concat_ws(':', 'f1', season, round, session) AS external_ref", "concat(race, ' — ', label) AS title", "venue", "kickoff")


# Classes and sessions of the two-wheel calendars (local hours, UTC+3).
MOTO_CLASSES = [("motogp", "MotoGP", 14), ("moto2", "Moto2", 12), ("moto3", "Moto3", 11)]
WSBK_SESSIONS = [("Race1", "Yarış 1", -1, 14), ("Superpole", "Superpole Yarış", 0, 13), ("Race2", "Yarış 2", 0, 16)]


def class_calendar(rounds: DataFrame, year: int = 2026, classes=MOTO_CLASSES) -> DataFrame:
    """Every round (round, name, day) times every class, at the class's local hour."""
    items = ", ".join(f"struct('{s}' AS slug, '{l}' AS label, {h} AS hour)" for s, l, h in classes)
    x = rounds.selectExpr("round", "name", "day", f"inline(array({items}))")
    return x.selectExpr(f"concat_ws(':', slug, '{year}', round, 'Race') AS external_ref", "concat(name, ' — ', label, ' Yarışı') AS title",
                        "CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(0, hour - 3) AS kickoff")


def session_calendar(rounds: DataFrame, year: int = 2026, sessions=WSBK_SESSIONS) -> DataFrame:
    """Every round times every session, with day and hour offsets from the round's Sunday."""
    items = ", ".join(f"struct('{k}' AS session, '{l}' AS label, {d} AS off, {h} AS hour)" for k, l, d, h in sessions)
    x = rounds.selectExpr("round", "name", "day", f"inline(array({items}))")
    return x.selectExpr(f"concat_ws(':', 'wsbk', '{year}', round, session) AS external_ref", "concat(name, ' — ', label) AS title",
                        "CAST(day AS TIMESTAMP_NTZ) + make_dt_interval(off, hour - 3) AS kickoff")
