"""Landed result and fixture files whose columns differ from file to file.

Lines are read in splittable form, so one large file spreads over many tasks. Each file's own
header line is found by its column names and joined back by file path; fields are then picked
by name. Lines with more fields than their header are bad and dropped, as are wrapper lines in
front of the header (they carry no date).
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.functions import times
from touchline.session import literal_rows

# League catalog (code, name, country, file format).
LEAGUES = [
    ("E0", "Premier League", "England", "main"), ("D1", "Bundesliga", "Germany", "main"),
    ("I1", "Serie A", "Italy", "main"), ("SP1", "La Liga", "Spain", "main"), ("F1", "Ligue 1", "France", "main"),
    ("N1", "Eredivisie", "Netherlands", "main"), ("B1", "Jupiler Pro League", "Belgium", "main"),
    ("P1", "Primeira Liga", "Portugal", "main"), ("T1", "Süper Lig", "Turkey", "main"),
    ("G1", "Super League", "Greece", "main"), ("SC0", "Premiership", "Scotland", "main"),
    ("AUT", "Bundesliga", "Austria", "new"), ("DNK", "Superliga", "Denmark", "new"),
    ("FIN", "Veikkausliiga", "Finland", "new"), ("IRL", "Premier Division", "Ireland", "new"),
    ("NOR", "Eliteserien", "Norway", "new"), ("POL", "Ekstraklasa", "Poland", "new"),
    ("ROU", "Liga I", "Romania", "new"), ("RUS", "Premier League", "Russia", "new"),
    ("SWE", "Allsvenskan", "Sweden", "new"), ("SWZ", "Super League", "Switzerland", "new"),
]
# Price columns per source, home/draw/away and over/under 2.5.
MAIN_1X2 = {"B365C": ("B365CH", "B365CD", "B365CA"), "PSC": ("PSCH", "PSCD", "PSCA"), "B365": ("B365H", "B365D", "B365A"),
            "PS": ("PSH", "PSD", "PSA"), "WH": ("WHH", "WHD", "WHA")}
MAIN_OU = {"B365C": ("B365C>2.5", "B365C<2.5"), "B365": ("B365>2.5", "B365<2.5"), "P": ("P>2.5", "P<2.5")}
NEW_1X2 = {"PSC": ("PSCH", "PSCD", "PSCA"), "B365C": ("B365CH", "B365CD", "B365CA"), "BFEC": ("BFECH", "BFECD", "BFECA"),
           "AvgC": ("AvgCH", "AvgCD", "AvgCA"), "MaxC": ("MaxCH", "MaxCD", "MaxCA")}
WRAPPER_MARKER = "Markdown Content:"


def catalog(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, LEAGUES, "code, name, country, format")


def strip_wrapper(text: Column) -> Column:
    """Body after the wrapper marker, or the text unchanged."""
    at = F.instr(text, WRAPPER_MARKER)
    body = F.regexp_replace(F.substring(text, at + F.lit(len(WRAPPER_MARKER)), F.length(text)), r"^\s+", "")
    return F.when(at > 0, body).otherwise(text)


def read_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line) of landed text files in Latin-1, read in splittable form."""
    return (
        spark.read.schema("line string").option("sep", "\u0001").option("quote", "").option("encoding", "ISO-8859-1")
        .csv(paths).select(F.col("_metadata.file_path").alias("file"), "line")
    )


def split_cells(line: Column) -> Column:
    """Cells of a comma-separated line; a cell in quotes may hold commas, and doubled quotes stand for one."""
    outside = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    bare = F.transform(outside, lambda c: F.when(F.trim(c).rlike('^".*"$'), F.replace(F.regexp_replace(F.trim(c), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    return F.when(F.contains(line, F.lit('"')), bare).otherwise(F.split(line, ",", -1))


def named_lines(lines: DataFrame, required) -> DataFrame:
    """(file, header, fields): data lines of every file that has the required columns."""
    clean = F.regexp_replace("line", "^(ï»¿|\ufeff)|\r$", "")
    cells = lines.select("file", split_cells(clean).alias("fields"))
    need = F.array(*[F.lit(c) for c in required])
    is_header = F.size(F.array_except(need, F.col("fields"))) == 0
    # one header per file: a table as small as the list of files
    header = cells.filter(is_header).groupBy("file").agg(F.max("fields").alias("header"))
    # sent to every task: dealt by file, the lines of one large file would end in one task
    body = cells.filter(~is_header).join(F.broadcast(header), "file")
    return body.filter(F.size("fields") <= F.size("header")).select("file", "header", "fields")


def field(name: str) -> Column:
    """The named cell, null when the column or the value is missing."""
    pos = F.array_position("header", name).cast("int")
    return F.when(pos > 0, F.nullif(F.trim(F.get("fields", pos - 1)), F.lit("")))


def _whole(name):
    return field(name).try_cast("double").cast("int")


def _price_columns(one_x_two, ou=None):
    """Price structs of every source whose columns are all filled."""
    items = []
    for market, sels, table in (("1X2", ("1", "X", "2"), one_x_two), ("OU_2.5", ("over", "under"), ou or {})):
        for src, cols in table.items():
            prices = [field(c).try_cast("double") for c in cols]
            complete = prices[0].isNotNull()
            for p in prices[1:]:
                complete = complete & p.isNotNull()
            items += [F.struct(F.lit(src).alias("source"), F.lit(market).alias("market"), F.lit(s).alias("selection"),
                               F.when(complete, p).alias("decimal_odds")) for s, p in zip(sels, prices)]
    return F.filter(F.array(*items), lambda x: x["decimal_odds"].isNotNull()).alias("prices")


def season_results(lines: DataFrame) -> DataFrame:
    """Main-format season files ``.../<season>/<league>.csv`` as finished matches with prices."""
    x = named_lines(lines, ["Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG"])
    m = x.select(
        F.regexp_extract("file", r"([^/]+)\.csv$", 1).alias("league"), F.regexp_extract("file", r"([^/]+)/[^/]+\.csv$", 1).alias("season"),
        times.kickoff(field("Date"), F.coalesce(field("Time"), F.lit(""))).alias("kickoff"),
        field("HomeTeam").alias("home_team"), field("AwayTeam").alias("away_team"),
        _whole("FTHG").alias("ft_home"), _whole("FTAG").alias("ft_away"), _whole("HTHG").alias("ht_home"), _whole("HTAG").alias("ht_away"),
        F.lit("finished").alias("status"), _price_columns(MAIN_1X2, MAIN_OU))
    return m.dropna(subset=["home_team", "away_team", "ft_home", "ft_away", "kickoff"])


def country_results(lines: DataFrame, seasons=None) -> DataFrame:
    """Per-country files ``.../<league>.csv`` with every season inside; optional year filter by substring."""
    x = named_lines(lines, ["Date", "Home", "Away", "HG", "AG"])
    m = x.select(
        F.regexp_extract("file", r"([^/]+)\.csv$", 1).alias("league"), F.coalesce(field("Season"), F.lit("unknown")).alias("season"),
        times.kickoff(field("Date"), F.coalesce(field("Time"), F.lit(""))).alias("kickoff"),
        field("Home").alias("home_team"), field("Away").alias("away_team"), _whole("HG").alias("ft_home"), _whole("AG").alias("ft_away"),
        F.lit("finished").alias("status"), _price_columns(NEW_1X2))
    if seasons:
        m = m.filter(F.exists(F.array(*[F.lit(y) for y in seasons]), lambda y: F.contains(F.col("season"), y)))
    return m.dropna(subset=["home_team", "away_team", "ft_home", "ft_away", "kickoff"])


def price_rows(results: DataFrame) -> DataFrame:
    """Long price rows of the result files."""
    return results.select("league", "season", "kickoff", "home_team", "away_team", F.inline("prices"))


def main_fixtures(lines: DataFrame, codes=None) -> DataFrame:
    """Upcoming fixtures, main format: known league codes only, season from the kickoff."""
    x = named_lines(lines, ["Div", "Date", "HomeTeam", "AwayTeam"])
    known = catalog(lines.sparkSession).filter("format = 'main'").select(F.col("code").alias("league"))
    m = x.select(field("Div").alias("league"), times.kickoff(field("Date"), F.coalesce(field("Time"), F.lit(""))).alias("kickoff"),
                 field("HomeTeam").alias("home_team"), field("AwayTeam").alias("away_team"))
    m = m.join(F.broadcast(known), "league", "left_semi").dropna(subset=["home_team", "away_team", "kickoff"])
    m = m.filter(F.col("league").isin(list(codes))) if codes else m
    return m.withColumns({"season": times.season_of(F.col("kickoff")), "status": F.lit("scheduled")})


def new_fixtures(lines: DataFrame, codes=None) -> DataFrame:
    """Upcoming fixtures, new format: league by country name in any case, season or kickoff year."""
    x = named_lines(lines, ["Country", "Date", "Home", "Away"])
    known = catalog(lines.sparkSession).filter("format = 'new'").select(F.lower("country").alias("c"), F.col("code").alias("league"))
    m = x.select(F.lower(field("Country")).alias("c"), times.kickoff(field("Date"), F.coalesce(field("Time"), F.lit(""))).alias("kickoff"),
                 field("Home").alias("home_team"), field("Away").alias("away_team"), field("Season").alias("s"))
    m = m.join(F.broadcast(known), "c").dropna(subset=["home_team", "away_team", "kickoff"])
    m = m.filter(F.col("league").isin(list(codes))) if codes else m
    return m.select("league", F.coalesce("s", F.year("kickoff").cast("string")).alias("season"), "kickoff", "home_team", "away_team",
                    F.lit("scheduled").alias("status"))


def league_totals(results: DataFrame, only=None, skip=None) -> DataFrame:
    """Rows per league of a bulk load, with only/skip lists."""
    r = results.filter(F.col("league").isin(list(only))) if only else results
    r = r.filter(~F.col("league").isin(list(skip))) if skip else r
    return r.groupBy("league").agg(F.count("*").alias("matches"), F.count_distinct("season").alias("seasons"))
