"""Football tables derived by Spark from the given parquet tables (rules of FIXTURES.md).

No football files come with the test data, so every registered query reads these: they grow
row for row with ``orders`` and ``events``.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-01-01 00:00:00"
NOW_LIVE = "2024-01-30 00:00:00"
GAMMA, DELTA, RHO = 0.25, 0.1, -0.1
# Club spellings of the derived team dimension (position = team_id % 20).
CLUBS = [
    "Beşiktaş", "Göztepe", "1. FC Köln", "Man United", "Fenerbahçe", "Real Sociedad", "Sporting Lisbon",
    "Bodø/Glimt", "Austria Wien", "Slavia Praha", "Legia Warszawa", "Paris SG", "Wolves", "Nott'm Forest",
    "FC Basel", "Győri ETO", "Malmö FF", "Botoșani", "Ēriks Rīga", "Dinamo Zagreb",
]
# Provider spellings that only an alias table can resolve.
ALIASES = {
    "Manchester United FC": "Man United", "Paris Saint-Germain": "Paris SG",
    "Wolverhampton Wanderers": "Wolves", "Nottingham Forest": "Nott'm Forest",
    "Sporting CP": "Sporting Lisbon", "Bodo Glimt": "Bodø/Glimt",
}
PRICED = [("1X2", "1", 1), ("1X2", "X", 2), ("1X2", "2", 3), ("OU_2.5", "over", 4), ("OU_2.5", "under", 5)]
SOURCES = [("PSC", 1), ("B365C", 2), ("B365", 3)]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


ROWS_A_TASK = 100_000  # derived matches in one partition, so what a task sorts or hashes does not grow with the input


def spread(df: DataFrame, key: str) -> DataFrame:
    """Derived rows dealt out by their key, so one large input file feeds every core and later joins by match find them in place."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // ROWS_A_TASK)), key)


def now(text: str = NOW) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def matches(spark: SparkSession, d: str) -> DataFrame:
    played = "o_orderstatus <> 'P'"
    lg, fh, fa = "(o_custkey % 5) * 100", "(o_orderkey * 7 + o_custkey * 3) % 5", "(o_orderkey * 11 + o_custkey * 5) % 4"

    def xg(goals):
        return (f"IF({played} AND o_orderkey % 3 <> 0, "
                f"round(greatest(0.05D, {goals} + (o_orderkey % 7 - 3) / 10D), 6), NULL)")

    return spread(table(spark, d, "orders"), "o_orderkey").selectExpr(
        "o_orderkey AS match_id", "concat('L', o_custkey % 5) AS league",
        "CAST(year(o_orderdate) AS STRING) AS season", "o_orderdate AS kickoff",
        f"{lg} + o_orderkey % 20 AS home_team_id", f"{lg} + (o_orderkey % 20 + 1 + o_custkey % 19) % 20 AS away_team_id",
        f"IF({played}, 'finished', 'scheduled') AS status",
        f"IF({played}, {fh}, NULL) AS ft_home", f"IF({played}, {fa}, NULL) AS ft_away",
        f"{xg(fh)} AS xg_home", f"{xg(fa)} AS xg_away",
    )


def live_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches where two thirds of the open rows are stuck in play or at half time."""
    running = "status = 'scheduled' AND match_id % 3 <> 0"
    return matches(spark, d).selectExpr(
        "match_id", "league", "season", "kickoff", "home_team_id", "away_team_id", "ft_home", "ft_away",
        f"CASE WHEN {running} THEN IF(match_id % 3 = 1, 'in_play', 'paused') ELSE status END AS status",
        f"IF({running}, match_id % 90 + 1, NULL) AS live_minute",
        f"IF({running} AND match_id % 5 <> 0, match_id % 4, NULL) AS live_home",
        f"IF({running} AND match_id % 5 <> 0, (match_id * 3) % 3, NULL) AS live_away")


def with_rates(df: DataFrame) -> DataFrame:
    """lam, mu, rho from the closed-form team strengths."""
    def s(team, factor):
        return f"(({team} * {factor}) % 21 - 10) / 25D"

    return df.selectExpr(
        "*", f"exp({s('home_team_id', 37)} + {s('away_team_id', 53)} + {GAMMA + DELTA}D) AS lam",
        f"exp({s('away_team_id', 37)} + {s('home_team_id', 53)} + {DELTA}D) AS mu", f"{RHO}D AS rho")


def rates(spark: SparkSession, d: str) -> DataFrame:
    return with_rates(matches(spark, d)).select("match_id", "lam", "mu", "rho")


def odds(spark: SparkSession, d: str) -> DataFrame:
    items = ", ".join(f"struct('{src}' AS source, '{mk}' AS market, '{sel}' AS selection, {sx} AS sx, {qx} AS qx)"
                      for mk, sel, sx in PRICED for src, qx in SOURCES)
    return spread(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey").selectExpr(
        "o_orderkey AS match_id", "o_orderdate AS kickoff", f"inline(array({items}))",
    ).filter("(match_id + qx) % 3 <> 0").selectExpr(
        "match_id * 100 + sx * 10 + qx AS odds_id", "match_id", "source", "market", "selection",
        "1.3D + ((match_id * 13 + sx * 37 + qx * 11) % 300) / 100D AS decimal_odds",
        "kickoff - make_dt_interval(0, qx) AS fetched_at")


def club(team: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in CLUBS]), (team % 20 + 1).cast("int"))


def teams(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    both = m.select("league", F.explode(F.array("home_team_id", "away_team_id")).alias("team_id")).distinct()
    return both.select("team_id", club(F.col("team_id")).alias("name"), "league",
                       F.concat(F.lit("C"), F.substring("league", 2, 9)).alias("country"))


def live_feed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    st = (F.when(F.col("event_type").isin("view", "click"), "IN_PLAY").when(F.col("event_type") == "signup", "PAUSED")
          .when(F.col("event_type") == "purchase", "FINISHED").otherwise("TIMED"))
    return e.select(
        "event_id", F.col("user_id").alias("match_id"), F.col("ts").alias("event_time"), st.alias("status"),
        (k % 4).alias("home_goals"), ((k * 7) % 3).alias("away_goals"),
        F.concat((k % 90).cast("string"), F.when(k % 5 == 0, "+2").otherwise("")).alias("minute"),
    )


def provider_rows(spark: SparkSession, d: str) -> DataFrame:
    """A second provider's view of each match: other spellings, shifted clock, own score."""
    m = matches(spark, d)
    k = F.col("match_id")
    shift = (k % 11 - 5) * 60  # minutes, -300 .. 300

    def spell(team, salt):
        name = club(team)
        back = {v: a for a, v in ALIASES.items()}
        alias = name
        for plain, other in back.items():
            alias = F.when(name == plain, other).otherwise(alias)
        v = (k + salt) % 6
        return (
            F.when(v == 0, name).when(v == 1, alias).when(v == 2, F.concat(F.upper(name), F.lit(" FC")))
            .when(v == 3, F.concat(name, F.lit(" City"))).when(v == 4, F.concat(name, F.lit("x")))
            .otherwise(F.concat(F.lit("Unknown "), (k % 97).cast("string")))
        )

    return m.select(
        (k * 10).alias("row_id"), k.alias("true_match_id"), "league",
        spell(F.col("home_team_id"), 0).alias("home_name"), spell(F.col("away_team_id"), 1).alias("away_name"),
        (F.col("kickoff") + F.make_dt_interval(F.lit(0), F.lit(0), shift.cast("int"))).alias("kickoff"),
        (k % 5).alias("home_goals"), (k % 3).alias("away_goals"),
    )


def absences(spark: SparkSession, d: str) -> DataFrame:
    """Injury rows: match_id, team_id, idx, name, position, raw reason."""
    m = matches(spark, d).filter((F.col("match_id") % 4 == 0) & (F.col("match_id") % 5 > 0))
    side = F.array(F.struct(F.col("home_team_id").alias("team_id"), F.lit(0).alias("s")),
                   F.struct(F.col("away_team_id").alias("team_id"), F.lit(1).alias("s")))
    x = m.select("match_id", "kickoff", F.inline(side))
    x = x.withColumn("n", (F.col("match_id") + F.col("s")) % 8).filter("n > 0")
    x = x.select("match_id", "kickoff", "team_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("idx"))
    pos = F.element_at(F.array(*[F.lit(p) for p in ("Midfielder", "Goalkeeper", "Forward", "Defender")]),
                       ((F.col("match_id") / 4 + F.col("idx")).cast("long") % 4 + 1).cast("int"))
    why = F.element_at(F.array(*[F.lit(p) for p in ("Missing Fixture", "Suspended", "Red Card", "Questionable", "Flu")]),
                       (F.col("idx") % 5 + 1).cast("int"))
    return x.select("match_id", "kickoff", "team_id", "idx",
                    F.concat(F.lit("P"), F.col("team_id").cast("string"), F.lit("-"), F.col("idx").cast("string")).alias("name"),
                    pos.alias("position"), why.alias("reason"))


def sport_events(spark: SparkSession, d: str) -> DataFrame:
    """Stored events of other sports, from the ``events`` table."""
    e = table(spark, d, "events")
    k = F.col("event_id")
    pick = lambda items, i: F.element_at(F.array(*[F.lit(x) for x in items]), (i + 1).cast("int"))
    return e.select(
        F.when(k % 10 == 9, F.lit(None).cast("string")).otherwise(F.concat(F.lit("ev:"), k.cast("string"))).alias("external_ref"),
        pick(["basketball", "tennis", "volleyball"], k % 3).alias("sport"),
        pick(["NBA", "BSL"], F.col("user_id") % 2).alias("league"),
        (F.col("ts") + F.make_dt_interval((k % 7).cast("int"))).alias("kickoff"),
        F.concat(F.lit("Home "), (F.col("user_id") % 30).cast("string")).alias("home_team"),
        F.concat(F.lit("Away "), (k % 30).cast("string")).alias("away_team"),
        F.when(k % 4 == 0, "finished").when(k % 4 == 1, "in_play").otherwise("scheduled").alias("status"),
        k.alias("event_id"),
    )
