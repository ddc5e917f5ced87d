"""Name resolution and feed-to-match joins.

Names are resolved once per distinct spelling. Looser steps see only what exact steps left, and
candidates come from equi-joins on shared pieces of the names, never from all pairs of a group.
"""
import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from touchline.functions import naming
from touchline.session import stored

STRICT_CUTOFF, SECOND_CUTOFF, LOOSE_CUTOFF = 0.88, 0.86, 0.72
RESERVE_SUFFIX = r"\s(W|Res\.?|II|B)$"


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio, second argument as the pattern."""
    return pd.Series([difflib.SequenceMatcher(None, y, x).ratio() for x, y in zip(a, b)], dtype="float64")


def grams(text: str, n: int) -> str:
    """SQL text: distinct n-letter pieces of a string."""
    return (f"IF(length({text}) >= {n}, array_distinct(transform(sequence(1, length({text}) - {n - 1}), i -> substr({text}, i, {n}))),"
            " CAST(array() AS ARRAY<STRING>))")


def similar_keys(text: str, cutoff: float) -> str:
    """SQL text: pieces of which two names at or above the cutoff always share one.

    With S letters in both names and ratio r, at most (1 - r) S letters are unmatched, so the
    rS/2 matched letters form at most (1 - r) S + 1 runs and one run has at least their mean
    length. That is above one letter, hence two, for every S at 0.86 and up; at 0.72 only from
    S = 13 on, so short names also carry their single letters.
    """
    pairs = grams(text, 2)
    if cutoff >= 0.86:
        return f"IF(length({text}) < 2, array({text}), {pairs})"
    return f"IF(length({text}) <= 12, array_union({pairs}, {grams(text, 1)}), {pairs})"


def team_keys(teams: DataFrame, block: str = "league") -> DataFrame:
    """(block, key, team_id): one team per normalised name, smallest id on a clash."""
    return teams.select(block, naming.feed_name(F.col("name")).alias("key"), "team_id").groupBy(block, "key").agg(
        F.min("team_id").alias("team_id"))


def resolve_exact(names: DataFrame, teams: DataFrame, aliases: DataFrame, block: str = "league") -> DataFrame:
    """(block, name, team_id, method) of distinct names by alias, then by normalised name."""
    return _exact(names, team_keys(teams, block), aliases, block)


def _exact(names: DataFrame, keys: DataFrame, aliases: DataFrame, block: str) -> DataFrame:
    n = names.select(block, "name").distinct().join(aliases.select(F.col("alias").alias("name"), F.col("name").alias("plain")), "name", "left")
    n = n.select(block, "name", naming.feed_name(F.col("plain")).alias("k1"), naming.feed_name(F.col("name")).alias("k2"))
    a = keys.select(block, F.col("key").alias("k1"), F.col("team_id").alias("t1"))
    b = keys.select(block, F.col("key").alias("k2"), F.col("team_id").alias("t2"))
    j = n.join(a, [block, "k1"], "left").join(b, [block, "k2"], "left")
    return j.select(block, "name", F.coalesce("t1", "t2").alias("team_id"),
                    F.when(F.col("t1").isNotNull(), "alias").when(F.col("t2").isNotNull(), "exact").alias("method"), F.col("k2").alias("norm"))


def _contained(left: DataFrame, keys: DataFrame, block: str, least: int) -> DataFrame:
    """Pairs where one normalised text contains the other (both at least ``least`` long).

    If a contains b, then b's first ``least`` letters are one of a's pieces.
    """
    l, k = left.filter(f"length(norm) >= {least}"), keys.filter(f"length(key) >= {least}")
    l_all, k_all = l.selectExpr("*", f"explode({grams('norm', least)}) AS g"), k.selectExpr("*", f"explode({grams('key', least)}) AS g")
    l_one, k_one = l.selectExpr("*", f"substr(norm, 1, {least}) AS g"), k.selectExpr("*", f"substr(key, 1, {least}) AS g")
    cols = [block, "name", "norm", "key", "team_id"]
    inside = l_all.join(k_one, [block, "g"]).filter("contains(norm, key)").select(*cols)
    around = l_one.join(k_all, [block, "g"]).filter("contains(key, norm)").select(*cols)
    return inside.unionByName(around).distinct()


def resolve(names: DataFrame, teams: DataFrame, aliases: DataFrame, *, block: str = "league", cutoff: float = STRICT_CUTOFF,
            containment: bool = False) -> DataFrame:
    """The full ladder: alias, exact, optional containment (3 letters up), then similarity.

    Every step reads the distinct spellings and team keys again, so both are stored: the tables behind them are read once.
    """
    keys = stored(team_keys(teams, block))
    exact = stored(_exact(names, keys, aliases, block))
    done = exact.filter("team_id IS NOT NULL").select(block, "name", "team_id", "method")
    left = exact.filter("team_id IS NULL AND norm <> ''").select(block, "name", "norm")
    if containment:
        c = _contained(left, keys, block, 3).groupBy(block, "name").agg(F.min("team_id").alias("team_id")).withColumn("method", F.lit("contains"))
        done = done.unionByName(c)
        left = left.join(c.select(block, "name"), [block, "name"], "left_anti")
    lk = left.selectExpr("*", f"explode({similar_keys('norm', cutoff)}) AS g")
    kk = keys.selectExpr("*", f"explode({similar_keys('key', cutoff)}) AS g")
    pairs = lk.join(kk, [block, "g"]).select(block, "name", "norm", "key", "team_id").distinct()
    # a ratio of r needs lengths within 2/r - 1 of each other
    pairs = pairs.filter(f"2 * least(length(norm), length(key)) >= {cutoff}D * (length(norm) + length(key)) - 1e-9D")
    scored = pairs.withColumn("score", similarity("key", "norm")).filter(F.col("score") >= cutoff)
    fuzzy = scored.groupBy(block, "name").agg(F.max_by("team_id", F.struct("score", "key")).alias("team_id")).withColumn("method", F.lit("fuzzy"))
    return done.unionByName(fuzzy)


def names_match(names: DataFrame, teams: DataFrame, aliases: DataFrame, block: str = "league") -> DataFrame:
    """(block, name, team_id): every team a spelling may mean: equal, aliased, or normalised containment."""
    n = names.select(block, "name").distinct().join(aliases.select(F.col("alias").alias("name"), F.col("name").alias("plain")), "name", "left")
    n = n.select(block, "name", F.coalesce("plain", "name").alias("plain")).withColumn("norm", naming.feed_name(F.col("plain"))).filter("norm <> ''")
    t = teams.select(block, "team_id", F.col("name").alias("team_name"), naming.feed_name(F.col("name")).alias("key")).filter("key <> ''")
    same = n.join(t.withColumnRenamed("key", "norm"), [block, "norm"]).select(block, "name", "team_id")
    # containment of any length: a one-letter head is enough as the join piece
    near = _contained(n.select(block, "name", "norm"), t.select(block, "key", "team_id"), block, 1).select(block, "name", "team_id")
    return same.unionByName(near).distinct()


def window_buckets(ts: Column, hours: int) -> Column:
    """Bucket number of a clock; two times less than ``hours`` apart are at most one bucket apart."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(hours * 3_600_000_000))


def interval_join(rows: DataFrame, matches: DataFrame, keys, hours: int, *, strict: bool, rank) -> DataFrame:
    """First match per row among those with equal ``keys`` and kickoffs within ``hours``.

    Rows are put into their own and both neighbouring time buckets, which makes the window an
    equi-join; ``rank`` is the list of SQL texts over a row's columns that orders candidates, ties go to the smallest match_id.
    """
    keys = list(keys)
    b = window_buckets(F.col("kickoff"), hours)
    right = matches.select(*keys, "match_id", F.col("kickoff").alias("match_kickoff"))
    left = rows
    if rank is not None:
        # rows that share keys and kickoff share their first match, and of matches that do so only the first counts:
        # clocks meet clocks, whatever number of rows and matches stand behind them
        right = right.groupBy(*keys, "match_kickoff").agg(F.expr("min(struct(match_id)).match_id AS match_id"))
        left = rows.select(*keys, "kickoff").distinct()
    left = left.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    right = right.withColumn("_b", window_buckets(F.col("match_kickoff"), hours))
    gap = F.abs(F.unix_micros(F.col("kickoff").cast("timestamp")) - F.unix_micros(F.col("match_kickoff").cast("timestamp")))
    limit = F.lit(hours * 3_600_000_000)
    j = left.join(right, [*keys, "_b"]).withColumn("gap", gap).filter(F.col("gap") < limit if strict else F.col("gap") <= limit)
    if rank is None:
        return j.drop("_b", "gap")
    first = j.groupBy(*keys, "kickoff").agg(F.expr("min(struct(match_id)).match_id AS match_id"))
    return rows.join(first, [*keys, "kickoff"]).groupBy("row_id").agg(F.expr(f"min(struct({', '.join(rank)}, match_id)).match_id AS match_id"))


def by_team(matches: DataFrame) -> DataFrame:
    """Matches seen from each team: an either-side test becomes one equi key."""
    return matches.selectExpr("match_id", "league", "kickoff", "explode(array(home_team_id, away_team_id)) AS team_id")


# ---- entity matching against a second provider's club list ----

def entity_exact(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pass 1 (country, name -> entity_id, method): equal, equal without club words, or the only container."""
    o = ours.select("country", "name", naming.entity_name(F.col("name")).alias("n"), naming.entity_core(F.col("name")).alias("norm")).distinct()
    t = theirs.select("country", "entity_id", naming.entity_name(F.col("name")).alias("n"), naming.entity_core(F.col("name")).alias("key"))
    by_n = t.groupBy("country", "n").agg(F.min("entity_id").alias("e1"))
    by_s = t.filter("key <> ''").groupBy("country", "key").agg(F.min("entity_id").alias("e2")).withColumnRenamed("key", "norm")
    x = o.join(by_n, ["country", "n"], "left").join(by_s, ["country", "norm"], "left")
    hit = x.filter("e1 IS NOT NULL OR e2 IS NOT NULL").select(
        "country", "name", F.coalesce("e1", "e2").alias("entity_id"), F.when(F.col("e1").isNotNull(), "exact").otherwise("stripped").alias("method"))
    left = x.filter("e1 IS NULL AND e2 IS NULL").select("country", "name", "norm")
    c = _contained(left, t.select("country", "key", F.col("entity_id").alias("team_id")), "country", 5)
    only = c.groupBy("country", "name").agg(F.count_distinct("team_id").alias("k"), F.min("team_id").alias("entity_id")).filter("k = 1")
    return hit.unionByName(only.select("country", "name", "entity_id", F.lit("contains").alias("method")))


def _near_keys(s: str) -> str:
    """SQL text: the text with up to two letters left out; texts at most two edits apart share one."""
    cut = lambda t: f"transform(sequence(1, length({t})), i -> concat(substr({t}, 1, i - 1), substr({t}, i + 1)))"
    return f"array_distinct(concat(array({s}), {cut(s)}, flatten(transform({cut(s)}, d -> {cut('d')}))))"


def entity_scored(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Pass 2 (country, name -> entity_id, score): best scored candidate at 40 or more, ties rejected."""
    core = lambda c: naming.entity_core(F.col(c), naming.ENTITY_STOPWORDS_WIDE, synonyms=True)
    o = ours.select("country", "name").distinct().withColumns({"s": core("name"), "res": F.rlike(F.trim("name"), F.lit(RESERVE_SUFFIX))}).filter("s <> ''")
    t = theirs.select("country", "entity_id", F.col("name").alias("their")).withColumns({"c": core("their"), "their_res": F.rlike(F.trim("their"), F.lit(RESERVE_SUFFIX))})
    # duplicates of one club differ only by club words: the first record stands for all of them,
    # apart for first teams and reserves because a first team never meets a reserve squad
    t = t.filter("c <> ''").groupBy("country", "c", "their_res").agg(F.min("entity_id").alias("entity_id"))
    pieces = lambda s: (f"concat(transform(split({s}, ' '), x -> concat('t:', x)), IF(length({s}) >= 3, transform({_near_keys(s)}, x -> concat('d:', x)), array()))")
    lo = o.selectExpr("country", "name", "s", "res", f"explode(array_distinct({pieces('s')})) AS g")
    lt = t.selectExpr("country", "entity_id", "c", "their_res", f"explode(array_distinct({pieces('c')})) AS g")
    cols = ["country", "name", "s", "res", "entity_id", "c", "their_res"]
    shared = lo.join(lt, ["country", "g"]).select(*cols)
    box = _contained(o.select("country", "name", F.col("s").alias("norm")), t.select("country", F.col("c").alias("key"), F.col("entity_id").alias("team_id")), "country", 4)
    boxed = box.select("country", "name", F.col("team_id").alias("entity_id")).join(o, ["country", "name"]).join(t, ["country", "entity_id"]).select(*cols)
    pairs = shared.unionByName(boxed).distinct().filter("res OR NOT their_res")
    pairs = pairs.withColumns({
        "n1": F.size(F.array_distinct(F.split("s", " "))), "n2": F.size(F.array_distinct(F.split("c", " "))),
        "inter": F.array_intersect(F.split("s", " "), F.split("c", " "))})
    score = F.expr("""CASE WHEN c = s THEN 100
        WHEN levenshtein(c, s, 2) >= 0 AND length(s) >= 5 THEN 90
        WHEN (contains(c, s) OR contains(s, c)) AND least(length(c), length(s)) >= 4 THEN 80
        WHEN size(inter) = least(n1, n2) AND size(inter) > 0 THEN 60 + 5 * size(inter)
        WHEN exists(inter, x -> length(x) >= 6) THEN 40 + 5 * size(inter) ELSE 0 END""")
    # a first team's list has reserves taken out before duplicates collapse, so one core counts once
    per = pairs.withColumn("score", score).filter("score > 0").groupBy("country", "name", "c").agg(
        F.max("score").alias("score"), F.min("entity_id").alias("entity_id"))
    w = Window.partitionBy("country", "name")
    top = per.withColumn("best", F.max("score").over(w)).filter("score = best AND score >= 40")
    return top.groupBy("country", "name").agg(F.count("*").alias("k"), F.min("entity_id").alias("entity_id"), F.max("score").alias("score")).filter("k = 1").drop("k")


def resolve_country(ours: DataFrame, theirs: DataFrame, aliases: DataFrame) -> DataFrame:
    """(country, provider country): the name itself, then its aliases in order, then containment."""
    t = theirs.select(F.col("country").alias("theirs"), naming.entity_name(F.col("country")).alias("n"))
    o = ours.select("country").distinct()
    cand = o.select("country", F.col("country").alias("try"), F.lit(0).alias("pos")).unionByName(
        o.join(aliases, "country").select("country", F.col("alias").alias("try"), F.col("pos")))
    hit = cand.withColumn("n", naming.entity_name(F.col("try"))).join(t, "n").groupBy("country").agg(F.min_by("theirs", F.struct("pos", "theirs")).alias("theirs"))
    left = o.join(hit, "country", "left_anti").select(F.lit("x").alias("b"), F.col("country").alias("name"), naming.entity_name(F.col("country")).alias("norm"))
    near = _contained(left, t.select(F.lit("x").alias("b"), F.col("n").alias("key"), F.col("theirs").alias("team_id")), "b", 1)
    return hit.unionByName(near.groupBy("name").agg(F.min("team_id").alias("theirs")).withColumnRenamed("name", "country"))
