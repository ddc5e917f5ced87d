"""Keyed upserts, diffs, reconciliation, retention, live folds: tables in, tables out."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.session import stored

STATUS_RANK = {"scheduled": 0, "in_play": 1, "paused": 1, "finished": 2}


def diff(existing: DataFrame, wanted: DataFrame, key: str, cols, keep_when_empty=()) -> DataFrame:
    """Full outer comparison: key, action (create / update / keep / absent) and the wanted values.

    A column in ``keep_when_empty`` is only compared when the wanted value is present.
    """
    e = existing.select(F.col(key).alias("_k1"), *[F.col(c).alias(f"_old_{c}") for c in cols])
    w = wanted.select(F.col(key).alias("_k2"), *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = e.join(w, F.col("_k1") == F.col("_k2"), "full_outer")
    changed = F.lit(False)
    out = []
    for c in cols:
        differs = ~F.col(f"_old_{c}").eqNullSafe(F.col(f"_new_{c}"))
        if c in keep_when_empty:
            given = F.coalesce(F.col(f"_new_{c}").cast("string"), F.lit("")) != ""
            differs = given & differs
            out.append(F.when(given, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c))
        else:
            out.append(F.when(F.col("_k2").isNotNull(), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c))
        changed = changed | differs
    action = F.when(F.col("_k1").isNull(), "create").when(F.col("_k2").isNull(), "absent").when(changed, "update").otherwise("keep")
    return j.select(F.coalesce("_k1", "_k2").alias(key), action.alias("action"), *out)


def upsert(existing: DataFrame, incoming: DataFrame, key: str, cols) -> DataFrame:
    """The table after inserting new keys and changing only what differs."""
    return diff(existing, incoming, key, cols).select(key, *cols)


def upsert_matches(existing: DataFrame, incoming: DataFrame, key: str, cols) -> DataFrame:
    """Upsert of match rows that never goes back: a row of a lower status changes nothing, and a final score is written once.

    Several incoming rows of a key: the one furthest in status counts, of these the last by ``cols``.
    """
    e = existing.select(F.col(key).alias("_k1"), *[F.col(c).alias(f"_old_{c}") for c in cols])
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(status_rank(F.col("status")), *cols)).alias("_n"))
    w = last.select(F.col(key).alias("_k2"), *[F.col(f"_n.{c}").alias(f"_new_{c}") for c in cols])
    j = e.join(w, F.col("_k1") == F.col("_k2"), "full_outer")
    forward = F.col("_k1").isNull() | (F.col("_k2").isNotNull() & (status_rank(F.col("_new_status")) >= status_rank(F.col("_old_status"))))
    out = []
    for c in cols:
        new = F.when(forward, F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}"))
        out.append((F.coalesce(f"_old_{c}", f"_new_{c}") if c in ("ft_home", "ft_away") else new).alias(c))
    return j.select(F.coalesce("_k1", "_k2").alias(key), *out)


def status_rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, r) for s, r in STATUS_RANK.items()], F.lit(0))


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str, cols) -> DataFrame:
    return diff(existing, incoming, key, cols).filter("action <> 'absent'").groupBy("action").agg(F.count("*").alias("n"))


def upsert_fixtures(existing: DataFrame, fixtures: DataFrame, key) -> DataFrame:
    """Fixture outcome per row: inserted, updated, or skipped because the match is finished."""
    key = list(key)
    e = existing.select(*key, F.col("status").alias("_s"))
    return fixtures.join(e, key, "left").withColumn(
        "outcome", F.when(F.col("_s").isNull(), "inserted").when(F.col("_s") == "finished", "skipped").otherwise("updated")).drop("_s")


def fixture_table(existing: DataFrame, fixtures: DataFrame, key, cols) -> DataFrame:
    """The match table after a fixture load: new rows come in as scheduled, open rows take the fixture's ``cols``, finished rows stay."""
    key = list(key)
    f = fixtures.select(*key, *[F.col(c).alias(f"_f_{c}") for c in cols], F.lit(True).alias("_listed"))
    j = existing.join(f, key, "full_outer")
    take = F.col("_listed").isNotNull() & (F.coalesce(F.col("status"), F.lit("")) != "finished")
    kept = [c for c in existing.columns if c not in key and c not in cols and c != "status"]
    return j.select(*key, *[F.when(take, F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
                    F.coalesce("status", F.lit("scheduled")).alias("status"), *kept)


def keep_first(df: DataFrame, key, order) -> DataFrame:
    """One row per key, the first in ``order``; a ranked filter cut before the shuffle."""
    from pyspark.sql import Window
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def append_new(existing: DataFrame, incoming: DataFrame, key, order=()) -> DataFrame:
    """Rows of ``incoming`` whose key is not stored yet, of each key the first in ``order``: replay adds nothing.

    Without an order, rows of one key must be equal (any of them is taken).
    """
    key = list(key)
    once = keep_first(incoming, key, order) if order else incoming.dropDuplicates(key)
    return once.join(existing.select(*key), key, "left_anti")


def replace_predictions(before: DataFrame, fresh: DataFrame) -> DataFrame:
    """Delete-then-insert per match: fresh rows win for their matches."""
    return before.join(fresh.select("match_id").distinct(), "match_id", "left_anti").unionByName(fresh)


def write_predictions(fresh: DataFrame, path: str, buckets: int = 64) -> None:
    """Sink by match bucket (``buckets`` fixes the layout and the most tasks of a write); only touched buckets are rewritten.

    The stored rows of those buckets are merged in first, so a replay leaves the same table.
    """
    spark = fresh.sparkSession
    bucket = F.pmod(F.hash("match_id"), F.lit(buckets)).alias("bucket")
    new = fresh.select("*", bucket)
    try:
        before = spark.read.parquet(path)
    except Exception as exc:  # first write: nothing stored yet
        if "PATH_NOT_FOUND" not in str(exc):
            raise
    else:
        before = before.join(F.broadcast(new.select("bucket").distinct()), "bucket", "left_semi")
        new = stored(replace_predictions(before.select(*new.columns), new))  # the old files are read before they are replaced
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def save_curve(curve: DataFrame, path: str) -> None:
    curve.write.mode("overwrite").parquet(path)


def load_curve(spark, path: str) -> DataFrame:
    """The stored calibration curves; a missing table is an empty one, which calibrates nothing."""
    try:
        return spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.sql("SELECT '' AS market, 0D AS x, 0D AS y, 0L AS n_train WHERE false")


def ghosts(stored: DataFrame, listed: DataFrame, start: Column, end: Column, key: str = "external_ref") -> DataFrame:
    """Scheduled rows in the window that the provider no longer lists; none when it listed nothing."""
    any_listed = listed.agg(F.count("*").alias("n")).scalar()
    window = stored.filter((F.col("status") == "scheduled") & (F.col("kickoff") >= start) & (F.col("kickoff") < end) & (any_listed > 0))
    return window.join(listed.select(key).distinct(), key, "left_anti")


def purge_report(matches: DataFrame, now: Column) -> DataFrame:
    """What a history reset removes and keeps."""
    past = (F.col("status") == "scheduled") & (F.col("kickoff") < now)
    return matches.agg(F.count_if(past).alias("deleted"), F.count_if(F.col("status") == "finished").alias("kept_finished"),
                       F.count_if((F.col("status") == "scheduled") & (F.col("kickoff") >= now)).alias("kept_future"))


def purge(matches: DataFrame, now: Column) -> DataFrame:
    return matches.filter(~((F.col("status") == "scheduled") & (F.col("kickoff") < now)))


def prunable(events: DataFrame, now: Column) -> DataFrame:
    """Events older than two days, and rows without a key in the coming week."""
    past, future = now - F.expr("INTERVAL 2 DAYS"), now + F.expr("INTERVAL 7 DAYS")
    k = F.col("kickoff")
    return events.filter((k < past) | (F.col("external_ref").isNull() & (k >= past) & (k <= future)))


def merge_maps(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keyed union where the right side wins."""
    return left.join(right.select(key).distinct(), key, "left_anti").unionByName(right.select(*left.columns))


def finalise_stuck(matches: DataFrame, now: Column, hours: int = 6) -> DataFrame:
    """Running matches older than ``hours`` with a live score become finished from it."""
    stuck = (F.col("status").isin("paused", "in_play") & (F.col("kickoff") < now - F.make_dt_interval(F.lit(0), F.lit(hours)))
             & (F.col("ft_home").isNull() | F.col("ft_away").isNull()) & F.col("live_home").isNotNull() & F.col("live_away").isNotNull())
    return matches.withColumn("_x", stuck).withColumns({
        "ft_home": F.when(F.col("_x"), F.col("live_home")).otherwise(F.col("ft_home")),
        "ft_away": F.when(F.col("_x"), F.col("live_away")).otherwise(F.col("ft_away")),
        "status": F.when(F.col("_x"), "finished").otherwise(F.col("status")),
        "live_minute": F.when(~F.col("_x"), F.col("live_minute")), "live_home": F.when(~F.col("_x"), F.col("live_home")),
        "live_away": F.when(~F.col("_x"), F.col("live_away"))}).drop("_x")


LIVE_SCHEMA = "match_id long, status string, live_minute int, live_home long, live_away long, ft_home long, ft_away long"


def fold_live(feed: DataFrame) -> DataFrame:
    """Live state per match after all its feed rows, in event order, as one aggregate.

    A finished row closes a match; each side's final goals are the first ones that a finished row carries. Before
    that the newest running row counts. Max/min by time combine map-side, so a match with any number of rows is cheap.
    """
    f = feed.filter("status IN ('IN_PLAY', 'PAUSED', 'FINISHED')").selectExpr(
        "match_id", "struct(event_time, event_id) AS at", "status",
        "CAST(regexp_extract(minute, '^([0-9]+)', 1) AS INT) + CAST(coalesce(nullif(regexp_extract(minute, '^[0-9]+[+]([0-9]+)', 1), ''), '0') AS INT) AS minute",
        "home_goals", "away_goals")
    run = "status <> 'FINISHED'"
    g = f.groupBy("match_id").agg(*[F.expr(x) for x in (
        "count_if(status = 'FINISHED') > 0 AS closed",
        "min_by(home_goals, IF(status = 'FINISHED' AND home_goals IS NOT NULL, at, NULL)) AS fh",
        "min_by(away_goals, IF(status = 'FINISHED' AND away_goals IS NOT NULL, at, NULL)) AS fa",
        f"max_by(IF({run}, struct(status, minute, coalesce(home_goals, 0) AS h, coalesce(away_goals, 0) AS a), NULL), IF({run}, at, NULL)) AS live")])
    return g.selectExpr(
        "match_id", "CASE WHEN closed THEN 'finished' WHEN live.status = 'PAUSED' THEN 'paused' ELSE 'in_play' END AS status",
        "IF(closed, NULL, live.minute) AS live_minute", "IF(closed, NULL, live.h) AS live_home", "IF(closed, NULL, live.a) AS live_away",
        "fh AS ft_home", "fa AS ft_away")
