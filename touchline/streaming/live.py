"""Continuous jobs as Structured Streaming plans.

State is kept by built-in aggregates and duplicate removal, so updates of one key combine
map-side and a hot match never funnels through one Python task. Every operator has a batch
twin that the tests compare it with.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions import naming, settle
from touchline.operators import compose, sync
from touchline.session import stored

KEEP = "2 days"          # how long a match or a result waits for late rows


def live_states(feed: DataFrame, kickoff: str | None = None) -> DataFrame:
    """Live status and score per match as feed rows arrive (update mode), one row a match across midnight.

    ``kickoff`` names the match's own kickoff (a timestamp, equal in all its rows). With it the state of a match ends
    ``KEEP`` after the newest kickoff has passed its own; without it every match stays in the state.
    """
    keys = ["match_id"]
    if kickoff:
        feed, keys = feed.withWatermark(kickoff, KEEP), ["match_id", kickoff]
    f = feed.filter("status IN ('IN_PLAY', 'PAUSED', 'FINISHED')").selectExpr(
        *keys, "struct(event_time, event_id) AS at", "status", "minute", "home_goals", "away_goals")
    g = f.groupBy(*keys).agg(*[F.expr(x) for x in (
        "count_if(status = 'FINISHED') > 0 AS closed",
        "min_by(home_goals, IF(status = 'FINISHED' AND home_goals IS NOT NULL, at, NULL)) AS fh",
        "min_by(away_goals, IF(status = 'FINISHED' AND away_goals IS NOT NULL, at, NULL)) AS fa",
        "max_by(IF(status <> 'FINISHED', struct(status, minute, coalesce(home_goals, 0) AS h, coalesce(away_goals, 0) AS a), NULL),"
        " IF(status <> 'FINISHED', at, NULL)) AS live")])
    return g.selectExpr(
        "match_id", "CASE WHEN closed THEN 'finished' WHEN live.status = 'PAUSED' THEN 'paused' ELSE 'in_play' END AS status",
        "IF(closed, NULL, live.minute) AS live_minute", "IF(closed, NULL, live.h) AS live_home", "IF(closed, NULL, live.a) AS live_away",
        "fh AS ft_home", "fa AS ft_away")


def feed_to_matches(feed: DataFrame, matches: DataFrame) -> DataFrame:
    """Stream-static interval join: equal teams, kickoffs at most four hours apart."""
    lo, hi = F.col("kickoff") - F.expr("INTERVAL 4 HOURS"), F.col("kickoff") + F.expr("INTERVAL 4 HOURS")
    m = matches.select("match_id", F.col("home_team_id").alias("_h"), F.col("away_team_id").alias("_a"), F.col("kickoff").alias("match_kickoff"))
    return feed.join(m, (F.col("home_team_id") == F.col("_h")) & (F.col("away_team_id") == F.col("_a"))
                     & F.col("match_kickoff").between(lo, hi)).drop("_h", "_a")


def new_prices(prices: DataFrame) -> DataFrame:
    """Insert-once price rows: the first of a key for ever, whenever a repeat comes."""
    return prices.dropDuplicates(["match_id", "source", "market", "selection"])


def latest_prices(prices: DataFrame) -> DataFrame:
    """Newest price per selection as prices arrive (update mode)."""
    return prices.withColumn("market", naming.price_market(F.col("market"))).groupBy("match_id", "market", "selection").agg(
        F.max_by("decimal_odds", F.struct("fetched_at", "odds_id")).alias("odds"))


def settled_coupons(finished: DataFrame, legs: DataFrame) -> DataFrame:
    """Coupons that close as results land (update mode, one row per transition).

    ``finished`` streams (match_id, ft_home, ft_away, finished_at); a result is used once, however late it comes.
    ``legs`` is the static table of open legs with each coupon's ``num_legs`` and ``combined_odds``.
    """
    once = finished.dropDuplicates(["match_id"])
    j = once.join(legs, "match_id").withColumn("hit", settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away")))
    g = j.groupBy("coupon_id", "num_legs", "combined_odds").agg(F.count("hit").alias("settled"), F.count_if("hit").alias("won"))
    return g.filter("settled = num_legs").selectExpr("coupon_id", "num_legs", "combined_odds", "won = num_legs AS hit")


def retained(events: DataFrame, clock: str = "kickoff") -> DataFrame:
    """The prune step of a trigger: events of the last two days and later, by processing time."""
    return events.filter(F.col(clock) >= F.current_timestamp() - F.expr(f"INTERVAL {KEEP}"))


def _rows_of(spark, path, like: DataFrame, but: str | None = None) -> DataFrame:
    """What is stored under a path, without the files of the folder ``but``; nothing where nothing is stored."""
    try:
        found = spark.read.schema(like.schema).parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return like.limit(0)
    return found.filter(~F.col("_metadata.file_path").contains(f"/{but}/")) if but else found


def query_id(spark) -> str:
    """The id of the running stream, which its checkpoint folder keeps over restarts; outside of a stream ``none``."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"


def append_once(path: str, key, run: str | None = None, order=()):
    """A foreachBatch sink that adds only keys not stored yet; a replayed batch adds nothing.

    Each batch of a run owns one folder, so a retry overwrites its own half-written rows only. The run is the stream's id
    unless named: a new checkpoint folder makes a new run, so batches numbered from 0 again never meet old folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        own = f"run={run or query_id(batch.sparkSession)}/batch={batch_id}"
        before = _rows_of(batch.sparkSession, f"{path}/run=*/batch=*", batch, but=own)
        sync.append_new(before.select(*batch.columns), batch, key, order).write.mode("overwrite").parquet(f"{path}/{own}")

    return write


def notify_once(path: str, run: str | None = None):
    """A foreachBatch sink of message rows for coupons that closed, one per coupon."""
    sink = append_once(path, ["coupon_id"], run)
    return lambda batch, batch_id: sink(compose.notifications(batch), batch_id)


def keyed_table(path: str, key: str, cols, buckets: int = 64):
    """A foreachBatch sink for a table of match rows: the batch is merged into the buckets of its keys, the others stay as they are.

    Merging is repeatable: rows never go back in status and final scores are written once, so a retried batch, or
    all batches again under a new checkpoint folder, leave the same table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket")
        new = batch.select(key, *cols)
        touched = [r["bucket"] for r in new.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        before = _rows_of(spark, path, new.select("*", bucket)).filter(F.col("bucket").isin(touched)).select(key, *cols)
        merged = stored(sync.upsert_matches(before, new, key, cols))  # the old files are read before they are replaced
        merged.select("*", bucket).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)

    return write


def finalise_each(path: str, key: str, cols, now, hours: int = 6, buckets: int = 64):
    """Timeout step of a trigger: matches stuck for ``hours`` are closed from their live score, in the table itself."""
    sink = keyed_table(path, key, cols, buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        state = batch.sparkSession.read.parquet(path).select(key, *cols)
        closed = sync.finalise_stuck(state, now, hours).select(key, *cols)
        sink(closed.join(state.select(key, F.col("status").alias("_was")), key).filter("status <> _was").drop("_was"), batch_id)

    return write
