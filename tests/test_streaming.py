"""Every stream against its batch twin; sinks replay without a second row."""
import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from touchline.operators import odds as od
from touchline.operators import sync as sy
from touchline.plans import derive as D
from touchline.plans import q_coupons as qc
from touchline.streaming import live


def as_stream(spark, df, folder, parts=3, order=None):
    """Land a frame in a few files, oldest first, and read it as a stream one file at a time."""
    path = str(folder)
    rows = df.orderBy(order).collect() if order else df.collect()
    n = max(1, len(rows) // parts + 1)
    for i in range(0, len(rows), n):
        spark.createDataFrame(rows[i:i + n], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(stream, mode, name, tmp):
    q = (stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp / f"cp_{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def test_live_states(spark, tmp_path):
    feed = D.live_feed(spark, SF)  # all days: matches run across midnight
    want = {r.match_id: tuple(r) for r in sy.fold_live(feed).select("match_id", "status", "live_home", "live_away", "ft_home", "ft_away").collect()}
    s = as_stream(spark, feed.withColumn("event_time", F.col("event_time").cast("timestamp")), tmp_path / "feed", order="event_id")
    drain(live.live_states(s).withColumn("at", F.lit(1)), "complete", "live_states", tmp_path)
    got = {r.match_id: tuple(r) for r in spark.table("live_states").select("match_id", "status", "live_home", "live_away", "ft_home", "ft_away").collect()}
    assert got == want and len(want) > 5


def test_latest_prices(spark, tmp_path):
    o = D.odds(spark, SF).filter("match_id < 60")
    s = as_stream(spark, o, tmp_path / "odds")
    drain(live.latest_prices(s), "complete", "latest_prices", tmp_path)
    assert sorted(map(tuple, spark.table("latest_prices").collect())) == sorted(map(tuple, od.latest_prices(o).collect()))


def test_prices_are_inserted_once(spark, tmp_path):
    o = D.odds(spark, SF).filter("match_id < 40").withColumn("fetched_at", F.lit("2024-01-01 10:00:00").cast("timestamp"))
    s = as_stream(spark, o.unionByName(o), tmp_path / "odds")
    drain(live.new_prices(s), "append", "new_prices", tmp_path)
    assert spark.table("new_prices").count() == o.count()


def test_feed_rows_meet_matches(spark, tmp_path):
    m = D.matches(spark, SF)
    feed = m.filter("match_id < 50").selectExpr("match_id AS feed_id", "home_team_id", "away_team_id", "kickoff + INTERVAL 3 HOURS AS kickoff")
    s = as_stream(spark, feed, tmp_path / "f")
    drain(live.feed_to_matches(s, m), "append", "feed_matches", tmp_path)
    got = {(r.feed_id, r.match_id) for r in spark.table("feed_matches").collect()}
    assert {(i, i) for i in range(50)} <= got


def test_settlement_and_notifications(spark, tmp_path):
    legs = qc.legs(spark, SF).filter("coupon_id < 200")
    head = legs.groupBy("coupon_id").agg(F.count("*").alias("num_legs"), F.product(F.coalesce("odds", F.lit(1.0) / F.col("prob"))).alias("combined_odds"))
    static = legs.select("coupon_id", "match_id", "market", "selection").join(head, "coupon_id")
    done = D.matches(spark, SF).filter("ft_home IS NOT NULL AND match_id < 205").selectExpr(
        "match_id", "ft_home", "ft_away", "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(match_id AS INT)) AS finished_at")
    s = as_stream(spark, done.unionByName(done), tmp_path / "done", order="match_id")
    out = str(tmp_path / "messages")
    sink = live.notify_once(out)

    def twice(batch, batch_id):  # a retried batch must not add rows
        batch.persist()
        sink(batch, batch_id)
        sink(batch, batch_id)
        batch.unpersist()

    q = (live.settled_coupons(s, static).writeStream.outputMode("update").foreachBatch(twice)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.read.parquet(out + "/run=*/batch=*").select("coupon_id", F.col("title").startswith("✅").alias("hit"))
    want = qc.coupons(spark, SF).filter("hit IS NOT NULL AND coupon_id < 200").select("coupon_id", "hit")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_match_across_midnight_is_one_row(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 23, 30)
    rows = [(1, t, 1, "IN_PLAY", "20", 1, 0, t), (1, t + dt.timedelta(minutes=25), 2, "FINISHED", None, None, 1, t), (1, t + dt.timedelta(minutes=45), 3, "IN_PLAY", "90", 2, 1, t),
            (1, t + dt.timedelta(hours=2), 4, "FINISHED", None, 2, 1, t), (2, t, 5, "PAUSED", "45", 0, 0, t)]
    feed = spark.createDataFrame(rows, "match_id long, event_time timestamp, event_id long, status string, minute string, home_goals long, away_goals long, kickoff timestamp")
    want = {r.match_id: tuple(r) for r in sy.fold_live(feed).select("match_id", "status", "ft_home", "ft_away").collect()}
    assert want == {1: (1, "finished", 2, 1), 2: (2, "paused", None, None)}
    s = as_stream(spark, feed, tmp_path / "feed", parts=4, order="event_id")
    drain(live.live_states(s, "kickoff"), "complete", "midnight", tmp_path)
    assert {r.match_id: tuple(r) for r in spark.table("midnight").select("match_id", "status", "ft_home", "ft_away").collect()} == want


def test_stored_keys_survive_a_new_checkpoint_folder(spark, tmp_path):
    out = str(tmp_path / "once")
    rows = lambda *k: spark.createDataFrame([(x, i) for i, x in enumerate(k)], "key long, at long")
    live.append_once(out, ["key"], order=["at"])(rows(1, 2, 2), 0)
    live.append_once(out, ["key"], run="second", order=["at"])(rows(3, 9, 2), 0)
    live.append_once(out, ["key"], run="second", order=["at"])(rows(3, 9, 2), 0)
    got = spark.read.parquet(out + "/run=*/batch=*")
    assert sorted(r.key for r in got.collect()) == [1, 2, 3, 9]


def test_keyed_state_and_timeout(spark, tmp_path):
    cols = ["status", "kickoff", "live_minute", "live_home", "live_away", "ft_home", "ft_away"]
    t = dt.datetime(2024, 1, 1)
    schema = "match_id long, status string, kickoff timestamp_ntz, live_minute int, live_home int, live_away int, ft_home int, ft_away int"
    path = str(tmp_path / "state")
    write = live.keyed_table(path, "match_id", cols, buckets=4)
    first = spark.createDataFrame([(1, "in_play", t, 80, 1, 0, None, None), (2, "paused", t, 45, None, None, None, None)], schema)
    write(first, 0)
    for _ in range(2):
        write(spark.createDataFrame([(3, "in_play", t + dt.timedelta(hours=5), 10, 0, 0, None, None)], schema), 1)
    live.finalise_each(path, "match_id", cols, D.now("2024-01-01 07:00:00"), buckets=4)(spark.range(0), 1)
    write(first, 0)  # the same rows again, as under a new checkpoint folder: nothing goes back
    got = {r.match_id: (r.status, r.ft_home, r.live_home) for r in spark.read.parquet(path).collect()}
    assert got == {1: ("finished", 1, None), 2: ("paused", None, None), 3: ("in_play", None, 0)}
