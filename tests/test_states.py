"""Keyed streams with timers: every order of rows equals the batch twin, state ends, replays add nothing."""
import datetime as dt
import itertools
import json
import os

import pytest
from pyspark.sql import functions as F

from touchline.operators import sync as sy
from touchline.streaming import live, states

T = dt.datetime(2024, 1, 1, 22, 30)
HOUR = dt.timedelta(hours=1)


def doc(kick, home, away, status, minute=None, goals=(None, None)):
    return json.dumps({"utcDate": kick.strftime("%Y-%m-%dT%H:%M:%SZ"), "status": status, "minute": minute, "season": {"startDate": "2023-08-01"}, "homeTeam": {"name": home},
                       "awayTeam": {"name": away}, "score": {"fullTime": {"home": goals[0], "away": goals[1]}}})


def land(folder, rows, start=0):
    """One file a row, in the given order."""
    os.makedirs(folder, exist_ok=True)
    for i, (ident, at, text) in enumerate(rows):
        name = f"{folder}/{start + i:04d}.json"
        with open(name, "w") as f:
            f.write(json.dumps({"event_id": ident, "event_time": at.strftime("%Y-%m-%dT%H:%M:%SZ"), "doc": text}) + "\n")
        os.utime(name, (start + i, start + i))  # read in this order


MATCHES = [(1, 10, 20, T), (2, 30, 40, T), (3, 50, 60, T)]
NAMES = [("A", 10), ("B", 20), ("Bee", 20), ("C", 30), ("D", 40), ("E", 50), ("F", 60)]
FEED = [  # match 1 runs over midnight to its end, match 2 gets stuck, match 3 only has a final row without and one with goals
    (1, T + HOUR / 4, doc(T + 2 * HOUR, "A", "B", "IN_PLAY", "15", (1, 0))),
    (2, T + HOUR, doc(T, "A", "Bee", "PAUSED", "45+2", (1, 1))),
    (3, T + 2 * HOUR, doc(T, "A", "B", "FINISHED", None, (2, 1))),
    (4, T + 2 * HOUR + HOUR / 4, doc(T, "A", "B", "IN_PLAY", "90", (9, 9))),
    (5, T + HOUR, doc(T, "C", "D", "IN_PLAY", "50", (0, None))),
    (6, T + HOUR + HOUR / 3, doc(T, "C", "D", "IN_PLAY", "70", (3, None))),
    (7, T + 2 * HOUR, doc(T, "E", "F", "FINISHED")),
    (8, T + 2 * HOUR + HOUR / 10, doc(T, "E", "F", "FINISHED", None, (0, 2))),
    (9, T + HOUR, doc(T, "E", "nobody", "IN_PLAY", "3", (0, 0))),
]


def tables(spark):
    matches = spark.createDataFrame(MATCHES, "match_id long, home_team_id long, away_team_id long, kickoff timestamp")
    return spark.createDataFrame(NAMES, "name string, team_id long"), matches.withColumn("kickoff", F.col("kickoff").cast("timestamp_ntz"))


def stored_rows(spark, path):
    return {r.match_id: (r.status, r.live_minute, r.live_home, r.live_away, r.ft_home, r.ft_away) for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("order", [0, 1])
def test_landed_feed_to_stored_state(spark, tmp_path, order):
    names, matches = tables(spark)
    rows = [FEED, FEED[::-1]][order]
    folder, out, cp = (str(tmp_path / x) for x in ("feed", "table", "cp"))
    land(folder, rows)
    states.run_live(spark, folder, names, matches, out, cp, files=3).awaitTermination()
    twin = {1: ("finished", None, None, None, 2, 1), 2: ("in_play", 70, 3, 0, None, None), 3: ("finished", None, None, None, 0, 2)}
    feed = spark.createDataFrame([(m, t, i, s, n, h, a) for m, t, i, s, n, h, a in [
        (1, T + HOUR / 4, 1, "IN_PLAY", "15", 1, 0), (1, T + HOUR, 2, "PAUSED", "45+2", 1, 1), (1, T + 2 * HOUR, 3, "FINISHED", None, 2, 1), (1, T + 2 * HOUR + HOUR / 4, 4, "IN_PLAY", "90", 9, 9),
        (2, T + HOUR, 5, "IN_PLAY", "50", 0, None), (2, T + HOUR + HOUR / 3, 6, "IN_PLAY", "70", 3, None), (3, T + 2 * HOUR, 7, "FINISHED", None, None, None), (3, T + 2 * HOUR + HOUR / 10, 8, "FINISHED", None, 0, 2)]],
        "match_id long, event_time timestamp, event_id long, status string, minute string, home_goals long, away_goals long")
    folded = sy.fold_live(feed)
    assert {r.match_id: tuple(r)[1:] for r in folded.select("match_id", "status", "live_minute", "live_home", "live_away", "ft_home", "ft_away").collect()} == twin
    assert stored_rows(spark, out) == twin
    # the clock passes six hours: match 2 is closed from its live score, as the batch step does it
    land(folder, [(20, T + 9 * HOUR, doc(T + 9 * HOUR, "X", "Y", "TIMED"))] + [(21 + k, T + (9 + k) * HOUR, doc(T, "A", "B", "FINISHED", None, (7, 7))) for k in range(2)], 100)
    states.run_live(spark, folder, names, matches, out, cp, files=1).awaitTermination()
    late = sy.finalise_stuck(folded.join(matches.select("match_id", "kickoff"), "match_id"), F.lit(T + 9 * HOUR).cast("timestamp_ntz"))
    assert stored_rows(spark, out) == {r.match_id: (r.status, r.live_minute, r.live_home, r.live_away, r.ft_home, r.ft_away) for r in late.collect()}
    # two days later the state is empty; a new checkpoint folder replays everything into the same table
    land(folder, [(40 + k, T + (72 + k) * HOUR, doc(T, "A", "B", "FINISHED", None, (8, 8))) for k in range(2)], 200)
    q = states.run_live(spark, folder, names, matches, out, cp, files=1)
    q.awaitTermination()
    before = stored_rows(spark, out)
    assert before[1] == ("finished", None, None, None, 2, 1) and before[2][0] == "finished"
    left = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert left[-1] <= 1  # only the match whose rows came in the last trigger
    states.run_live(spark, folder, names, matches, out, str(tmp_path / "cp2"), files=100).awaitTermination()
    assert stored_rows(spark, out) == before


def test_coupons_close_once(spark, tmp_path):
    legs = [(c, k, 100 + (c + k) % 5, "1X2", "1" if (c + k) % 2 else "X", T, 2 + c % 2, 3.5) for c in range(12) for k in range(2 + c % 2)]
    results = [(100 + m, *[(1, 0), (0, 0)][m % 2], T + 2 * HOUR + m * HOUR / 10) for m in range(4)]  # match 104 is missing
    leg_schema = "coupon_id long, leg_no int, match_id long, market string, selection string, kickoff timestamp, num_legs int, combined_odds double"
    result_schema = "match_id long, ft_home int, ft_away int, finished_at timestamp"
    gp, rp, out, cp = (str(tmp_path / x) for x in ("legs", "results", "out", "cp"))
    spark.createDataFrame(legs, leg_schema).write.parquet(gp)
    for part in (results[:2], results[2:], results):  # the last one repeats them all
        spark.createDataFrame(part, result_schema).coalesce(1).write.mode("append").parquet(rp)

    def run(checkpoint):
        g = spark.readStream.schema(leg_schema).parquet(gp)
        r = spark.readStream.schema(result_schema).option("maxFilesPerTrigger", 1).parquet(rp)
        q = states.closings(r, g).writeStream.foreachBatch(states.folder_sink(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    run(cp)
    score = {m: (h, a) for m, h, a, _ in results}
    want = {}
    for c, some in itertools.groupby(legs, key=lambda x: x[0]):
        some = list(some)
        if all(x[2] in score for x in some):
            want[c] = all((score[x[2]][0] > score[x[2]][1]) == (x[4] == "1") for x in some)
    got = [(r.coupon_id, r.hit) for r in spark.read.parquet(out).collect()]
    assert dict(got) == want and len(got) == len(want) > 3
    assert 0 < sum(want.values()) < len(want)
    run(cp)  # nothing new has come
    assert spark.read.parquet(out).count() == len(want)
    # results and legs of weeks later push the clock on: the state ends
    later = T + dt.timedelta(days=40)
    for k in range(3):
        spark.createDataFrame([(900 + k, 1, 0, later + k * HOUR)], result_schema).coalesce(1).write.mode("append").parquet(rp)
        spark.createDataFrame([(900 + k, 0, 900 + k, "1X2", "1", later + k * HOUR, 2, 2.0)], leg_schema).coalesce(1).write.mode("append").parquet(gp)
        q = run(cp)
    total = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress if p["stateOperators"]]
    assert total[-1] <= 9 and spark.read.parquet(out).count() == len(want)


def test_snapshot_of_a_day_is_taken_once(spark, tmp_path):
    source, out = str(tmp_path / "days"), str(tmp_path / "coupons")
    made = []

    def compose(day):
        made.append(day)
        return spark.createDataFrame([(day, n, f"{day}-{n}") for n in range(3)], "day string, coupon_no int, signature string")

    def run(cp):
        days = spark.readStream.schema("day string").option("maxFilesPerTrigger", 1).json(source)
        states.daily_snapshot(days, compose, out, str(tmp_path / cp)).awaitTermination()

    os.makedirs(source)
    for i, day in enumerate(["2024-01-01", "2024-01-02", "2024-01-01"]):
        with open(f"{source}/{i}.json", "w") as f:
            f.write(json.dumps({"day": day}))
    run("a")
    os.remove(f"{out}/day=2024-01-02/_SUCCESS")  # this day broke off
    run("b")
    assert sorted(made) == ["2024-01-01", "2024-01-02", "2024-01-02"] and made[-1] == "2024-01-02"
    got = spark.read.parquet(out)
    assert got.count() == 6 and got.select("day", "signature").distinct().count() == 6


def test_append_once_under_a_new_checkpoint(spark, tmp_path):
    source, out = str(tmp_path / "rows"), str(tmp_path / "once")
    schema = "key long, at long"

    def run(cp):
        q = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(live.append_once(out, ["key"], order=["at"])).option("checkpointLocation", str(tmp_path / cp)) \
            .trigger(availableNow=True).start()
        q.awaitTermination()

    spark.createDataFrame([(1, 1), (2, 1), (2, 2)], schema).write.parquet(source)
    run("a")
    spark.createDataFrame([(3, 1), (1, 5)], schema).write.mode("append").parquet(source)
    run("b")  # numbers its batches from 0 again
    run("a")
    assert sorted(r.key for r in spark.read.parquet(out).collect()) == [1, 2, 3]
