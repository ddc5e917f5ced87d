"""Keyed stateful jobs: live matches with timers, coupon settlement from two streams, the daily snapshot.

State is one small row a match or coupon, kept by Spark and ended by event-time timers, so nothing stored is read again per
batch. A task folds the new rows of its keys; it holds one key's rows of one trigger at a time.
"""
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from touchline.functions import settle
from touchline.sources import feeds
from touchline.streaming import live

STUCK_HOURS, KEEP_HOURS = 6, 48   # a running match is closed from its live score; a match or coupon is forgotten
LATE = "1 hour"                   # how late a feed row may come
LIVE_COLUMNS = ["status", "kickoff", "live_minute", "live_home", "live_away", "ft_home", "ft_away"]
LIVE_OUT = "match_id long, status string, kickoff timestamp, live_minute int, live_home long, live_away long, ft_home long, ft_away long"
_LIVE_STATE = ("kickoff timestamp, closed boolean, forced boolean, run_at timestamp, run_id long, status string, minute int, live_home long, live_away long,"
               " fh long, fh_at timestamp, fh_id long, fa long, fa_at timestamp, fa_id long")
_LIVE_NAMES = [c.split()[0] for c in _LIVE_STATE.split(", ")]


def _ms(t: pd.Timestamp) -> int:
    return int(pd.Timestamp(t).value // 1_000_000)


def _wake(state: GroupState, at: int) -> None:
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def _fold_match(stuck: int, keep: int):
    """Newest running row, first final goals by event time, whatever order rows come in; a timer closes, a second one forgets."""
    def row_of(match_id, s):
        done = s["closed"] or s["forced"]
        status = "finished" if done else "paused" if s["status"] == "PAUSED" else "in_play"
        live_part = (None, None, None) if done else (s["minute"], s["live_home"], s["live_away"])
        final = (s["live_home"], s["live_away"]) if s["forced"] else (s["fh"], s["fa"])
        frame = pd.DataFrame([(match_id, status, s["kickoff"], *live_part, *final)], columns=["match_id", *LIVE_COLUMNS])
        return frame.astype({c: "Int64" for c in ("live_minute", "live_home", "live_away", "ft_home", "ft_away")})

    def newer(s, at, ident, prefix, first):
        old = (s[f"{prefix}_at"], s[f"{prefix}_id"])
        return old[0] is None or pd.isna(old[0]) or ((at, ident) < old if first else (at, ident) > old)

    def step(key, batches, state: GroupState):
        s = dict(zip(_LIVE_NAMES, state.get)) if state.exists else dict.fromkeys(_LIVE_NAMES) | {"closed": False, "forced": False}
        if state.hasTimedOut:
            forget = _ms(s["kickoff"]) + keep * 3_600_000 <= state.getCurrentWatermarkMs()
            if not (s["closed"] or s["forced"]) and s["live_home"] is not None and s["live_away"] is not None:
                s["forced"] = True  # stuck: the live score becomes final
                yield row_of(key[0], s)
            if forget:
                state.remove()
                return
        else:
            for pdf in batches:
                pdf = pdf.sort_values(["event_time", "event_id"])
                s["kickoff"] = pdf["match_kickoff"].iloc[0]
                over = pdf["status"] == "FINISHED"
                run = pdf[~over]
                if len(run) and newer(s, run["event_time"].iloc[-1], int(run["event_id"].iloc[-1]), "run", False):
                    r = run.iloc[-1]
                    s |= {"run_at": r["event_time"], "run_id": int(r["event_id"]), "status": r["status"], "minute": None if pd.isna(r["minute"]) else int(r["minute"]),
                          "live_home": 0 if pd.isna(r["home_goals"]) else int(r["home_goals"]), "live_away": 0 if pd.isna(r["away_goals"]) else int(r["away_goals"])}
                s["closed"] = bool(s["closed"] or over.any())
                for side, column in (("fh", "home_goals"), ("fa", "away_goals")):
                    known = pdf[over & pdf[column].notna()]
                    if len(known) and newer(s, known["event_time"].iloc[0], int(known["event_id"].iloc[0]), side, True):
                        s |= {side: int(known[column].iloc[0]), f"{side}_at": known["event_time"].iloc[0], f"{side}_id": int(known["event_id"].iloc[0])}
            yield row_of(key[0], s)
        state.update(tuple(s[c] for c in _LIVE_NAMES))
        _wake(state, _ms(s["kickoff"]) + (keep if s["closed"] or s["forced"] or state.getCurrentWatermarkMs() >= _ms(s["kickoff"]) + stuck * 3_600_000 else stuck) * 3_600_000)

    return step


def match_states(rows: DataFrame, stuck_hours: int = STUCK_HOURS, keep_hours: int = KEEP_HOURS) -> DataFrame:
    """Status and score per match (update mode) from (match_id, match_kickoff, event_time, event_id, status, minute, home_goals, away_goals).

    A match still running ``stuck_hours`` after its kickoff is finished from its live score; ``keep_hours`` after it its state
    ends. Both by the feed's own clock. A final score taken from the live one stays.
    """
    x = rows.filter("status IN ('IN_PLAY', 'PAUSED', 'FINISHED')").selectExpr(
        "match_id", "CAST(match_kickoff AS TIMESTAMP) AS match_kickoff", "event_time", "CAST(event_id AS BIGINT) AS event_id", "status",
        "CAST(minute AS INT) AS minute", "CAST(home_goals AS BIGINT) AS home_goals", "CAST(away_goals AS BIGINT) AS away_goals")
    return x.withWatermark("event_time", LATE).groupBy("match_id").applyInPandasWithState(
        _fold_match(stuck_hours, keep_hours), LIVE_OUT, _LIVE_STATE, "update", GroupStateTimeout.EventTimeTimeout)


def landed_live(spark, folder: str, files: int = 100) -> DataFrame:
    """The live feed as it lands: JSON lines {"event_id", "event_time", "doc": one match of the provider}, new files as they come."""
    lines = spark.readStream.schema("event_id long, event_time timestamp, doc string").option("maxFilesPerTrigger", files).json(folder)
    return feeds.second_fixture_rows(lines, "event_id", "event_time")


def live_rows(feed: DataFrame, names: DataFrame, matches: DataFrame) -> DataFrame:
    """Feed rows with their match: team names resolved by ``names`` (name, team_id), kickoffs at most four hours apart."""
    h, a = names.select(F.col("name").alias("home_name"), F.col("team_id").alias("home_team_id")), names.select(F.col("name").alias("away_name"), F.col("team_id").alias("away_team_id"))
    return live.feed_to_matches(feed.join(h, "home_name").join(a, "away_name"), matches)


def run_live(spark, folder: str, names: DataFrame, matches: DataFrame, table: str, checkpoint: str, files: int = 100, **hours):
    """Everything that has landed since the last run, into the table of matches (one trigger run; the caller may wait for it)."""
    states = match_states(live_rows(landed_live(spark, folder, files), names, matches), **hours)
    sink = live.keyed_table(table, "match_id", LIVE_COLUMNS)
    return states.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


CLOSED_OUT = "coupon_id long, num_legs int, combined_odds double, hit boolean"
_COUPON_STATE = "legs array<int>, won int, num_legs int, combined_odds double, closed boolean, last timestamp"


def _fold_coupon(keep: int):
    def step(key, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        legs, won, many, odds, closed, last = state.get if state.exists else ([], 0, None, None, False, None)
        seen = set(legs or [])
        for pdf in batches:
            for leg, hit in dict(zip(pdf["leg_no"].tolist(), pdf["hit"].tolist())).items():
                if leg not in seen:
                    seen.add(leg)
                    won += bool(hit)
            many, odds = int(pdf["num_legs"].iloc[0]), float(pdf["combined_odds"].iloc[0])
            last = max([pdf["finished_at"].max(), *([] if last is None else [last])])
        if len(seen) == many and not closed:
            closed = True
            yield pd.DataFrame([(key[0], many, odds, won == many)], columns=[c.split()[0] for c in CLOSED_OUT.split(", ")])
        state.update((sorted(seen), won, many, odds, closed, last))
        _wake(state, _ms(last) + keep * 3_600_000)

    return step


def closings(results: DataFrame, legs: DataFrame, span: str = "3 days", keep_hours: int = 24 * 14) -> DataFrame:
    """One row per coupon when its last leg is known (append mode).

    ``results`` streams (match_id, ft_home, ft_away, finished_at), ``legs`` the open legs as coupons are recorded (coupon_id, leg_no,
    match_id, market, selection, kickoff, num_legs, combined_odds), all timestamps. A result comes within ``span`` of the kickoff, which ends
    the state of both sides; a coupon's own ends ``keep_hours`` after its last leg, so results that are repeated in between close nothing again.
    """
    r = results.withWatermark("finished_at", LATE).select(F.col("match_id").alias("_m"), "ft_home", "ft_away", "finished_at")
    g = legs.withWatermark("kickoff", LATE)
    j = g.join(r, (F.col("match_id") == F.col("_m")) & (F.col("finished_at") >= F.col("kickoff")) & (F.col("finished_at") <= F.col("kickoff") + F.expr(f"INTERVAL {span}")))
    hit = settle.hit(F.col("market"), F.col("selection"), F.col("ft_home"), F.col("ft_away"))
    x = j.select("coupon_id", F.col("leg_no").cast("int").alias("leg_no"), F.col("num_legs").cast("int").alias("num_legs"), F.col("combined_odds").cast("double").alias("combined_odds"),
                 hit.alias("hit"), "finished_at").filter("hit IS NOT NULL")
    return x.groupBy("coupon_id").applyInPandasWithState(_fold_coupon(keep_hours), CLOSED_OUT, _COUPON_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def folder_sink(path: str, render=None):
    """A foreachBatch sink for rows that the stream's own state makes unique: each batch owns one folder under its query's id.

    A retried batch writes its folder again; a stream with a new checkpoint has a new id and never touches old folders.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        run = live.query_id(batch.sparkSession)
        (render(batch) if render else batch).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    return write


def daily_snapshot(days: DataFrame, compose, path: str, checkpoint: str):
    """Record each day's coupons once: ``days`` streams (day string), ``compose(day)`` gives that day's coupons with a ``day`` column.

    A day's folder and its marker are written last; a day whose marker is there is not composed again, whichever run or
    checkpoint asks for it, and a day that broke off before its marker is written anew.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        for day in sorted(r["day"] for r in batch.select("day").distinct().collect()):  # the days of one trigger
            mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}/_SUCCESS")
            if not mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark):
                compose(day).drop("day").write.mode("overwrite").parquet(f"{path}/day={day}")

    return days.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
