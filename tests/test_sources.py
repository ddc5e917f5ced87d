"""Landed files, keyed sinks and stored curves on real folders."""
import datetime as dt

from pyspark.sql import functions as F

from touchline.operators import calibrate as cal
from touchline.operators import sync as sy
from touchline.sources import landed


def put(path, text, enc="latin-1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode(enc))


def test_season_files_with_different_headers(spark, tmp_path):
    put(tmp_path / "2324" / "E0.csv", "Div,Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,HTHG,HTAG,PSH,PSD,PSA\r\n"
        "E0,12/08/2023,15:00,Burnley,Man City,0,3,0,2,8.0,5.5,1.33\r\nE0,13/08/23,,Brentford,Tottenham,2,2,,,2.7,,2.6\r\n"
        "E0,xx,15:00,A,B,1,1,,,,,\r\nE0,14/08/2023,20:00,,Wolves,1,0,,,,,\r\nE0,14/08/2023,20:00,C,D,1,0,0,0,1,2,3,4,5,6\r\nE0,15/08/2023,20:00,C,D,,,,,,,\r\n")
    put(tmp_path / "2223" / "T1.csv", "Date,HomeTeam,AwayTeam,FTAG,FTHG\n05/08/2022,K\xf6ln,Be\xe7ikta\xe7,1,4\n")
    put(tmp_path / "2223" / "X.csv", "Date,HomeTeam,AwayTeam\n05/08/2022,a,b\n")
    r = landed.season_results(landed.read_lines(spark, [str(tmp_path / "*" / "*.csv")]))
    rows = {(x.league, x.home_team): x for x in r.collect()}
    assert set(rows) == {("E0", "Burnley"), ("E0", "Brentford"), ("T1", "Köln")}
    b = rows[("E0", "Burnley")]
    assert (b.season, b.kickoff, b.ft_home, b.ft_away, b.ht_away) == ("2324", dt.datetime(2023, 8, 12, 15, 0), 0, 3, 2)
    assert [p.decimal_odds for p in b.prices] == [8.0, 5.5, 1.33]
    assert rows[("E0", "Brentford")].prices == [] and rows[("E0", "Brentford")].ht_home is None
    t = rows[("T1", "Köln")]
    assert (t.ft_home, t.ft_away, t.kickoff) == (4, 1, dt.datetime(2022, 8, 5))
    assert landed.price_rows(r).count() == 3
    totals = {x.league: x.matches for x in landed.league_totals(r, skip=["T1"]).collect()}
    assert totals == {"E0": 2}


def test_fixture_files_inside_a_wrapper(spark, tmp_path):
    put(tmp_path / "fixtures.csv", "Title: x\n\nMarkdown Content:\nDiv,Date,Time,HomeTeam,AwayTeam\nE0,01/08/2025,20:00,A,B\n,,,,\nQQ,01/08/2025,20:00,A,B\nD1,31/07/2025,,C,D\n")
    f = {x.league: x for x in landed.main_fixtures(landed.read_lines(spark, str(tmp_path / "fixtures.csv"))).collect()}
    assert {k: v.season for k, v in f.items()} == {"E0": "2526", "D1": "2425"}
    put(tmp_path / "new.csv", "Country,Season,Date,Time,Home,Away\nAUSTRIA,2024/2025,2025-03-01,18:00,A,B\nsweden,,02/04/2025,,C,D\nNowhere,,02/04/2025,,C,D\n")
    g = {x.league: x for x in landed.new_fixtures(landed.read_lines(spark, str(tmp_path / "new.csv"))).collect()}
    assert {k: v.season for k, v in g.items()} == {"AUT": "2024/2025", "SWE": "2025"}


def test_prediction_sink_replay(spark, tmp_path):
    path = str(tmp_path / "predictions")
    make = lambda ids, v: spark.createDataFrame([(i, k, v) for i in ids for k in range(2)], "match_id long, k int, v string")
    sy.write_predictions(make(range(50), "a"), path, 8)
    for _ in range(2):
        sy.write_predictions(make(range(40, 60), "b"), path, 8)
    got = spark.read.parquet(path).groupBy("v").agg(F.count("*"), F.count_distinct("match_id")).collect()
    assert {r.v: (r[1], r[2]) for r in got} == {"a": (80, 40), "b": (40, 20)}


def test_curve_store_and_missing_curve(spark, tmp_path):
    probs = spark.createDataFrame([("A", 0.3), ("A", 0.7)], "market string, prob double")
    missing = sy.load_curve(spark, str(tmp_path / "none"))
    assert sorted(r.prob for r in cal.apply_curve(probs, missing).collect()) == [0.3, 0.7]
    sy.save_curve(spark.createDataFrame([("A", 0.2, 0.1, 40), ("A", 0.6, 0.5, 40)], "market string, x double, y double, n_train long"), str(tmp_path / "c"))
    out = sorted(r.prob for r in cal.apply_curve(probs, sy.load_curve(spark, str(tmp_path / "c"))).collect())
    assert [round(x, 9) for x in out] == [0.2, 0.5]


def test_lines_of_one_file_are_not_dealt_by_file(spark):
    """The header reaches every task, and so do the league names; only the count at the end may shuffle by a key of theirs."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = [("f.csv", "Div,Date,Time,HomeTeam,AwayTeam")] + [("f.csv", f"{c},01/02/2024,20:00,A{i},B{i}") for i, c in enumerate(["E0", "D1", "ZZ"] * 3)]
        got = landed.main_fixtures(spark.createDataFrame(lines, "file string, line string"))
        assert {(r.league, r.home_team) for r in got.collect()} == {("E0", "A0"), ("D1", "A1"), ("E0", "A3"), ("D1", "A4"), ("E0", "A6"), ("D1", "A7")}
        assert "SortMergeJoin" not in got._jdf.queryExecution().toString() and "ShuffledHashJoin" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
