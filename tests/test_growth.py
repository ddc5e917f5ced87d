"""What grows with the input: joins by match before expansion, clocks instead of pairs, documents parsed once."""
import datetime as dt
import re

import pytest
from conftest import SF
from pyspark.sql import functions as F

from touchline.operators import markets as mk
from touchline.operators import odds as od
from touchline.operators import resolve as rs
from touchline.plans import catalog
from touchline.plans import derive as D


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j3_probs_with_prices", "u7_candidates", "f13_open_picks", "f4_edges"])
def test_prices_are_joined_before_a_match_is_expanded(spark, name):
    p = physical(catalog.QUERIES[name](spark, SF))
    assert p.index("Expand") < re.search("Join", p).start()


def test_prices_of_a_match_keep_what_a_join_by_selection_gives(spark):
    rows = [(1, "1X2", "1", 2.0), (1, "1X2", "X", 4.0), (1, "1X2", "2", 4.0), (1, "btts", "yes", None), (1, "btts", "odd one", 3.0),
            (1, "btts", None, 2.0), (2, "1X2", "1", 1.5), (None, "1X2", "1", 9.0), (1, "unknown", "1", 5.0), (3, "double_chance", "1X", 1.2)]
    best = spark.createDataFrame(rows, "match_id long, market string, selection string, odds double")
    m = spark.createDataFrame([(1, 1.5, 1.0, -0.1), (1, 1.0, 1.0, 0.0), (4, 1.0, 1.0, 0.0), (None, 1.0, 1.0, 0.0), (3, 1.0, 1.0, 0.0)],
                              "match_id long, lam double, mu double, rho double")
    markets = ["1X2", "double_chance", "btts"]
    for how, many in (("inner", 2 * 4 + 1), ("left", 5 * 8)):
        got = od.priced(mk.long_book(od.with_prices(m, best, markets, how), markets), how).collect()
        assert len(got) == many
        seen = {(r.match_id, r.market, r.selection): (r.odds, r.overround) for r in got if how == "inner" or r.odds}
        assert seen[1, "1X2", "1"] == (2.0, 1.0) and seen[3, "double_chance", "1X"] == (1.2, 1.0) and None not in {k[0] for k in seen}
        if how == "inner":
            assert seen[1, "btts", "yes"][0] is None and seen[1, "btts", "yes"][1] == pytest.approx(1 / 3 + 1 / 2)
    lent = {r.match_id: r.prices for r in od.price_lists(best, markets, borrow=True).collect()}
    at = mk.book_columns(markets).index(("double_chance", "1X"))
    assert lent[1].margin[at] == pytest.approx(2 / 3) and lent[3].margin[at] == 1.0


def test_partitions_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(D, "ROWS_A_TASK", 100)
    assert D.matches(spark, SF).rdd.getNumPartitions() == -(-D.table(spark, SF, "orders").count() // 100)


def test_interval_join_meets_clocks_not_pairs(spark):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = spark.createDataFrame([(1, 7, t(0), 1), (1, 7, t(6), 0), (2, 7, t(0), 0), (3, 8, t(0), 0), (4, None, t(0), 0), (5, 7, t(4), 0)],
                                 "row_id long, team_id long, kickoff timestamp_ntz, how int")
    m = spark.createDataFrame([(50, 7, t(3)), (40, 7, t(3)), (30, 7, t(9)), (20, 7, t(13)), (10, None, t(0))], "match_id long, team_id long, kickoff timestamp_ntz")
    j = rs.interval_join(rows, m, ["team_id"], 4, strict=True, rank=["how"])
    assert {r.row_id: r.match_id for r in j.collect()} == {1: 30, 2: 40, 5: 40}
    assert re.search(r"Aggregate\(key\w*=\[team_id#\d+L?, match_kickoff#", physical(j))


def test_score_matrix_is_expanded_in_two_short_steps(spark):
    m = spark.createDataFrame([(1, 1.6, 1.1, -0.1)], "match_id long, lam double, mu double, rho double")
    c = mk.cells(m)
    assert physical(c).count("Generate ") == 2
    v = mk.with_goal_vectors(m).first()
    got = {(r.i, r.j): r.p for r in c.collect()}
    assert len(got) == 121 and all(p == v[f"h{i}"] * v[f"a{j}"] + (v[f"d{i}{j}"] if (i, j) in mk.LOW else 0.0) for (i, j), p in got.items())


def test_quick_rounding_is_round(spark):
    from touchline.plans.q_markets import p6
    xs = [0.0000005, 0.1234565, 0.12345649999999999, 0.9999995, -0.0000005, -0.1234565, -1e-9, 0.0, 1e-300, 999.9999995, 1234.5678905, 1e18, float("nan"), float("inf"), None]
    df = spark.createDataFrame([(x,) for x in xs], "p double").unionByName(spark.range(20_000).select((F.col("id") / F.lit(2e6) + F.rand(1) * 1e-12).alias("p")))
    assert df.select(p6("p").alias("a"), F.round("p", 6).alias("b"), "p").filter("NOT (a <=> b)").isEmpty()


def test_sharpened_sums_run_over_matches_and_count_repeated_ones(spark):
    m = spark.createDataFrame([(1, 1.6, 1.1, -0.1), (2, 1.0, 1.0, 0.0), (2, 2.0, 0.5, 0.0), (None, 1.0, 1.0, 0.0)], "match_id long, lam double, mu double, rho double")
    s = mk.sharpened_book(m, 1.8)
    p = physical(s)
    assert p.index("Expand") < p.index("Window")
    q = F.pow(F.greatest("prob", F.lit(1e-12)), F.lit(1 / 1.8))
    total = {(r.match_id, r.market): r.t for r in mk.long_book(m).groupBy("match_id", "market").agg(F.sum(q).alias("t")).collect()}
    want = sorted((str(r.match_id), r.market, r.selection, r.q / total[r.match_id, r.market]) for r in mk.long_book(m).withColumn("q", q).collect())
    got = sorted((str(r.match_id), r.market, r.selection, r.prob) for r in s.collect())
    assert len(got) == 4 * 38 and all(a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9) for a, b in zip(got, want))


def test_payload_bodies_are_parsed_once(spark):
    docs = ['{"1X2":{"1":0.5,"X":0.25},"ou":{"0.5":{"over":0.9}},"top":[{"1-0":0.1}],"bad":{"a":1.0,"b":null},"text":{"a":"x"},"n":3,"odd":{"a\\":{b":0.5}}', "{}", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(docs)), "match_id int, payload string")
    out = mk.payload_probs(df)
    assert {(r.match_id, r.market, r.selection, r.prob) for r in out.collect()} == {(0, "1X2", "1", 0.5), (0, "1X2", "X", 0.25), (0, "odd", 'a":{b', 0.5)}
    assert physical(out).count("from_json(MapType(StringType,DoubleType") == 1
