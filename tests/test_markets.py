"""Probability axioms of every market, over a grid of goal rates (one match per row)."""
import itertools

import pytest
from pyspark.sql import functions as F

from touchline.functions import value
from touchline.operators import markets as mk

GRID = [(1.6, 1.1), (0.3, 0.2), (2.8, 2.9), (1.1, 1.6), (4.0, 0.5)]


@pytest.fixture(scope="module")
def book(spark):
    rows = [(i, float(l), float(m), rho) for i, ((l, m), rho) in enumerate(itertools.product(GRID, (0.0, -0.1, 0.1)))]
    df = spark.createDataFrame(rows, "match_id long, lam double, mu double, rho double")
    return df, {r["match_id"]: r.asDict() for r in mk.wide_book(df).collect()}


def test_known_one_x_two(book):
    row = book[1][0]
    assert [round(row[f"1X2|{s}"], 6) for s in "1X2"] == [0.489573, 0.248911, 0.261516]


@pytest.mark.parametrize("market", sorted({m for m, _ in mk.book_columns()} - {"double_chance"}))
def test_sums_to_one(book, market):
    sels = [s for m, s in mk.book_columns() if m == market]
    for r in book[1].values():
        assert sum(r[f"{market}|{s}"] for s in sels) == pytest.approx(1.0, abs=1e-9)
        assert all(-1e-12 <= r[f"{market}|{s}"] <= 1 + 1e-12 for s in sels)


def test_double_chance_identity(book):
    for r in book[1].values():
        assert r["double_chance|1X"] == pytest.approx(r["1X2|1"] + r["1X2|X"])
        assert r["double_chance|12"] == pytest.approx(r["1X2|1"] + r["1X2|2"])
        assert r["double_chance|X2"] == pytest.approx(r["1X2|X"] + r["1X2|2"])


def test_over_falls_with_the_line(book):
    for r in book[1].values():
        overs = [r[f"over_under_{l}|over"] for l in mk.LINES]
        assert overs == sorted(overs, reverse=True)


def test_cells_agree_with_closed_forms(spark, book):
    c = mk.cells(book[0]).groupBy("match_id").agg(
        F.sum("p").alias("one"), F.sum(F.when(F.col("i") > F.col("j"), F.col("p"))).alias("hw"),
        F.sum(F.when((F.col("i") > 0) & (F.col("j") > 0), F.col("p"))).alias("bt"), F.min("p").alias("least"),
        F.sum(F.when((F.col("i") + F.col("j")) % 2 == 1, F.col("p"))).alias("odd")).collect()
    for x in c:
        r = book[1][x["match_id"]]
        assert x["one"] == pytest.approx(1.0) and x["least"] >= 0
        assert x["hw"] == pytest.approx(r["1X2|1"]) and x["bt"] == pytest.approx(r["btts|yes"]) and x["odd"] == pytest.approx(r["odd_even|odd"])


def test_handicap_identities(spark, book):
    d = mk.with_distributions(book[0])
    lines = d.select("match_id", *[mk.handicap_home_at("margin_pmf", f"{l}D").alias(n) for n, l in
                                   (("z", 0.0), ("q", -0.25), ("h", -0.5))], mk.over_at("total_pmf", "2.25D").alias("o225"),
                     mk.over_at("total_pmf", "2.0D").alias("o2"), mk.over_at("total_pmf", "2.5D").alias("o25")).collect()
    for x in lines:
        r = book[1][x["match_id"]]
        assert x["z"] == pytest.approx(r["1X2|1"] + r["1X2|X"] / 2)
        assert x["q"] == pytest.approx((x["z"] + x["h"]) / 2)
        assert x["o225"] == pytest.approx((x["o2"] + x["o25"]) / 2)
        assert x["o25"] == pytest.approx(r["over_under_2.5|over"])


def test_stronger_side_is_favoured(book):
    for r in book[1].values():
        if r["lam"] > r["mu"]:
            assert r["1X2|1"] > r["1X2|2"]


def test_value_points(spark):
    rows = [(0.5, 2.2), (0.5, 2.0), (0.4, 2.0), (0.6, 2.0), (0.5, 1.0)]
    df = spark.createDataFrame(rows, "p double, o double")
    p, o = F.col("p"), F.col("o")
    out = df.select(value.edge(p, o).alias("e"), value.kelly(p, o).alias("k"), value.kelly_stake(p, o, F.lit(1000.0), F.lit(0.25)).alias("s")).collect()
    assert [round(x["e"], 6) for x in out] == [0.1, 0.0, -0.2, 0.2, -0.5]
    assert [round(x["k"], 6) for x in out] == [0.083333, 0.0, 0.0, 0.2, 0.0]
    assert out[3]["s"] == 50.0
    tags = spark.createDataFrame([(0.75, 0.125), (0.40, 0.20), (0.55, 0.02), (0.75, 0.01)], "p double, e double")
    assert [x[0] for x in tags.select(value.tag(F.col("p"), F.col("e"))).collect()] == ["banko_value", "kombine_value", "no_value", "no_value"]
