"""Rolling calibration and pooled fits against plain sequential readings."""
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from touchline.operators import calibrate, fit, neighbours, rolling, timeline
from touchline.plans import backtest as bt
from touchline.plans import derive as D


def walk(positions, minimum, every):
    """One group's predictions in order: (serves, refit) of each."""
    out, last, fits = [], None, 0
    for n, at in enumerate(positions):
        now = n + 1 >= minimum and (last is None or at - last >= every)
        out.append((fits - 1 if fits else None, now))
        if now:
            last, fits = at, fits + 1
    return out


@pytest.mark.parametrize("block", [7, 50, 16_384])
def test_refits_equal_the_sequential_walk(spark, block):
    rng, rows, expect = random.Random(3), [], {}
    for g, (step, many) in enumerate([(1, 300), (4, 400), (40, 90), (1, 3), (13, 200)]):
        at, positions = rng.randrange(100), []
        for _ in range(many):
            at += rng.choice([1, 1, step, 2 * step])
            positions.append(at)
        rows += [(f"g{g}", n, p) for n, p in enumerate(positions)]
        expect |= {(f"g{g}", p): x for p, x in zip(positions, walk(positions, 20, 7))}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, n long, at long")
    out = {(r["g"], r["at"]): (r["serves"], r["refit"]) for r in rolling.refits(df, "g", "n", "at", 20, 7, block).collect()}
    assert out == expect


def test_training_rows_are_the_last_window(spark):
    positions = list(range(0, 900, 3))
    df = spark.createDataFrame([("g", n, p, f"r{n}") for n, p in enumerate(positions)], "g string, n long, at long, tag string")
    marked = rolling.refits(df, "g", "n", "at", 20, 30)
    fits = [n for n, (_, now) in enumerate(walk(positions, 20, 30)) if now]
    got = rolling.training_rows(marked, "g", "n", 64).groupBy("fit").agg(F.sort_array(F.collect_list("n")).alias("ns")).collect()
    assert {r["fit"]: r["ns"] for r in got} == {k: list(range(max(0, n - 63), n + 1)) for k, n in enumerate(fits)}


def test_calibrated_by_hand(spark):
    """A second, sequential reading of the back-test's calibrator on one league."""
    rng, rows = np.random.default_rng(5), []
    for n in range(260):
        p = rng.dirichlet([2, 1, 2])
        rows.append(("L", n, n, [("1X2", [float(x) for x in p], int(rng.choice(3, p=p ** 0.5 / (p ** 0.5).sum())) + 1)]))
    df = spark.createDataFrame(rows, "league string, seq long, idx long, books array<struct<market: string, p: array<double>, y: int>>")
    marked = rolling.refits(df, "league", "seq", "idx").persist()
    fits = rolling.temperatures(marked, "league", "seq")
    got = {r["seq"]: (r["T"], r["p"]) for r in rolling.calibrated(marked.select("league", "seq", "serves", F.inline("books")), fits, "league").collect()}
    newest = None
    for n in range(260):
        p = np.array(rows[n][3][0][1])
        if newest is None:
            assert got[n][0] is None and np.allclose(got[n][1], p)
        else:
            q = p ** (1 / newest)
            assert abs(got[n][0] - newest) < 1e-5 and np.allclose(got[n][1], q / q.sum(), atol=1e-6)
        if n + 1 >= 100 and (n - 99) % 50 == 0:
            logs = np.log([r[3][0][1] for r in rows[max(0, n - 499):n + 1]])
            y = np.array([r[3][0][2] for r in rows[max(0, n - 499):n + 1]]) - 1
            lo, hi = 1 / 20, 1 / 0.05
            for _ in range(60):  # the slope of the likelihood along 1/T rises
                b = (lo + hi) / 2
                w = np.exp(b * logs)
                slope = ((w * logs).sum(1) / w.sum(1) - logs[np.arange(len(y)), y]).sum()
                lo, hi = (b, hi) if slope < 0 else (lo, b)
            newest = 2 / (lo + hi)


def test_row_numbers_of_a_hot_second(spark, monkeypatch):
    df = spark.range(500).selectExpr("(id * 7919) % 500 AS k", "timestamp_ntz'2024-01-01 10:00:00' + make_dt_interval(0, 0, 0, id % 2) AS t", "IF(id % 3 = 0, 'a', 'b') AS g")
    want = {r["k"]: r["i"] for r in df.selectExpr("k", "row_number() OVER (PARTITION BY g ORDER BY t, k) - 1 AS i").collect()}
    for most in (1 << 20, 5):
        monkeypatch.setattr(timeline, "RANGE_ROWS", most)
        assert {r["k"]: r["idx"] for r in timeline.with_row_index(df, "t", "k", "g").collect()} == want


def pair_table(leagues, folds=(0,)):
    """Statistics of simulated matches."""
    rng, rows = np.random.default_rng(11), []
    for f in folds:
        for k in range(leagues):
            strength = rng.normal(0, 0.3, (6, 2))
            for h in range(6):
                for a in range(6):
                    if h != a and rng.random() < 0.9:
                        w = rng.uniform(0.2, 1, 12)
                        x, y = rng.poisson(np.exp(strength[h, 0] + strength[a, 1] + 0.3), 12), rng.poisson(np.exp(strength[a, 0] + strength[h, 1] + 0.1 * k), 12)
                        low = [w[(x == i) & (y == j)].sum() for i in (0, 1) for j in (0, 1)]
                        rows.append(("all", f, f"L{k}", 10 * k + h, 10 * k + a, w.sum(), (w * x).sum(), (w * y).sum(), *low))
    return pd.DataFrame(rows, columns=["grp", "fold", "league", "home_team_id", "away_team_id", *fit.STATS])


def test_pooled_fit_equals_the_joint_newton(spark):
    stats = pair_table(3, (0, 1, 2))
    got = fit.fit_pooled(spark.createDataFrame(stats)).toPandas().set_index(["fold", "team_id"])
    joint = fit.fit_folds(spark.createDataFrame(stats)).toPandas().set_index(["fold", "team_id"])
    assert len(got) == len(joint) == 54
    for c in ("attack", "defence", "gamma", "delta", "rho", "nll"):
        assert (got[c] - joint[c].reindex(got.index)).abs().max() < 2e-5, c
    assert (got.groupby("fold")["rho"].nunique() == 1).all()


def test_pooled_fit_at_the_bound_of_rho(spark):
    stats = pair_table(2)
    stats["w00"], stats["w11"], stats["w01"], stats["w10"] = 0.0, 0.0, stats["w"] * 0.4, stats["w"] * 0.4  # only scores that a large rho favours
    got = fit.fit_pooled(spark.createDataFrame(stats)).toPandas()
    assert got["rho"].nunique() == 1 and abs(got["rho"].iloc[0] - fit.RHO_BOUNDS[1]) < 1e-6


def test_fitted_parameters_are_flat(spark):
    stats = spark.createDataFrame(pair_table(3))
    g = fit.slopes(stats, fit.fit_pooled(stats)).toPandas()
    assert set(g.parameter) == {"attack", "defence", "gamma", "delta", "rho"} and (g.slope.abs() <= 1e-6 * g.weight.clip(lower=1)).all()


def test_report_follows_from_calibrated_rows(spark):
    rated = D.with_rates(bt.numbered(D.matches(spark, SF), pooled=False, min_train=40, refit_every=20).filter("fold >= 0"))
    cal, fits = bt.calibrate(rated, minimum=20, every=10, window=50)
    placed = bt.bets(cal, D.odds(spark, SF)).cache()
    rep = bt.report(cal, fits, placed).toPandas().set_index("league")
    assert rep.loc["overall", "n"] == rep.drop("overall")["n"].sum() == rated.count()
    assert rep.loc["overall", "bets"] == placed.count() > 0 and placed.filter("edge <= 0").isEmpty()
    assert (rep.drop("overall")["fits"] > 3).all()


def test_fits_from_changes_equal_fits_from_fold_tables(spark, monkeypatch):
    """Several parts of folds, several times of day; what is sent to the fits is far less than a pair table a fold."""
    monkeypatch.setattr(fit, "FOLDS", 16)
    rng, rows = np.random.default_rng(9), []
    for i in range(900):
        g = int(rng.integers(0, 2))
        h, a = rng.choice(5 if i < 300 else 9, 2, replace=False)
        t = pd.Timestamp("2020-01-01") + pd.Timedelta(hours=24 * (i // 4) + int(rng.choice([12, 18])))
        rows.append((i, f"L{g}", t.to_pydatetime(), int(10 * g + h), int(10 * g + a), int(rng.poisson(1.6)), int(rng.poisson(1.2))))
    m = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp_ntz, home_team_id long, away_team_id long, ft_home int, ft_away int")
    m = m.selectExpr("*", "'finished' AS status", "CAST(NULL AS DOUBLE) AS xg_home", "CAST(NULL AS DOUBLE) AS xg_away")
    for pooled, solve in ((False, fit.fit_folds), (True, fit.fit_pooled)):
        num = bt.numbered(m, pooled=pooled, min_train=60, refit_every=20).cache()
        tables, changes = fit.fold_stats(num, 0.004), fit.fold_changes(num, 0.004)
        assert 3 * changes.count() < 2 * tables.count()
        want, got = (solve(x).toPandas().set_index(["grp", "fold", "team_id"]) for x in (tables, changes))
        assert len(want) == len(got) and set(want.index) == set(got.index)
        for c in ("attack", "defence", "gamma", "delta", "rho"):
            assert (got[c] - want[c].reindex(got.index)).abs().max() < 1e-6, c


def test_temperatures_side_by_side_equal_the_aggregate(spark):
    rng, rows = np.random.default_rng(6), []
    for n in range(400):
        p, q = rng.dirichlet([2, 1, 2]), rng.dirichlet([3, 2])
        rows.append(("L", n, n, [("1X2", [float(x) for x in p], int(rng.integers(1, 4))), ("over_under_2.5", [float(x) for x in q], int(rng.choice(2, p=q)) + 1)]))
    df = spark.createDataFrame(rows, "league string, seq long, idx long, books array<struct<market: string, p: array<double>, y: int>>")
    marked = rolling.refits(df, "league", "seq", "idx", 40, 15).cache()
    long = rolling.training_rows(marked, "league", "seq", 120).select("league", "fit", F.inline("books"))
    want = {(r.market, r.fit): (r["T"], r.n) for r in calibrate.fit_temperature(long, ["league", "market", "fit"]).collect()}
    found = rolling.temperatures(marked, "league", "seq", 120)
    got = {(r.market, r.fit): (r["T"], r.n) for r in found.collect()}
    assert set(got) == set(want) and all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0], rel=1e-5) for k in want)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]  # no row is copied to every fit that reads it


def long_walk(spark, matches=1100):
    """Numbered rows of two leagues at two times of day; the second league and some teams begin late."""
    rng, rows = np.random.default_rng(21), []
    for i in range(matches):
        g = int(rng.integers(0, 2)) if i > matches // 3 else 0
        h, a = rng.choice(5 if i < matches // 2 else 7, 2, replace=False)
        t = pd.Timestamp("2020-01-01") + pd.Timedelta(hours=24 * (i // 5) + int(rng.choice([12, 18])))
        rows.append((i, f"L{g}", t.to_pydatetime(), int(10 * g + h), int(10 * g + a), int(rng.poisson(1.5)), int(rng.poisson(1.2))))
    m = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp_ntz, home_team_id long, away_team_id long, ft_home int, ft_away int")
    return m.selectExpr("*", "'finished' AS status", "CAST(NULL AS DOUBLE) AS xg_home", "CAST(NULL AS DOUBLE) AS xg_away")


def test_neighbouring_folds_reach_what_each_reaches_alone(spark, monkeypatch):
    num = bt.numbered(long_walk(spark), pooled=True, min_train=100, refit_every=20).cache()
    changes = fit.fold_changes(num, 0.004, 24).cache()
    want = fit.fit_folds(fit.fold_stats(num, 0.004)).toPandas().set_index(["fold", "team_id"])  # one dense Newton over all leagues
    found = fit.fit_pooled(changes)
    assert "FlatMapCoGroups" not in found._jdf.queryExecution().toString()
    parts = [pa.Table.from_pandas(x, preserve_index=False) for _, x in changes.toPandas().groupby("part")]
    assert len(parts) == 3

    def here():
        x = pd.concat([neighbours._part(2.0)((pa.scalar("all"), None), t).to_pandas() for t in parts]).explode("teams", ignore_index=True)
        return pd.concat([x.drop(columns="teams"), pd.DataFrame(x["teams"].to_list())], axis=1)

    ways = [found.toPandas(), here()]
    assert 2 * ways[1].groupby("fold").iterations.first().median() < 30
    monkeypatch.setattr(neighbours, "CELLS", 1)  # runs of one fold
    ways.append(here())
    monkeypatch.undo()
    monkeypatch.setattr(neighbours, "STEPS", 1)  # nothing is solved from its neighbour
    ways.append(here())
    for x in ways:
        got = x.set_index(["fold", "team_id"])
        assert len(got) == len(want) == len(set(got.index)) and set(got.index) == set(want.index)
        assert (got["league"] == want["league"].reindex(got.index)).all()
        for c in ("attack", "defence", "gamma", "delta", "rho", "nll"):
            assert (got[c] - want[c].reindex(got.index)).abs().max() < 2e-5, c


def test_neighbours_at_the_bound_of_rho(spark):
    num = bt.numbered(long_walk(spark, 400).withColumn("ft_away", F.expr("IF(ft_home > 0, 0, 1)")).withColumn("ft_home", F.expr("least(ft_home, 1)")), pooled=True, min_train=100, refit_every=20)
    changes = fit.fold_changes(num, 0.004).cache()
    want, got = (x.toPandas().set_index(["fold", "team_id"]) for x in (fit.fit_folds(changes), fit.fit_pooled(changes)))
    assert (want["rho"] > 0.49).any() and set(got.index) == set(want.index)
    for c in ("attack", "defence", "gamma", "delta", "rho"):
        assert (got[c] - want[c].reindex(got.index)).abs().max() < 2e-5, c


def test_slope_along_rho_is_that_of_the_optimum():
    """With the weight of many matches a fit stops a little off its optimum; the slope along rho must not show it, or rho never settles."""
    stats = pair_table(1)
    stats[fit.STATS] *= 1e5
    at = lambda theta: fit._league_block(2.0)(("all", 0, "L0"), stats, pd.DataFrame({"fold": [0], "theta": [theta], "rho": [-0.1], "lo": [-0.5], "hi": [0.5]})).iloc[0]
    best = at(at(None)["theta"])
    for seed in range(5):
        off = best["theta"] + np.append(np.random.default_rng(seed).uniform(-3e-9, 3e-9, len(best["theta"]) - 1), 0)
        got = at(off)
        assert (got["theta"] == off).all() and abs(got["slope"] - best["slope"]) < 0.01 * fit.RHO_STEP * best["curve"]


def test_rows_of_a_walk_are_not_dealt_out_by_their_group_alone(spark):
    """All rows of a pooled walk-forward are one group."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = bt.walk_forward(long_walk(spark, 300), pooled=True, min_train=100)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [grp#" in plan and not re.search(r"SortMergeJoin \[grp#\d+\],", plan)
