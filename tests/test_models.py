"""Fit, folds, calibration: recovery, optimality, strict past, exact pooling."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from touchline.operators import calibrate as cal
from touchline.operators import fit
from touchline.plans import backtest as bt


def league(n=12, games=40, seed=3):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 0.3, n), rng.normal(0, 0.2, n)
    a -= a.mean()
    b -= b.mean()
    rows = []
    for h in range(n):
        for w in range(n):
            if h != w:
                lam, mu = np.exp(a[h] + b[w] + 0.3 + 0.1), np.exp(a[w] + b[h] + 0.1)
                for g in range(games):
                    rows.append((h, w, int(rng.poisson(lam)), int(rng.poisson(mu))))
    return a, b, rows


def stats_of(rows):
    df = pd.DataFrame(rows, columns=["home_team_id", "away_team_id", "hg", "ag"]).assign(league="L")
    df = df.assign(w=1.0, wh=df.hg, wa=df.ag, w00=(df.hg == 0) & (df.ag == 0), w01=(df.hg == 0) & (df.ag == 1),
                   w10=(df.hg == 1) & (df.ag == 0), w11=(df.hg == 1) & (df.ag == 1))
    return df.groupby(["league", "home_team_id", "away_team_id"])[fit.STATS].sum().astype(float).reset_index()


def test_fit_recovers_strengths_and_is_stationary():
    a, b, rows = league()
    s = stats_of(rows)
    teams, leagues, theta, value, it, ix, st = fit.solve_pairs(s, 0.0)
    n = len(teams)
    att = theta[:n] - theta[:n].mean()
    assert np.abs(att - a).max() < 0.12 and it < 50
    g, _ = fit._gradient_hessian(theta, n, 1, ix, st, 0.0)
    assert np.abs(g).max() < 1e-2
    start = np.concatenate([np.zeros(2 * n), [0.25], [0.0], [-0.1]])
    assert value < fit.neg_log_likelihood(start, n, 1, ix, st, 0.0)


def test_gradient_and_hessian_match_differences():
    _, _, rows = league(5, 6)
    s = stats_of(rows)
    teams, _, theta, _, _, ix, st = fit.solve_pairs(s, 1.0)
    rng = np.random.default_rng(0)
    x = theta + rng.normal(0, 0.05, len(theta))
    g, h = fit._gradient_hessian(x, len(teams), 1, ix, st, 1.0)
    for k in range(len(x)):
        e = np.zeros(len(x))
        e[k] = 1e-5
        up, dn = (fit.neg_log_likelihood(x + d, len(teams), 1, ix, st, 1.0) for d in (e, -e))
        assert g[k] == pytest.approx((up - dn) / 2e-5, rel=1e-4, abs=1e-3)
        gu, gd = (fit._gradient_hessian(x + d, len(teams), 1, ix, st, 1.0)[0] for d in (e, -e))
        assert np.allclose(h[k], (gu - gd) / 2e-5, rtol=1e-3, atol=1e-2)


def test_pair_likelihood_equals_row_likelihood():
    _, _, rows = league(4, 10)
    s = stats_of(rows)
    teams, _, theta, value, _, ix, st = fit.solve_pairs(s, 0.0)
    n, total = len(teams), 0.0
    g, d, rho = theta[2 * n], theta[2 * n + 1], theta[-1]
    for h, w, x, y in rows:
        lam, mu = np.exp(theta[h] + theta[n + w] + g + d), np.exp(theta[w] + theta[n + h] + d)
        tau = {(0, 0): 1 - lam * mu * rho, (0, 1): 1 + lam * rho, (1, 0): 1 + mu * rho, (1, 1): 1 - rho}.get((x, y), 1.0)
        total -= x * np.log(lam) - lam + y * np.log(mu) - mu + np.log(tau)
    assert total == pytest.approx(value, rel=1e-10)


def test_fold_sums_equal_prefix_sums_with_kickoff_times(spark):
    """Times of day differ, so floored ages matter; half the rows belong to one pair."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        h, a = (1, 2) if i % 2 else (int(rng.integers(1, 5)), int(rng.integers(5, 8)))
        t = pd.Timestamp("2020-01-01") + pd.Timedelta(minutes=int(rng.integers(0, 60 * 24 * 30)) // 30 * 30)
        rows.append((i, "L", t.to_pydatetime(), h, a, int(rng.integers(0, 4)), int(rng.integers(0, 3))))
    m = spark.createDataFrame(rows, "match_id long, league string, kickoff timestamp_ntz, home_team_id long, away_team_id long, ft_home int, ft_away int")
    m = m.selectExpr("*", "'finished' AS status", "CAST(NULL AS DOUBLE) AS xg_home", "CAST(NULL AS DOUBLE) AS xg_away")
    num = bt.numbered(m, pooled=True, min_train=20, refit_every=30)
    got = {(r.fold, r.home_team_id, r.away_team_id): r for r in fit.fold_stats(num, 0.01).collect()}
    rows.sort(key=lambda r: (r[2], r[0]))
    seen = 0
    for f in range(4):
        i0 = 20 + 30 * f
        if i0 >= len(rows):
            break
        want = {}
        for r in rows[:i0]:
            w = np.exp(-0.01 * max(0, (rows[i0][2] - r[2]).days))
            k = (f, r[3], r[4])
            x, y = want.get(k, (0, 0))
            want[k] = (x + w, y + w * r[5])
        for k, (w, wh) in want.items():
            assert got[k].w == pytest.approx(w) and got[k].wh == pytest.approx(wh)
            seen += 1
    assert seen == len(got)


def test_isotonic_is_monotone_and_keeps_the_mean(spark):
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, 4000).round(3)
    rows = [("A", float(x), int(rng.uniform() < x ** 1.5)) for x in p] + [("B", 0.5, 1)] * 5
    df = spark.createDataFrame(rows, "market string, prob double, hit int")
    curve = cal.fit_isotonic(df)
    c = curve.filter("market = 'A'").orderBy("x").toPandas()
    assert (np.diff(c["y"]) >= -1e-12).all() and (c["n_train"] == 4000).all()
    out = cal.apply_curve(df.withColumn("raw", F.col("prob")), curve)
    mean = out.filter("market = 'A'").agg(F.avg("prob"), F.avg("hit")).first()
    assert mean[0] == pytest.approx(mean[1], abs=1e-9)
    assert out.filter("market = 'B'").first()["prob"] == 0.5  # five samples train nothing


def test_temperature_minimum(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, t in (("soft", 2.0), ("sharp", 0.7)):
        for _ in range(1500):
            q = rng.dirichlet([2, 1, 2])
            true = q ** (1 / t) / (q ** (1 / t)).sum()
            rows.append((g, [float(v) for v in q], int(rng.choice(3, p=true)) + 1))
    df = spark.createDataFrame(rows, "g string, p array<double>, y int")
    fitted = {r.g: r["T"] for r in cal.fit_temperature(df, ["g"]).collect()}
    for g in fitted:
        nll = lambda t: sum(-np.log((np.array(p) ** (1 / t) / (np.array(p) ** (1 / t)).sum())[y - 1]) for k, p, y in rows if k == g)
        best = nll(fitted[g])
        assert best <= min(nll(fitted[g] * f) for f in (0.98, 0.995, 1.005, 1.02)) + 1e-9
