"""Dixon-Coles fits for many folds at once.

Inside one (league, home, away) pair the goal rates are constant, so the weighted likelihood
depends on seven sums only: weight, weighted goals of each side and the weight of the four low
scores. One aggregate shrinks any number of matches to at most teams squared rows; the solver
sees nothing else. Time decay factors as exp(-xi T) exp(xi t), so one pass of running sums over
the folds gives every fold its training set without copying prefixes.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.session import stored

STATS = ["w", "wh", "wa", "w00", "w01", "w10", "w11"]
BASE_DAY = 10957  # 2000-01-01, keeps exp(xi t) near one
# Start, bounds and stopping rule of the fit.
START_GAMMA, START_RHO = 0.25, -0.1
GAMMA_BOUNDS, DELTA_BOUNDS, RHO_BOUNDS = (-1.0, 1.5), (-2.0, 2.0), (-0.5, 0.5)
MAX_ITER, TOLERANCE = 500, 1e-8

PARAM_SCHEMA = ("fold long, league string, team_id long, attack double, defence double, gamma double, delta double,"
                " rho double, nll double, iterations int")


def training_frame(matches: DataFrame, xg_mode: str = "both") -> DataFrame:
    """Finished matches with their goal signal.

    ``both``: xG only when both sides have it; ``side``: each side falls back alone; ``off``: goals.
    """
    m = matches.filter("status = 'finished' AND ft_home IS NOT NULL AND ft_away IS NOT NULL")
    has = "xg_home IS NOT NULL AND xg_away IS NOT NULL"
    h, a = {
        "both": (f"IF({has}, xg_home, CAST(ft_home AS DOUBLE))", f"IF({has}, xg_away, CAST(ft_away AS DOUBLE))"),
        "side": ("coalesce(xg_home, CAST(ft_home AS DOUBLE))", "coalesce(xg_away, CAST(ft_away AS DOUBLE))"),
        "off": ("CAST(ft_home AS DOUBLE)", "CAST(ft_away AS DOUBLE)"),
    }[xg_mode]
    return m.selectExpr("match_id", "league", "kickoff", "home_team_id", "away_team_id", "ft_home", "ft_away",
                        f"{h} AS hg", f"{a} AS ag")


def _sums(weight: str):
    """Aggregates of the seven statistics; low scores count only for whole goals 0/1."""
    cell = lambda i, j: f"sum(IF(hg = {i} AND ag = {j}, {weight}, 0D)) AS w{i}{j}"
    return [F.expr(x) for x in (f"sum({weight}) AS w", f"sum({weight} * hg) AS wh", f"sum({weight} * ag) AS wa",
                                cell(0, 0), cell(0, 1), cell(1, 0), cell(1, 1))]


def pair_stats(train: DataFrame, xi: float, asof: str, group: str | None = None) -> DataFrame:
    """Statistics of one fit per ``group`` at the time text ``asof`` (days floored, never negative)."""
    days = f"greatest(0, floor((unix_micros(TIMESTAMP '{asof}') - unix_micros(CAST(kickoff AS TIMESTAMP))) / 86400000000D))"
    keys = [F.col(group).alias("grp") if group else F.lit("all").alias("grp"), F.lit(0).cast("long").alias("fold")]
    return train.select(*keys, "league", "home_team_id", "away_team_id", "hg", "ag", F.expr(f"exp({-xi}D * {days})").alias("wt")) \
        .groupBy("grp", "fold", "league", "home_team_id", "away_team_id").agg(*_sums("wt"))


def _starts(rows: DataFrame) -> DataFrame:
    """Each fold's clock: the kickoff of its first row."""
    return rows.filter("fold >= 0").groupBy("grp", "fold").agg(F.min_by("kickoff", "idx").alias("t")).selectExpr(
        "grp", "fold", f"unix_date(CAST(t AS DATE)) - {BASE_DAY} AS day_t", "hour(t) * 60 + minute(t) AS tod_t")


def _increments(rows: DataFrame, xi: float, pair) -> DataFrame:
    """Undecayed statistics of the rows that a fold adds to the one before it."""
    return rows.selectExpr(
        "grp", "league", "home_team_id", "away_team_id", "hg", "ag", "hour(kickoff) * 60 + minute(kickoff) AS tod",
        "fold + 1 AS fold", f"exp({xi}D * (unix_date(CAST(kickoff AS DATE)) - {BASE_DAY})) AS wt",
    ).groupBy(*pair, "fold").agg(*_sums("wt"))


def fold_stats(rows: DataFrame, xi: float) -> DataFrame:
    """Statistics of every fold (grp, fold): decayed sums over all rows of earlier folds.

    ``rows`` carry grp, idx, fold (-1 for rows that only train), kickoff, teams, hg, ag. The
    fold's clock is the kickoff of its first row. Ages are whole days; a row later in the day
    than that clock counts one day less, so sums are kept per time of day.
    """
    starts = _starts(rows)
    last = starts.groupBy("grp").agg(F.max("fold").alias("last_fold"))
    pair = ["grp", "league", "home_team_id", "away_team_id", "tod"]
    inc = _increments(rows, xi, pair)
    first = inc.groupBy(*pair).agg(F.min("fold").alias("first_fold")).join(last, "grp").filter("first_fold <= last_fold")
    grid = first.selectExpr(*pair, "explode(sequence(first_fold, last_fold)) AS fold", *[f"0D AS {s}" for s in STATS])
    dense = inc.unionByName(grid).repartition(*pair).groupBy(*pair, "fold").agg(*[F.sum(s).alias(s) for s in STATS])
    run = f"OVER (PARTITION BY {', '.join(pair)} ORDER BY fold)"
    cum = dense.selectExpr(*pair, "fold", *[f"sum({s}) {run} AS {s}" for s in STATS])
    scale = f"exp({-xi}D * day_t) * IF(tod > tod_t, exp({xi}D), 1D)"
    return cum.join(starts, ["grp", "fold"]).groupBy("grp", "fold", "league", "home_team_id", "away_team_id").agg(
        *[F.expr(f"sum({s} * {scale}) AS {s}") for s in STATS])


def _terms(theta, n, nl, ix):
    """Log rates, rates, rho and the low-score factors; ``theta`` holds one fit a row."""
    h, a, l = ix
    g, d, rho = theta[:, 2 * n:2 * n + nl], theta[:, 2 * n + nl:2 * n + 2 * nl], theta[:, -1:]
    x = theta[:, h] + theta[:, n + a] + g[:, l] + d[:, l]
    y = theta[:, a] + theta[:, n + h] + d[:, l]
    lam, mu = np.exp(x), np.exp(y)
    t00, t01 = np.maximum(1 - lam * mu * rho, 1e-10), np.maximum(1 + lam * rho, 1e-10)
    t10, t11 = np.maximum(1 + mu * rho, 1e-10), np.maximum(1 - rho, 1e-10)
    return x, y, lam, mu, rho, t00, t01, t10, t11


def neg_log_likelihood(theta, n, nl, ix, s, l2):
    """Objective without the constant log factorials, of one fit or of one a row."""
    rows = np.atleast_2d(theta)
    x, y, lam, mu, _, t00, t01, t10, t11 = _terms(rows, n, nl, ix)
    w, wh, wa, w00, w01, w10, w11 = s
    ll = (wh * x - w * lam + wa * y - w * mu + w00 * np.log(t00) + w01 * np.log(t01) + w10 * np.log(t10) + w11 * np.log(t11)).sum(axis=1)
    out = -ll + l2 * (rows[:, :2 * n] ** 2).sum(axis=1)
    return out if np.ndim(theta) == 2 else float(out[0])


def _gradient_hessian(theta, n, nl, ix, s, l2):
    """Both of one fit or of one a row. Pairs are distinct inside a league, so a league's pairs fill a home x away grid."""
    rows = np.atleast_2d(theta)
    _, _, lam, mu, rho, t00, t01, t10, t11 = _terms(rows, n, nl, ix)
    w, wh, wa, w00, w01, w10, w11 = s
    h, a, l = ix
    many, m, u = len(rows), rows.shape[1], lam * mu
    low = w00 * u * rho / t00
    gl = wh - w * lam - low + w01 * lam * rho / t01
    gm = wa - w * mu - low + w10 * mu * rho / t10
    cross = -low / t00
    hll, hmm = -w * lam + cross + w01 * lam * rho / t01 ** 2, -w * mu + cross + w10 * mu * rho / t10 ** 2
    hlr, hmr = -w00 * u / t00 ** 2 + w01 * lam / t01 ** 2, -w00 * u / t00 ** 2 + w10 * mu / t10 ** 2
    grad, hess = np.zeros((many, m)), np.zeros((many, m, m))
    grad[:, -1] = (-w00 * u / t00 + w01 * lam / t01 + w10 * mu / t10 - w11 / t11).sum(axis=1)
    hess[:, -1, -1] = (-w00 * u ** 2 / t00 ** 2 - w01 * lam ** 2 / t01 ** 2 - w10 * mu ** 2 / t10 ** 2 - w11 / t11 ** 2).sum(axis=1)
    att, dfn, each = slice(0, n), slice(n, 2 * n), np.arange(n)
    for k in range(nl):
        at = np.flatnonzero(l == k)
        g, d = 2 * n + k, 2 * n + nl + k

        def grid(v):
            out = np.zeros((many, n * n))
            out[:, h[at] * n + a[at]] = v[:, at]
            return out.reshape(many, n, n)

        def sums(v):
            return v.sum(axis=2), v.sum(axis=1)

        c, ll, mm = grid(cross), grid(hll), grid(hmm)
        (lh, la), (mh, ma), (ch, ca) = sums(ll), sums(mm), sums(c)
        (glh, gla), (gmh, gma), (rlh, rla), (rmh, rma) = (sums(grid(v)) for v in (gl, gm, hlr, hmr))
        grad[:, att] += glh + gma
        grad[:, dfn] += gla + gmh
        grad[:, g] += glh.sum(axis=1)
        grad[:, d] += (glh + gmh).sum(axis=1)
        both = c + c.transpose(0, 2, 1)
        hess[:, att, att] += both
        hess[:, dfn, dfn] += both
        hess[:, each, each] += lh + ma
        hess[:, n + each, n + each] += la + mh
        side = ll + mm.transpose(0, 2, 1)
        side[:, each, each] += ch + ca
        hess[:, att, dfn] += side
        hess[:, dfn, att] += side.transpose(0, 2, 1)
        for col, va, vd in ((g, lh + ca, la + ch), (d, lh + ma + ch + ca, la + mh + ch + ca), (m - 1, rlh + rma, rla + rmh)):
            for part, v in ((att, va), (dfn, vd)):
                hess[:, part, col] += v
                hess[:, col, part] += v
        hl, hm, hc, hr, hs = (v.sum(axis=1) for v in (lh, mh, ch, rlh, rmh))
        hess[:, g, g] += hl
        hess[:, d, d] += hl + hm + 2 * hc
        for i, j, v in ((g, d, hl + hc), (g, m - 1, hr), (d, m - 1, hr + hs)):
            hess[:, i, j] += v
            hess[:, j, i] += v
    grad, hess = -grad, -hess
    grad[:, :2 * n] += 2 * l2 * rows[:, :2 * n]
    hess[:, np.arange(2 * n), np.arange(2 * n)] += 2 * l2
    return (grad, hess) if np.ndim(theta) == 2 else (grad[0], hess[0])


def _newton(n, nl, ix, s, l2, start=None, rho=None):
    """Bounded damped Newton on the statistics of several folds side by side (a row each): (theta, value, iterations).

    Every fold has its own damping and stops by itself; ``rho`` holds the shared parameter at a value a fold.
    """
    many, m = len(s[0]), 2 * n + 2 * nl + 1
    lo = np.tile(np.concatenate([np.full(2 * n, -np.inf), np.full(nl, GAMMA_BOUNDS[0]), np.full(nl, DELTA_BOUNDS[0]), [RHO_BOUNDS[0]]]), (many, 1))
    hi = np.tile(np.concatenate([np.full(2 * n, np.inf), np.full(nl, GAMMA_BOUNDS[1]), np.full(nl, DELTA_BOUNDS[1]), [RHO_BOUNDS[1]]]), (many, 1))
    theta = np.tile(np.concatenate([np.zeros(2 * n), np.full(nl, START_GAMMA), np.zeros(nl), [START_RHO]]), (many, 1))
    if start is not None:
        theta = np.clip(start, lo, hi)
    if rho is not None:
        theta[:, -1] = lo[:, -1] = hi[:, -1] = rho
    total, each = np.maximum(1.0, s[0].sum(axis=1)), np.arange(m)
    value, damp, its, live = neg_log_likelihood(theta, n, nl, ix, s, l2), np.full(many, 1e-6), np.zeros(many, int), np.arange(many)
    for _ in range(MAX_ITER):
        its[live] += 1
        now = theta[live]
        g, hs = _gradient_hessian(now, n, nl, ix, [x[live] for x in s], l2)
        free = ~(((now <= lo[live]) & (g > 0)) | ((now >= hi[live]) & (g < 0)) | (lo[live] == hi[live]))
        go = ~(np.where(free, np.abs(g), 0).max(axis=1) < 1e-6 * total[live] * 1e-3)
        if not go.any():
            break
        live, now, g, hs, free = live[go], now[go], g[go], hs[go], free[go]
        scale = np.maximum(np.abs(hs[:, each, each]), 1e-8)
        hs = np.where(free[:, :, None] & free[:, None, :], hs, 0)
        hs[:, each, each] += ~free  # a parameter at its bound stays
        g, before, todo, done = np.where(free, -g, 0), value[live], np.arange(len(live)), np.zeros(len(live), bool)
        for _ in range(30):
            at, k = live[todo], hs[todo]
            k[:, each, each] += damp[at][:, None] * scale[todo] + 1e-9
            try:
                step = np.linalg.solve(k, g[todo][:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                damp[at] = np.maximum(damp[at] * 10, 1e-6)
                continue
            trial = np.clip(now[todo] + step, lo[at], hi[at])
            new = neg_log_likelihood(trial, n, nl, ix, [x[at] for x in s], l2)
            good = np.isfinite(new) & (new < value[at])
            theta[at[good]], value[at[good]], done[todo[good]] = trial[good], new[good], True
            damp[at] = np.where(good, np.maximum(damp[at] / 10, 1e-12), np.maximum(damp[at] * 10, 1e-6))
            todo = todo[~good]
            if not len(todo):
                break
        live = live[done & ~(before - value[live] <= TOLERANCE * 1e-3 * np.maximum(1.0, np.abs(value[live])))]
        if not len(live):
            break
    return theta, value, its


CELLS = 1 << 19  # numbers of one array of a batch of folds, at most (one fold may hold more)


def solve_many(n, nl, ix, s, l2, start=None, rho=None):
    """``_newton`` in batches. Without ``start`` every fold begins at the fixed start, so its optimum depends on its own rows alone."""
    many, m = len(s[0]), 2 * n + 2 * nl + 1
    theta, value, its = np.empty((many, m)), np.empty(many), np.empty(many, int)
    size = max(1, CELLS // max(m * m, len(ix[0]), 1))
    with np.errstate(all="ignore"):
        for a in range(0, many, size):
            at = slice(a, a + size)
            theta[at], value[at], its[at] = _newton(n, nl, ix, [x[at] for x in s], l2, None if start is None else start[at], None if rho is None else rho[at])
    return theta, value, its


def _teams_of(n, ix, here):
    out = np.zeros((len(here), n), bool)
    fold, pair = np.nonzero(here)
    out[fold, ix[0][pair]] = out[fold, ix[1][pair]] = True
    return out


def solve_pairs(pdf: pd.DataFrame, l2: float, start: np.ndarray | None = None, rho: float | None = None):
    """Bounded damped Newton on the pair statistics of one fold; ``rho`` holds the shared parameter at a value."""
    _, teams, leagues, ix, s, _ = _tables(pdf.assign(fold=0))
    n, nl = len(teams), len(leagues)
    start = None if start is None or len(start) != 2 * n + 2 * nl + 1 else start[None]
    theta, value, it = solve_many(n, nl, ix, s, l2, start, None if rho is None else np.array([rho]))
    return teams, leagues, theta[0], float(value[0]), int(it[0]), ix, tuple(x[0] for x in s)


def _tables(pdf: pd.DataFrame):
    """(folds, teams, leagues, indices of each pair's home, away and league, seven tables of fold x pair, pairs that a fold has).

    Rows are statistics of a fold, or changes between folds with a clock row for each fold (``fold_changes``).
    """
    clock = None
    if "early" in pdf:
        clock = pdf[pdf["early"].notna()].drop_duplicates("fold").sort_values("fold")
        pdf = pdf[pdf["early"].isna()]
    folds = (pdf if clock is None else clock)["fold"].to_numpy(np.int64)
    folds = np.unique(folds) if clock is None else folds
    home, away = pdf["home_team_id"].to_numpy(), pdf["away_team_id"].to_numpy()
    teams = np.unique(np.concatenate([home, away]))
    names, l = np.unique(pdf["league"].fillna("").to_numpy(str), return_inverse=True)
    leagues = pdf["league"].to_numpy()[np.unique(l, return_index=True)[1]] if len(pdf) else names
    n = len(teams)
    code, pair = np.unique((l * n + np.searchsorted(teams, home)) * n + np.searchsorted(teams, away), return_inverse=True)
    ix = (code // max(n, 1) % max(n, 1), code % max(n, 1), code // max(n * n, 1))
    at = np.searchsorted(folds, pdf["fold"].to_numpy(np.int64))
    stats = pdf[STATS].fillna(0).to_numpy(float)
    table = np.zeros((len(folds), len(code), len(STATS)))
    here = np.zeros((len(folds), len(code)), bool)
    here[at, pair] = True
    if clock is None:
        np.add.at(table, (at, pair), stats)
    else:
        here = np.logical_or.accumulate(here, axis=0)
        tod = pdf["tod"].to_numpy()
        for t in np.unique(tod):
            mine = tod == t
            part = np.zeros_like(table)
            np.add.at(part, (at[mine], pair[mine]), stats[mine])
            scale = np.where(t > clock["tod"].to_numpy(), clock["late"], clock["early"])
            table += part.cumsum(axis=0) * scale[:, None, None]
    return folds, teams, leagues, ix, tuple(np.ascontiguousarray(table[:, :, k]) for k in range(len(STATS))), here


FOLDS = 64  # neighbouring folds that are solved side by side


def fold_changes(rows: DataFrame, xi: float, folds: int | None = None) -> DataFrame:
    """The statistics of ``fold_stats`` as changes, for the fits: what grows is a row a match, not a pair table a fold.

    Folds come in parts of ``folds`` (FOLDS). A part opens with the undecayed sums before it and holds what each fold adds; a clock row a
    (fold, league) has the fold's time of day ``tod`` and the decay of earlier (``early``) and later (``late``) times of day.
    """
    folds = folds or FOLDS
    starts = _starts(rows).selectExpr("grp", "fold", "tod_t", f"exp({-xi}D * day_t) AS early", f"exp({-xi}D * day_t) * exp({xi}D) AS late")
    # a row a group, so rows are not dealt out by their group, which may be all of them
    last = F.broadcast(starts.groupBy("grp").agg(F.max("fold").alias("last_fold")))
    pair = ["grp", "league", "home_team_id", "away_team_id", "tod"]
    inc = stored(_increments(rows, xi, pair).join(last, "grp").filter("fold <= last_fold").selectExpr("*", f"fold DIV {folds} AS part"))
    parts = inc.groupBy(*pair, "part", "last_fold").agg(*[F.sum(s).alias(s) for s in STATS])
    first = parts.groupBy(*pair, "last_fold").agg(F.min("part").alias("first_part"))
    grid = first.selectExpr(*pair, f"explode(sequence(first_part, last_fold DIV {folds})) AS part", *[f"0D AS {s}" for s in STATS])
    dense = parts.drop("last_fold").unionByName(grid).repartition(*pair).groupBy(*pair, "part").agg(*[F.sum(s).alias(s) for s in STATS])
    run = f"OVER (PARTITION BY {', '.join(pair)} ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    opening = dense.selectExpr(*pair, f"part * {folds} AS fold", "part", *[f"sum({s}) {run} AS {s}" for s in STATS], f"row_number() OVER (PARTITION BY {', '.join(pair)} ORDER BY part) AS _n")
    changes = inc.drop("last_fold").unionByName(opening.filter("_n > 1").drop("_n")).selectExpr("*", "CAST(NULL AS DOUBLE) AS early", "CAST(NULL AS DOUBLE) AS late")
    leagues = F.broadcast(inc.groupBy("grp", "league").agg(F.min("fold").alias("first_fold")))
    clocks = starts.join(leagues, "grp").filter("fold >= first_fold").selectExpr(
        "grp", "league", "CAST(NULL AS BIGINT) AS home_team_id", "CAST(NULL AS BIGINT) AS away_team_id", "tod_t AS tod", "fold", f"fold DIV {folds} AS part", *[f"0D AS {s}" for s in STATS], "early", "late")
    return changes.unionByName(clocks)


def _in_parts(stats: DataFrame) -> DataFrame:
    return stats if "part" in stats.columns else stats.withColumn("part", F.expr(f"fold DIV {FOLDS}"))


def fit_folds(stats: DataFrame, l2: float = 2.0) -> DataFrame:
    """One row per (grp, fold, team): strengths, the team's league gamma and delta, shared rho.

    ``stats`` are the rows of ``fold_stats`` or ``fold_changes``. A task holds the pair tables of one part's folds, each at
    most teams squared rows per league, and solves them side by side.
    """
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        folds, teams, leagues, ix, s, here = _tables(pdf)
        n, nl = len(teams), len(leagues)
        theta, value, it = solve_many(n, nl, ix, s, l2)
        att, dfn = theta[:, :n].copy(), theta[:, n:2 * n].copy()
        gam, dlt = theta[:, 2 * n:2 * n + nl], theta[:, 2 * n + nl:2 * n + 2 * nl].copy()
        mine, lg = _teams_of(n, ix, here), np.zeros(att.shape, int)
        for side in (ix[1], ix[0]):
            for k in range(nl):
                fold, pair = np.nonzero(here & (ix[2] == k))
                lg[fold, side[pair]] = k
        # centre strengths inside each league; the means belong to the league's level
        for k in range(nl):
            own = mine & (lg == k)
            size = np.maximum(own.sum(axis=1), 1)
            ma, md = np.where(own, att, 0).sum(axis=1) / size, np.where(own, dfn, 0).sum(axis=1) / size
            att -= np.where(own, ma[:, None], 0)
            dfn -= np.where(own, md[:, None], 0)
            dlt[:, k] += ma + md
        f, t = np.nonzero(mine)
        k = lg[f, t]
        return pd.DataFrame({
            "grp": key[0], "fold": folds[f], "league": leagues[k], "team_id": teams[t], "attack": att[f, t], "defence": dfn[f, t],
            "gamma": gam[f, k], "delta": dlt[f, k], "rho": theta[f, -1], "nll": value[f], "iterations": it[f]})

    # a fixed partition count keeps small tables from being packed into one Python worker
    n = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _in_parts(stats).repartition(n, "grp", "part").groupBy("grp", "part").applyInPandas(run, "grp string, " + PARAM_SCHEMA)


POOLED_FOLDS, PART_ROWS = 512, 1 << 20  # folds in a part of a pooled walk-forward; rows of a part whose leagues are solved together, at most
RHO_STEP, RHO_ROUNDS = 1e-9, 60  # the shared parameter is found when it moves less; rounds, at most (halving alone needs 30)
_BLOCK = ("grp string, part long, league string, fold long, teams array<long>, here array<boolean>, theta array<double>, rho double, lo double, hi double,"
          " value double, slope double, curve double, iterations int")


def _at_rho(n, ix, s, l2, start, rho):
    """One league's own parameters in several folds at a given rho: (theta, value, slope and curvature along rho, iterations).

    The slope is that of the parameters' own optimum: what is left of their gradient, small as it is, would be more than a step of
    RHO_STEP where a fold has the weight of a million matches.
    """
    theta, value, it = solve_many(n, 1, ix, s, l2, start, rho)
    many = len(theta)
    slope, curve = np.empty(many), np.empty(many)
    each, size = np.arange(2 * n + 2), max(1, CELLS // (2 * n + 3) ** 2)
    for a in range(0, many, size):
        own = theta[a:a + size]
        g, h = _gradient_hessian(own, n, 1, ix, [x[a:a + size] for x in s], l2)
        free = np.ones((len(own), 2 * n + 2), bool)  # a parameter at its bound does not follow rho
        for c, (lo, hi) in ((2 * n, GAMMA_BOUNDS), (2 * n + 1, DELTA_BOUNDS)):
            free[:, c] = (lo < own[:, c]) & (own[:, c] < hi)
        cross = np.where(free, h[:, -1, :-1], 0)
        inner = np.where(free[:, :, None] & free[:, None, :], h[:, :-1, :-1], 0)
        inner[:, each, each] += ~free
        try:
            follow = np.linalg.solve(inner, cross[:, :, None])[:, :, 0] if l2 > 0 else None
        except np.linalg.LinAlgError:
            follow = None
        if follow is None:
            follow = np.stack([np.linalg.lstsq(i, c, rcond=None)[0] for i, c in zip(inner, cross)])
        slope[a:a + size], curve[a:a + size] = g[:, -1] - (follow * np.where(free, g[:, :-1], 0)).sum(axis=1), h[:, -1, -1] - (cross * follow).sum(axis=1)
    return theta, value, slope, curve, it


def _league_block(l2: float):
    """One league's own parameters in each fold of a part at a given rho, and how their best likelihood moves with rho."""
    def run(key: tuple, pdf: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in _BLOCK.split(", ")]
        if not len(pdf) or not len(state):
            return pd.DataFrame(columns=names)
        folds, teams, leagues, ix, s, here = _tables(pdf)
        n, state = len(teams), state.sort_values("fold")
        at = np.searchsorted(folds, state["fold"].to_numpy(np.int64))
        s, here, rho = [x[at] for x in s], here[at], state["rho"].to_numpy(float)
        start = None if state["theta"].isna().any() else np.stack(state["theta"].to_list()).astype(float)
        theta, value, slope, curve, it = _at_rho(n, ix, s, l2, start, rho)
        return pd.DataFrame({"grp": key[0], "part": key[1], "league": key[2], "fold": state["fold"].to_numpy(), "teams": [teams] * len(at), "here": list(_teams_of(n, ix, here)),
                             "theta": list(theta), "rho": rho, "lo": state["lo"].to_numpy(), "hi": state["hi"].to_numpy(), "value": value, "slope": slope, "curve": curve, "iterations": it})[names]

    return run


def fit_pooled(stats: DataFrame, l2: float = 2.0) -> DataFrame:
    """Fits of several leagues that share rho: parameters as of ``fit_folds``.

    Parts of changes between folds are walked through (``neighbours.walk``), a task holding the changes of one part, as long as none
    has more than PART_ROWS rows. Fold tables and larger parts go league by league.
    """
    from touchline.operators import neighbours  # it builds on this module

    if "early" in stats.columns:
        stats = stored(stats)
        largest = stats.groupBy("grp", "part").count().agg(F.max("count")).first()[0] or 0
        if largest <= PART_ROWS:
            return neighbours.fit_parts(stats, l2)
    return _fit_by_league(stats, l2)


def _fit_by_league(stats: DataFrame, l2: float) -> DataFrame:
    """Pooled fits by block elimination.

    Leagues meet in rho alone. Given rho, every (fold, league) is solved by itself, and its likelihood's slope and curvature
    along rho (its own parameters eliminated) are three numbers; their sums give each fold's Newton step on rho, kept inside a
    shrinking bracket. So no task holds two leagues, and a round ends in one small aggregate. Blocks start from their
    last round; folds that are done leave. A task solves one league's folds of a part side by side.
    """
    keys, block = ["grp", "part", "league"], _league_block(l2)
    spark = stats.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = stored(_in_parts(stats).repartition(n, *keys))
    lo, hi = RHO_BOUNDS
    clocks = stats.filter("early IS NOT NULL") if "early" in stats.columns else stats
    state = clocks.select(*keys, "fold").distinct().selectExpr(*keys, "fold", "CAST(NULL AS ARRAY<DOUBLE>) AS theta", f"{START_RHO}D AS rho", f"{lo}D AS lo", f"{hi}D AS hi")
    done = None
    for _ in range(RHO_ROUNDS):
        rows = stats.repartition(n, *keys).groupBy(*keys)
        blocks = stored(rows.cogroup(state.repartition(n, *keys).groupBy(*keys)).applyInPandas(lambda key, pdf, own: block(key, pdf, own), _BLOCK))
        total = blocks.groupBy("grp", "fold", "rho", "lo", "hi").agg(*[F.sum(c).alias(c) for c in ("value", "slope", "curve")])
        # at a bound that the slope points beyond, the bracket closes on it
        step = total.selectExpr("*", "IF(slope > 0, lo, rho) AS _lo", "IF(slope > 0, rho, hi) AS _hi", "IF(curve > 0, rho - slope / curve, NULL) AS _new")
        step = step.withColumn("_new", F.expr(f"CASE WHEN _new > _lo AND _new < _hi THEN _new WHEN _new <= _lo AND _lo = {lo}D THEN _lo WHEN _new >= _hi AND _hi = {hi}D THEN _hi"
                                              " ELSE (_lo + _hi) / 2 END"))
        step = stored(step.withColumn("found", F.abs(F.col("_new") - F.col("rho")) <= RHO_STEP))
        now = blocks.join(step.filter("found").select("grp", "fold", F.col("value").alias("nll")), ["grp", "fold"])
        done = now if done is None else done.unionByName(now)
        folds = step.filter("NOT found").selectExpr("grp", "fold", "_new AS rho", "_lo AS lo", "_hi AS hi")
        if folds.isEmpty():
            break
        state = blocks.select(*keys, "fold", "theta").join(folds, ["grp", "fold"])
    else:
        raise RuntimeError("rho did not settle")
    k = "size(teams)"
    x = done.selectExpr("grp", "fold", "league", "teams", "here", f"slice(theta, 1, {k}) AS a", f"slice(theta, {k} + 1, {k}) AS d", f"theta[2 * {k}] AS gamma", f"theta[2 * {k} + 1] AS delta", "rho", "nll", "iterations")
    x = x.withColumn("own", F.expr("filter(arrays_zip(teams, a, d, here), x -> x.here)"))
    mean = lambda c: f"aggregate(own, 0D, (s, x) -> s + x.{c}) / size(own)"
    x = x.filter("size(own) > 0").selectExpr("*", f"{mean('a')} AS ma", f"{mean('d')} AS md")
    return x.selectExpr("grp", "fold", "league", "inline(transform(own, x -> struct(x.teams AS team_id, x.a - ma AS attack, x.d - md AS defence)))", "gamma", "delta + ma + md AS delta", "rho", "nll", "iterations")


def slopes(stats: DataFrame, params: DataFrame, l2: float = 2.0) -> DataFrame:
    """(grp, fold, league, parameter, slope, weight): derivatives of the penalised likelihood at fitted parameters.

    ``parameter`` is attack or defence with ``team_id``, gamma, delta, or rho (of the fold: league null).
    """
    fold = ["grp", "fold"]
    h = params.selectExpr(*fold, "team_id AS home_team_id", "attack AS _ah", "defence AS _dh", "gamma AS _g", "delta AS _d", "rho")
    a = params.selectExpr(*fold, "team_id AS away_team_id", "attack AS _aa", "defence AS _da")
    x = stats.join(h, [*fold, "home_team_id"]).join(a, [*fold, "away_team_id"]).selectExpr("*", "exp(_ah + _da + _g + _d) AS lam", "exp(_aa + _dh + _d) AS mu")
    x = x.selectExpr("*", "greatest(1 - lam * mu * rho, 1e-10D) AS t00", "greatest(1 + lam * rho, 1e-10D) AS t01", "greatest(1 + mu * rho, 1e-10D) AS t10", "greatest(1 - rho, 1e-10D) AS t11")
    x = x.selectExpr("*", "wh - w * lam - w00 * lam * mu * rho / t00 + w01 * lam * rho / t01 AS gl", "wa - w * mu - w00 * lam * mu * rho / t00 + w10 * mu * rho / t10 AS gm",
                     "-w00 * lam * mu / t00 + w01 * lam / t01 + w10 * mu / t10 - w11 / t11 AS gr")
    parts = x.selectExpr(*fold, "league", "w", """inline(array(
        named_struct('parameter', 'attack', 'team_id', home_team_id, 'g', gl, 'v', _ah), named_struct('parameter', 'defence', 'team_id', away_team_id, 'g', gl, 'v', _da),
        named_struct('parameter', 'attack', 'team_id', away_team_id, 'g', gm, 'v', _aa), named_struct('parameter', 'defence', 'team_id', home_team_id, 'g', gm, 'v', _dh),
        named_struct('parameter', 'gamma', 'team_id', NULL, 'g', gl, 'v', 0D), named_struct('parameter', 'delta', 'team_id', NULL, 'g', gl + gm, 'v', 0D)))""")
    own = parts.groupBy(*fold, "league", "parameter", "team_id").agg((F.sum("g") - 2 * l2 * F.first("v")).alias("slope"), F.sum("w").alias("weight"))
    shared = x.groupBy(*fold).agg(F.sum("gr").alias("slope"), F.sum("w").alias("weight")).selectExpr(
        *fold, "CAST(NULL AS STRING) AS league", "'rho' AS parameter", "CAST(NULL AS BIGINT) AS team_id", "slope", "weight")
    return own.unionByName(shared)


def gauge_fix(teams: DataFrame) -> DataFrame:
    """Centre attack and defence per league and move the means into delta (league, team_id, attack, defence, delta)."""
    w = "OVER (PARTITION BY league)"
    return teams.selectExpr(
        "league", "team_id", f"attack - avg(attack) {w} AS attack", f"defence - avg(defence) {w} AS defence",
        f"delta + avg(attack) {w} + avg(defence) {w} AS delta")


def with_fitted_rates(rows: DataFrame, params: DataFrame, keys=("grp", "fold")) -> DataFrame:
    """Add lam, mu, rho of the fit that serves each row; rows with an unseen team drop out."""
    keys = list(keys)
    h = params.selectExpr(*keys, "team_id AS home_team_id", "attack AS _ah", "defence AS _dh", "gamma AS _g", "delta AS _d", "rho")
    a = params.selectExpr(*keys, "team_id AS away_team_id", "attack AS _aa", "defence AS _da")
    j = rows.join(h, [*keys, "home_team_id"]).join(a, [*keys, "away_team_id"])
    return j.selectExpr(*[f"`{c}`" for c in rows.columns], "exp(_ah + _da + _g + _d) AS lam", "exp(_aa + _dh + _d) AS mu", "rho")
