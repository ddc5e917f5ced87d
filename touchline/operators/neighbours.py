"""Pooled fits of a long walk-forward: each fold starts from the fold before it.

Neighbouring folds differ by a few matches, so their optima lie close together and one Hessian serves a run of them: with its
inverse kept, a step costs a gradient and a product of matrices. Leagues meet in rho alone, so the Hessian is a block per league
and one border, and rho moves together with all other parameters. Steps repeat until no parameter moves by STEP. Folds that
do not get there, whose parameters reach a bound or whose curvature is not positive are solved from the fixed start as
``fit.fit_pooled`` does for single folds.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.operators import fit
from touchline.session import stored

STEP, STEPS = 1e-9, 14  # a fold is solved when no parameter moves more; steps with one Hessian
RUN = 64  # folds that share a Hessian, at most
CELLS = 1 << 22  # numbers in the tables of a run, at most (one fold may hold more)
_LOW = np.array([fit.GAMMA_BOUNDS[0], fit.DELTA_BOUNDS[0]])
_HIGH = np.array([fit.GAMMA_BOUNDS[1], fit.DELTA_BOUNDS[1]])


class League:
    """One league's changes in a part: sums up to the last fold read, per time of day, as home x away grids."""

    def __init__(self, pdf: pd.DataFrame):
        clock = pdf[pdf["early"].notna()].drop_duplicates("fold").sort_values("fold")
        rows = pdf[pdf["early"].isna()]
        self.folds, self.early, self.late = clock["fold"].to_numpy(np.int64), clock["early"].to_numpy(float), clock["late"].to_numpy(float)
        self.clock = clock["tod"].to_numpy()
        home, away = rows["home_team_id"].to_numpy(), rows["away_team_id"].to_numpy()
        self.teams = np.unique(np.concatenate([home, away]))
        self.n = n = len(self.teams)
        h, a = np.searchsorted(self.teams, home), np.searchsorted(self.teams, away)
        at = np.searchsorted(self.folds, rows["fold"].to_numpy(np.int64))
        self.first = np.full(n, len(self.folds))  # the fold that first knows a team
        np.minimum.at(self.first, h, at)
        np.minimum.at(self.first, a, at)
        self.tods, tod = np.unique(rows["tod"].to_numpy(), return_inverse=True)
        self.sums = np.zeros((len(self.tods), len(fit.STATS), n * n))
        self.ix = (np.repeat(np.arange(n), n), np.tile(np.arange(n), n), np.zeros(n * n, int))
        order = np.argsort(at, kind="stable")
        self.at, self.pair, self.tod = at[order], (h * n + a)[order], tod[order]
        self.stats = rows[fit.STATS].fillna(0).to_numpy(float)[order]

    def tables(self, a: int, b: int) -> np.ndarray:
        """The seven statistics of folds a to b: (7, folds, home, away). Runs are read in order, each once."""
        mine = slice(*np.searchsorted(self.at, [a, b]))
        at, pair, tod, stats = self.at[mine] - a, self.pair[mine], self.tod[mine], self.stats[mine]
        out = np.zeros((len(fit.STATS), b - a, self.n ** 2))
        for t, value in enumerate(self.tods):
            now, scale = tod == t, np.where(value > self.clock[a:b], self.late[a:b], self.early[a:b])
            if now.any():
                part = np.zeros_like(out)
                part[:, 0] = self.sums[t]
                for k in range(len(out)):
                    part[k] += np.bincount(at[now] * self.n ** 2 + pair[now], stats[now, k], part[k].size).reshape(part[k].shape)
                part = part.cumsum(axis=1, out=part)
                self.sums[t] = part[:, -1]
                part *= scale[:, None]
                out += part
            else:
                out += self.sums[t][:, None] * scale[:, None]
        return out.reshape(len(out), b - a, self.n, self.n)


def _gradient(theta, rho, s, l2):
    """Of the own parameters and along rho, without what does not depend on the parameters but for a constant: a fold a row."""
    n = s[0].shape[-1]
    (w, _, _, w00, w01, w10, _), (own, w11) = s[:7], s[7:]
    g, d = theta[:, 2 * n:2 * n + 1], theta[:, 2 * n + 1:]
    ea, ed, r = np.exp(theta[:, :n]), np.exp(theta[:, n:2 * n]), rho[:, None, None]
    lam, mu = (ea * np.exp(g + d))[:, :, None] * ed[:, None, :], (ed * np.exp(d))[:, :, None] * ea[:, None, :]
    q = w00 * (u := lam * mu)
    q /= np.maximum(1 - u * r, 1e-10)
    x, y = w01 * lam, w10 * mu
    x /= np.maximum(1 + lam * r, 1e-10)
    y /= np.maximum(1 + mu * r, 1e-10)
    x -= q
    along = x.sum(axis=(1, 2)) + y.sum(axis=(1, 2)) - w11 / np.maximum(1 - rho, 1e-10)
    y -= q
    x *= r
    y *= r
    x -= np.multiply(w, lam, out=lam)
    y -= np.multiply(w, mu, out=mu)
    xh, ya = x.sum(axis=2), y.sum(axis=1)
    up = np.concatenate([xh + ya, x.sum(axis=1) + y.sum(axis=2), (gx := xh.sum(axis=1))[:, None], (gx + ya.sum(axis=1))[:, None]], axis=1)
    up = -up - own
    up[:, :2 * n] += 2 * l2 * theta[:, :2 * n]
    return up, -along


def _ready(s):
    """The tables of a run, with what the gradient adds whatever the parameters, and the summed weight of 1:1."""
    wh, wa = s[1], s[2]
    h, a = wh.sum(axis=2), wa.sum(axis=1)
    total = h.sum(axis=1)
    own = np.concatenate([h + a, wh.sum(axis=1) + wa.sum(axis=2), total[:, None], (total + a.sum(axis=1))[:, None]], axis=1)
    return [*s, own, s[6].sum(axis=(1, 2))]


def _flat(s, at):
    return [x[at].reshape(len(x[at]), -1) for x in s[:7]]


def _inverse(leagues, tables, at, thetas, rho, l2):
    """Of the joint Hessian of one fold: per league the inverse block and the border seen through it, and the curvature left along rho; None if not positive."""
    left, out = 0.0, []
    for lg, s, theta in zip(leagues, tables, thetas):
        _, h = fit._gradient_hessian(np.append(theta, rho)[None], lg.n, 1, lg.ix, _flat(s, slice(at, at + 1)), l2)
        inner, border = h[0, :-1, :-1], h[0, :-1, -1]
        inner[np.diag_indices(len(inner))] += 1e-9
        try:
            np.linalg.cholesky(inner)
            inv = np.linalg.inv(inner)
        except np.linalg.LinAlgError:
            return None
        out.append((inv, inv @ border))
        left += h[0, -1, -1] - border @ out[-1][1]
    return (out, left) if left > 0 else None


def _together(leagues, tables, thetas, rho, l2):
    """A run of folds from one start: (parameters per league, rho, steps, which folds are solved)."""
    many = len(tables[0][0])
    inverse = _inverse(leagues, tables, many // 2, thetas, rho, l2)
    if inverse is None:
        return None
    parts, left = inverse
    own, r, steps, going = [np.tile(x, (many, 1)) for x in thetas], np.full(many, rho), np.zeros(many, int), np.ones(many, bool)
    before = np.full(many, np.inf)
    for _ in range(STEPS):
        if not going.any():
            break
        steps += going
        g = [_gradient(t, r, s, l2) for t, s in zip(own, tables)]
        shift = (sum(v @ b for (v, _), (_, b) in zip(g, parts)) - sum(v for _, v in g)) / left
        most = np.abs(shift)
        for t, (v, _), (inv, b) in zip(own, g, parts):
            step = -(v @ inv) - shift[:, None] * b
            most = np.maximum(most, np.abs(step).max(axis=1))
            t[going] += step[going]
        r[going] += shift[going]
        lost = ~(most <= 0.7 * before)  # not drawing nearer: left to the fixed start, or to a Hessian of its own
        going &= most > STEP
        if (going & lost).any():
            r[np.flatnonzero(going & lost)[0]:] = np.nan  # folds are taken in order, so what follows is not needed either
            going &= ~np.isnan(r)
        before = most
    good = ~going & np.isfinite(r) & (r > fit.RHO_BOUNDS[0]) & (r < fit.RHO_BOUNDS[1])
    for t in own:
        good &= np.isfinite(t).all(axis=1) & ((t[:, -2:] > _LOW) & (t[:, -2:] < _HIGH)).all(axis=1)
    return own, r, steps, good


def _apart(leagues, tables, l2):
    """Folds from the fixed start, rho by Newton steps inside a shrinking bracket and each league by itself at a given rho."""
    many = len(tables[0][0])
    lo, hi = np.full(many, fit.RHO_BOUNDS[0]), np.full(many, fit.RHO_BOUNDS[1])
    rho, live = np.full(many, fit.START_RHO), np.arange(many)
    own, its = [np.empty((many, 2 * lg.n + 2)) for lg in leagues], np.zeros(many, int)
    start = [None] * len(leagues)
    for _ in range(fit.RHO_ROUNDS):
        slope, curve, one = 0.0, 0.0, 0
        for k, (lg, s) in enumerate(zip(leagues, tables)):
            theta, _, a, b, it = fit._at_rho(lg.n, lg.ix, _flat(s, live), l2, start[k], rho[live])
            own[k][live], start[k], slope, curve, one = theta[:, :-1], theta, slope + a, curve + b, np.maximum(one, it)
        its[live] += one
        low, high = np.where(slope > 0, lo[live], rho[live]), np.where(slope > 0, rho[live], hi[live])
        with np.errstate(all="ignore"):
            new = np.where(curve > 0, rho[live] - slope / curve, np.nan)
        # at a bound that the slope points beyond, the bracket closes on it
        new = np.where((new > low) & (new < high), new, np.where((new <= low) & (low == fit.RHO_BOUNDS[0]), low, np.where((new >= high) & (high == fit.RHO_BOUNDS[1]), high, (low + high) / 2)))
        more = np.abs(new - rho[live]) > fit.RHO_STEP
        start = [x[more] for x in start]
        live, low, high, new = live[more], low[more], high[more], new[more]
        if not len(live):
            return own, rho, its
        rho[live], lo[live], hi[live] = new, low, high
    raise RuntimeError("rho did not settle")


def _value(theta, rho, s, l2):
    """The objective without the constant log factorials."""
    n = s[0].shape[-1]
    w, w00, w01, w10 = s[0], s[3], s[4], s[5]
    g, d = theta[:, 2 * n:2 * n + 1], theta[:, 2 * n + 1:]
    ea, ed, r = np.exp(theta[:, :n]), np.exp(theta[:, n:2 * n]), rho[:, None, None]
    lam, mu = (ea * np.exp(g + d))[:, :, None] * ed[:, None, :], (ed * np.exp(d))[:, :, None] * ea[:, None, :]
    low = [(w00, 1 - lam * mu * r), (w01, 1 + lam * r), (w10, 1 + mu * r)]
    ll = sum((x * np.log(np.maximum(t, 1e-10))).sum(axis=(1, 2)) for x, t in low) - (w * (lam + mu)).sum(axis=(1, 2))
    return l2 * (theta[:, :2 * n] ** 2).sum(axis=1) - ll - (theta * s[7]).sum(axis=1) - s[8] * np.log(np.maximum(1 - rho, 1e-10))


def walk(leagues: list[League], l2: float):
    """Yields (league number, its first and last fold + 1, parameters, rho, value of the fold over all leagues, steps) of runs of folds in their order."""
    folds = np.unique(np.concatenate([lg.folds for lg in leagues])) if leagues else np.empty(0, np.int64)
    at = [np.searchsorted(lg.folds, folds) for lg in leagues]
    has = np.stack([np.isin(folds, lg.folds) for lg in leagues]) if leagues else np.empty((0, 0), bool)
    starts, rho, a = [None] * len(leagues), None, 0
    while a < len(folds):
        here = np.flatnonzero(has[:, a])
        run = max(1, min(RUN, CELLS // max(1, sum(len(fit.STATS) * leagues[k].n ** 2 for k in here))))
        b = a + 1
        while b < min(a + run, len(folds)) and (has[:, b] == has[:, a]).all():
            b += 1
        some = [leagues[k] for k in here]
        tables = [_ready(lg.tables(at[k][a], at[k][a] + b - a)) for k, lg in zip(here, some)]
        own, r, steps = [np.empty((b - a, 2 * lg.n + 2)) for lg in some], np.empty(b - a), np.empty(b - a, int)
        done, size = 0, b - a
        while done < b - a:
            known = rho is not None and all(starts[k] is not None for k in here)
            to = min(done + size, b - a) if known else done + 1
            cut = [[x[done:to] for x in s] for s in tables]
            got = _together(some, cut, [starts[k] for k in here], rho, l2) if known else None
            good = 0 if got is None else int(np.argmin(np.append(got[3], False)))
            if not good and known and size > 1:
                size = max(1, size // 4)
                continue
            if good:
                found, fr, fs = [x[:good] for x in got[0]], got[1][:good], got[2][:good]
                size = min(RUN, 2 * size) if good == to - done else max(1, good)
            else:
                to = b - a if known else to  # a fold whose own Hessian does not lead there: neither will those after it
                cut = [[x[done:to] for x in s] for s in tables]
                good = to - done
                found, fr, fs = _apart(some, cut, l2)
            for x, y in zip(own, found):
                x[done:done + good] = y
            r[done:done + good], steps[done:done + good] = fr, fs
            done += good
            for k, x in zip(here, own):
                starts[k] = x[done - 1].copy()
            rho = r[done - 1]
        value = sum(_value(x, r, s, l2) for x, s in zip(own, tables))
        for k, x in zip(here, own):
            yield k, at[k][a], at[k][a] + b - a, x, r, value, steps
        a = b


_FITS = "grp string, fold long, league string, teams array<struct<team_id: long, attack: double, defence: double>>, gamma double, delta double, rho double, nll double, iterations int"


def _rows(grp, league, lg: League, a, b, theta, rho, value, steps) -> pa.Table | None:
    """Strengths of the teams each fold knows, centred inside the league; the means belong to the league's level."""
    n, mine = lg.n, lg.first <= np.arange(a, b)[:, None]
    keep = mine.any(axis=1)
    if not keep.any():
        return None
    size = np.maximum(mine.sum(axis=1), 1)
    att, dfn = theta[:, :n], theta[:, n:2 * n]
    ma, md = (np.where(mine, x, 0).sum(axis=1) / size for x in (att, dfn))
    fold, team = np.nonzero(mine)
    ids = lg.teams[team]
    ids = pa.array(ids, pa.int64(), mask=pd.isna(ids)) if ids.dtype.kind != "f" else pa.array(np.nan_to_num(ids).astype(np.int64), mask=np.isnan(ids))
    teams = pa.StructArray.from_arrays([ids, pa.array((att - ma[:, None])[fold, team]), pa.array((dfn - md[:, None])[fold, team])], ["team_id", "attack", "defence"])
    ends = np.append(0, np.cumsum(mine.sum(axis=1)[keep])).astype(np.int32)
    many = int(keep.sum())
    return pa.table({
        "grp": pa.array([grp] * many, pa.string()), "fold": lg.folds[a:b][keep], "league": pa.array([league] * many, pa.string()), "teams": pa.ListArray.from_arrays(pa.array(ends), teams),
        "gamma": theta[keep, 2 * n], "delta": (theta[:, 2 * n + 1] + ma + md)[keep], "rho": rho[keep], "nll": value[keep], "iterations": pa.array(steps[keep], pa.int32())})


def _part(l2: float):
    def run(key, table):
        names, leagues = [], []
        for name, pdf in table.to_pandas().groupby("league", dropna=False, sort=True):
            if pdf["early"].notna().any() and pdf["early"].isna().any():
                names.append(None if pd.isna(name) else name)
                leagues.append(League(pdf))
        with np.errstate(all="ignore"):
            out = [_rows(key[0].as_py(), names[k], leagues[k], *found) for k, *found in walk(leagues, l2)]
        out = [x for x in out if x is not None]
        return pa.concat_tables(out) if out else pa.schema([
            ("grp", pa.string()), ("fold", pa.int64()), ("league", pa.string()), ("teams", pa.list_(pa.struct([("team_id", pa.int64()), ("attack", pa.float64()), ("defence", pa.float64())]))),
            ("gamma", pa.float64()), ("delta", pa.float64()), ("rho", pa.float64()), ("nll", pa.float64()), ("iterations", pa.int32())]).empty_table()

    return run


def fit_parts(stats: DataFrame, l2: float) -> DataFrame:
    """The fits of ``fit.fit_pooled`` from the rows of ``fit.fold_changes``, a part a task."""
    n = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = stored(stats.repartition(n, "grp", "part").groupBy("grp", "part").applyInArrow(_part(l2), _FITS))
    return fits.select("grp", "fold", "league", F.inline("teams"), "gamma", "delta", "rho", "nll", "iterations")
