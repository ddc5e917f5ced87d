"""Probability calibration: isotonic curves per market, temperature per group."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_SAMPLES = 30
CELLS = 1000  # equal probability cells that turn the breakpoint lookup into an equi-join


def _pool(x_lo, x_hi, y, w):
    """Pool adjacent violators over already ordered weighted blocks."""
    out = []
    for lo, hi, s, n in zip(x_lo, x_hi, y * w, w):
        out.append([lo, hi, s, n])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            lo2, hi2, s2, n2 = out.pop()
            out[-1][1] = hi2
            out[-1][2] += s2
            out[-1][3] += n2
    a = np.array(out, dtype=float).reshape(-1, 4)
    return pd.DataFrame({"x_lo": a[:, 0], "x_hi": a[:, 1], "y": a[:, 2] / a[:, 3], "w": a[:, 3]})


def fit_isotonic(points: DataFrame) -> DataFrame:
    """curve(market, x, y, n_train) from (market, prob, hit 0/1): the weighted isotonic fit.

    Equal probabilities are summed first; each range partition then pools its own stretch,
    and one task per market pools what is left. Pooling stretches first does not change the
    result, and blocks of 0/1 outcomes are few: n outcomes leave at most about n^(2/3)
    distinct rising means, so the last step never sees the rows.
    """
    sums = points.groupBy("market", "prob").agg(F.sum(F.col("hit").cast("double")).alias("h"), F.count("*").alias("n"))
    ordered = sums.repartitionByRange("market", "prob").sortWithinPartitions("market", "prob")

    def stretch(batches):
        for pdf in batches:
            for market, g in pdf.groupby("market", sort=False):
                n = g["n"].to_numpy(float)
                b = _pool(g["prob"].to_numpy(), g["prob"].to_numpy(), g["h"].to_numpy() / n, n)
                yield b.assign(market=market)[["market", "x_lo", "x_hi", "y", "w"]]

    def whole(pdf):
        g = pdf.sort_values("x_lo")
        b = _pool(g["x_lo"].to_numpy(), g["x_hi"].to_numpy(), g["y"].to_numpy(), g["w"].to_numpy())
        n = int(b["w"].sum())
        ends = pd.concat([b[["x_lo", "y"]].set_axis(["x", "y"], axis=1), b[["x_hi", "y"]].set_axis(["x", "y"], axis=1)])
        ends = ends.drop_duplicates().sort_values("x")
        return ends.assign(market=pdf["market"].iloc[0], n_train=n)[["market", "x", "y", "n_train"]]

    blocks = ordered.mapInPandas(stretch, "market string, x_lo double, x_hi double, y double, w double")
    return blocks.groupBy("market").applyInPandas(whole, "market string, x double, y double, n_train long")


def curve_segments(curve: DataFrame) -> DataFrame:
    """(market, cell, x0, x1, y0, y1) of trained curves, one row per probability cell touched."""
    w = Window.partitionBy("market").orderBy("x")
    c = curve.filter(F.col("n_train") >= MIN_SAMPLES).withColumn("k", F.count("*").over(Window.partitionBy("market")))
    c = c.filter("k >= 2").select("market", "x", "y", F.lag("x").over(w).alias("px"), F.lag("y").over(w).alias("py"),
                                  F.lead("x").over(w).alias("nx"))
    inner = c.selectExpr("market", "coalesce(px, -1D) AS x0", "x AS x1", "coalesce(py, y) AS y0", "y AS y1")
    tail = c.filter("nx IS NULL").selectExpr("market", "x AS x0", "2D AS x1", "y AS y0", "y AS y1")
    seg = inner.unionByName(tail)
    cell = lambda e: f"CAST(greatest(0, least({CELLS}, floor({e} * {CELLS}))) AS INT)"
    return seg.selectExpr("*", f"explode(sequence({cell('x0')}, {cell('x1')})) AS cell")


def apply_curve(df: DataFrame, curve: DataFrame, prob: str = "prob") -> DataFrame:
    """Replace ``prob`` by its calibrated value; a market without a trained curve keeps it."""
    seg = curve_segments(curve).select(F.col("market").alias("_m"), F.col("cell").alias("_c"), "x0", "x1", "y0", "y1")
    left = df.withColumn("_cell", F.expr(f"CAST(greatest(0, least({CELLS}, floor({prob} * {CELLS}))) AS INT)"))
    bucket = F.regexp_replace("market", "^OU_", "over_under_")
    j = left.join(seg, (bucket == F.col("_m")) & (F.col("_cell") == F.col("_c"))
                  & (F.col(prob) > F.col("x0")) & (F.col(prob) <= F.col("x1")), "left")
    value = F.expr(f"CASE WHEN x0 IS NULL THEN {prob} WHEN x0 < 0 OR y0 = y1 THEN y1"
                   f" ELSE y0 + ({prob} - x0) / (x1 - x0) * (y1 - y0) END")
    return j.select(*[value.alias(c) if c == prob else F.col(c) for c in df.columns])


def mean_rates(points: DataFrame) -> DataFrame:
    return points.groupBy("market").agg(F.count("*").alias("n"), F.avg("prob").alias("pred_avg"),
                                        F.avg(F.col("hit").cast("double")).alias("actual"))


OUTCOMES = 3  # most outcomes of a market whose temperature is fitted


def _with_logs(df: DataFrame, keys) -> DataFrame:
    """keys, the logs of ``p`` as columns l0.. (null beyond the market's outcomes) and ``ly``, the one that came true (``y``, from 1)."""
    more = f"IF(size(p) > {OUTCOMES}, raise_error('a market has too many outcomes'), p)"
    slot = [f"ln(greatest(get(_p, {i}), 1e-12D)) AS l{i}" for i in range(OUTCOMES)]  # no lambda, so this stays in generated code
    x = df.selectExpr(*keys, f"{more} AS _p", "y")
    return x.selectExpr(*keys, *[e if i < 2 else f"IF(size(_p) > {i}, {e.rsplit(' AS ', 1)[0]}, NULL) AS l{i}" for i, e in enumerate(slot)],
                        "ln(greatest(element_at(_p, y), 1e-12D)) AS ly")


def _over_logs(term) -> str:
    return "(" + " + ".join(f"coalesce({term(f'l{i}')}, 0D)" for i in range(OUTCOMES)) + ")"


def _nll(beta: str) -> str:
    """Mean-able negative log likelihood at 1/T = beta."""
    return f"ln({_over_logs(lambda q: f'exp({beta} * {q})')}) - {beta} * ly"


def temperature_nll(df: DataFrame, keys, temps) -> DataFrame:
    """Mean negative log likelihood of every temperature, all in one aggregate pass."""
    agg = _with_logs(df, keys).groupBy(*keys).agg(F.count("*").alias("n"), *[F.expr(f"avg({_nll(f'{1.0 / t!r}D')}) AS t{i}") for i, t in enumerate(temps)])
    items = ", ".join(f"struct({float(t)}D AS t, t{i} AS nll)" for i, t in enumerate(temps))
    return agg.selectExpr(*keys, "n", f"inline(array({items}))")


def fit_temperature(df: DataFrame, keys, passes: int = 3, points: int = 16, lo: float = 0.05, hi: float = 20.0) -> DataFrame:
    """(keys..., T, n): the temperature with the least negative log likelihood per group.

    The likelihood is convex in 1/T, so each pass evaluates a small log grid as plain aggregate
    columns (no row is copied), the next pass looks between the neighbours of the best point,
    and the last one ends on the parabola through them. Partial sums shrink a hot group before
    the shuffle.
    """
    keys = list(keys)
    df, bounds = _with_logs(df, keys), None
    for _ in range(passes):
        if bounds is None:
            x = df.selectExpr("*", f"ln({lo}D) AS _lo", f"ln({hi}D) AS _hi")
        else:
            x = df.join(bounds, keys)
        step = f"(_hi - _lo) / {points - 1}D"
        sums = x.groupBy(*keys, "_lo", "_hi").agg(
            F.count("*").alias("n"),
            F.array(*[F.expr(f"sum({_nll(f'exp(-(_lo + {i}D * {step}))')})") for i in range(points)]).alias("_s"))
        at = sums.selectExpr(*keys, "n", "_lo", f"{step} AS _st", "_s", "array_position(_s, array_min(_s)) - 1 AS _i")
        at = at.selectExpr(*keys, "n", "_lo", "_st", "_i", "_s[CAST(_i AS INT)] AS _f", "get(_s, CAST(_i - 1 AS INT)) AS _l",
                           "get(_s, CAST(_i + 1 AS INT)) AS _r")
        bounds = at.selectExpr(*keys, "_lo + greatest(_i - 1, 0) * _st AS _lo", f"_lo + least(_i + 1, {points - 1}) * _st AS _hi")
    vertex = "coalesce(try_divide(0.5D * (_l - _r), _l - 2 * _f + _r), 0D)"
    near = at.selectExpr(*keys, f"exp(-(_lo + (_i + {vertex}) * _st)) AS _b", "n")
    # one Newton step on 1/T from there: mean and variance of the logs under the scaled probabilities
    total = lambda f: _over_logs(lambda q: f"exp(_b * {q}){f.format(q=q)}")
    x = df.join(near, keys).selectExpr(*keys, "_b", "n", f"{total('')} AS _z", f"{total(' * {q}')} AS _m", f"{total(' * {q} * {q}')} AS _v", "ly AS _y")
    g = x.groupBy(*keys, "_b", "n").agg(F.expr("sum(_m / _z - _y) AS _d"), F.expr("sum(_v / _z - (_m / _z) * (_m / _z)) AS _dd"))
    return g.selectExpr(*keys, f"1D / least({1 / lo!r}D, greatest({1 / hi!r}D, _b - coalesce(try_divide(_d, _dd), 0D))) AS T", "n")


def log_probabilities(values: np.ndarray, at: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Logs of the values at these places, as ``_with_logs`` takes them; unused places count nothing."""
    p = np.nan_to_num(values.astype(float), nan=1e-12)[np.where(use, at, 0)]
    return np.where(use, np.log(np.maximum(p, 1e-12)), -1e100)


def temperatures_of(logs: np.ndarray, true: np.ndarray, use: np.ndarray, lo: float = 0.05, hi: float = 20.0) -> np.ndarray:
    """The temperature of ``fit_temperature`` for several groups side by side: logs (group, row, outcome), true log (group, row).

    The likelihood is convex in 1/T: Newton steps inside a bracket that its slope narrows.
    """
    a, b, x = np.full(len(logs), 1 / hi), np.full(len(logs), 1 / lo), np.ones(len(logs))
    flat, outcomes = None, [np.ascontiguousarray(logs[:, :, k]) for k in range(logs.shape[2])]
    for _ in range(80):
        z, m, v = np.zeros_like(true), np.zeros_like(true), np.zeros_like(true)
        for q in outcomes:  # added up one after the other: sums over a short last axis are slow
            w = np.exp(x[:, None] * q)
            z += w
            w *= q
            m += w
            w *= q
            v += w
        m /= z
        d = np.where(use, m - true, 0).sum(axis=1)
        v /= z
        dd = np.where(use, v - m * m, 0).sum(axis=1)
        if flat is None:
            flat = (np.abs(d) < 1e-12) & (dd < 1e-12)  # every temperature is as good: the lowest, as the grid has it
        a, b = np.where(d < 0, x, a), np.where(d < 0, b, x)
        with np.errstate(all="ignore"):
            new = x - d / dd
        new = np.where(np.abs(new - x) < 1e-12, x, np.where((new > a) & (new < b), new, (a + b) / 2))
        new = np.where(d == 0, x, new)
        done = np.abs(new - x).max(initial=0) < 1e-13
        x = new
        if done:
            break
    return np.where(flat, lo, 1 / x)
