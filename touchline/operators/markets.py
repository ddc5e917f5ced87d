"""Every betting market from expected goals, one match per row, without a shuffle.

A corrected score matrix is a product of two Poisson vectors plus four changed cells, so
each market is a short sum of products. Nothing is exploded unless a caller asks for cells.
The sums are written as SQL text: one parse each, instead of hundreds of Column calls.
"""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions.goals import MAX_GOALS, TAU_FLOOR

N = MAX_GOALS
LINES = (0.5, 1.5, 2.5, 3.5, 4.5)
HANDICAPS = ("0", "-0.5", "-1", "+0.5", "+1")
LOW = {(0, 0): "1D - lam * mu * rho", (0, 1): "1D + lam * rho", (1, 0): "1D + mu * rho", (1, 1): "1D - rho"}


def _sum(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _pmf(rate: str, k: int) -> str:
    # multiply by 1/k! instead of dividing: division is nullable in Spark, products are not
    return f"exp(-{rate}) * pow({rate}, {float(k)}D) * {1.0 / math.factorial(k)!r}D"


def with_goal_vectors(df: DataFrame) -> DataFrame:
    """From lam, mu, rho: h0..h10, a0..a10 (scaled so the matrix sums to one) and d00..d11.

    Cell (i, j) is ``h_i * a_j``, plus ``d_ij`` for the four low scores.
    """
    keep = [f"`{c}`" for c in df.columns]
    ks = range(N + 1)
    raw = df.filter("lam IS NOT NULL AND mu IS NOT NULL AND rho IS NOT NULL").selectExpr(
        *keep,
        *[f"{_pmf('lam', k)} AS _h{k}" for k in ks],
        *[f"{_pmf('mu', k)} AS _a{k}" for k in ks],
        *[f"greatest({t}, {TAU_FLOOR}D) - 1D AS _t{i}{j}" for (i, j), t in LOW.items()],
    )
    mass = (_sum(f"_h{k}" for k in ks) + " * " + _sum(f"_a{k}" for k in ks) + " + "
            + _sum(f"_h{i} * _a{j} * _t{i}{j}" for i, j in LOW))
    scaled = raw.selectExpr("*", f"1D / ({mass}) AS _z")
    return scaled.selectExpr(
        *keep,
        *[f"_h{k} * _z AS h{k}" for k in ks],
        *[f"_a{k} AS a{k}" for k in ks],
        *[f"_h{i} * _z * _a{j} * _t{i}{j} AS d{i}{j}" for i, j in LOW],
    )


def _cell(i: int, j: int) -> str:
    return f"(h{i} * a{j} + d{i}{j})" if (i, j) in LOW else f"h{i} * a{j}"


def total_mass(k: int) -> str:
    """P(home + away = k)."""
    return _sum(_cell(i, k - i) for i in range(max(0, k - N), min(N, k) + 1))


def margin_mass(k: int) -> str:
    """P(home - away = k)."""
    return _sum(_cell(i, i - k) for i in range(max(0, k), min(N, N + k) + 1))


def home_mass(k: int) -> str:
    return _sum(_cell(k, j) for j in range(N + 1))


def away_mass(k: int) -> str:
    return _sum(_cell(i, k) for i in range(N + 1))


def with_distributions(df: DataFrame) -> DataFrame:
    """Arrays of the total, margin and per-side goal distributions, for any line."""
    keep = [f"`{c}`" for c in df.columns]

    def arr(parts, name):
        return f"array({', '.join(parts)}) AS {name}"

    return with_goal_vectors(df).selectExpr(
        *keep,
        arr((total_mass(k) for k in range(2 * N + 1)), "total_pmf"),
        arr((margin_mass(k) for k in range(-N, N + 1)), "margin_pmf"),
        arr((home_mass(k) for k in range(N + 1)), "home_pmf"),
        arr((away_mass(k) for k in range(N + 1)), "away_pmf"),
    )


def component_lines(line: Column) -> Column:
    """A quarter line is the mean of its two neighbours; any other line stands alone."""
    frac = line - F.floor(line)
    quarter = (F.abs(frac - 0.25) < 1e-9) | (F.abs(frac - 0.75) < 1e-9)
    return F.when(quarter, F.array(line - 0.25, line + 0.25)).otherwise(F.array(line))


def over_at(pmf: str, line: str, first: int = 0) -> Column:
    """Over probability at any line: half, whole (push split evenly) or quarter.

    Element 0 of the array column ``pmf`` is P(X = first).
    """
    part = "abs({l} - floor({l}) - 0.25D) < 1e-9 OR abs({l} - floor({l}) - 0.75D) < 1e-9".format(l=f"({line})")
    lines = f"IF({part}, array(({line}) - 0.25D, ({line}) + 0.25D), array(CAST(({line}) AS DOUBLE)))"
    above = (f"aggregate(transform({pmf}, (p, i) -> CASE WHEN i + {first} > l THEN p WHEN i + {first} = l THEN p * 0.5D"
             f" ELSE 0D END), 0D, (s, x) -> s + x)")
    return F.expr(f"aggregate(transform({lines}, l -> {above}), 0D, (s, x) -> s + x) / size({lines})")


def handicap_home_at(margin_pmf: str, line: str) -> Column:
    """Home side of an Asian handicap: the margin must beat minus the line."""
    return over_at(margin_pmf, f"-({line})", first=-N)


def wide_book(df: DataFrame) -> DataFrame:
    """All fixed markets of a match as one row; columns are named ``market|selection``."""
    keep = [f"`{c}`" for c in df.columns]
    evens, odds = range(0, N + 1, 2), range(1, N + 1, 2)

    def vec(side, ks):
        return _sum(f"{side}{k}" for k in ks)

    rows = range(N + 1)
    v = with_goal_vectors(df).selectExpr(
        *keep,
        *[f"{total_mass(k)} AS _T{k}" for k in range(7)],
        _sum(f"h{i} * {vec('a', range(i))}" for i in range(1, N + 1)) + " + d10 AS _HW",
        f"{margin_mass(0)} AS _D0", f"{margin_mass(1)} AS _D1", f"{margin_mass(-1)} AS _Dm1",
        f"{vec('h', range(1, N + 1))} * {vec('a', range(1, N + 1))} + d11 AS _BT",
        f"{vec('h', evens)} * {vec('a', odds)} + {vec('h', odds)} * {vec('a', evens)} + d01 + d10 AS _ODD",
        f"(h0 + h1) * {vec('a', rows)} + d00 + d01 + d10 + d11 AS _HU",
        f"(a0 + a1) * {vec('h', rows)} + d00 + d01 + d10 + d11 AS _AU",
    )
    out = {
        ("1X2", "1"): "_HW", ("1X2", "X"): "_D0", ("1X2", "2"): "1D - _HW - _D0",
        ("double_chance", "1X"): "_HW + _D0", ("double_chance", "12"): "1D - _D0", ("double_chance", "X2"): "1D - _HW",
    }
    for line in LINES:
        under = _sum(f"_T{k}" for k in range(int(line) + 1))
        out[(f"over_under_{line}", "over")], out[(f"over_under_{line}", "under")] = f"1D - {under}", under
    home_side = {"0": "_HW + _D0 * 0.5D", "-0.5": "_HW", "-1": "_HW - _D1 * 0.5D", "+0.5": "_HW + _D0",
                 "+1": "_HW + _D0 + _Dm1 * 0.5D"}
    out[("btts", "yes")], out[("btts", "no")] = "_BT", "1D - _BT"
    out[("odd_even", "odd")], out[("odd_even", "even")] = "_ODD", "1D - _ODD"
    out[("goal_range", "0-1")], out[("goal_range", "2-3")] = "_T0 + _T1", "_T2 + _T3"
    out[("goal_range", "4-6")] = "_T4 + _T5 + _T6"
    out[("goal_range", "7+")] = "1D - " + _sum(f"_T{k}" for k in range(7))
    for h in HANDICAPS:
        out[(f"asian_handicap_{h}", "home")] = home_side[h]
        out[(f"asian_handicap_{h}", "away")] = f"1D - ({home_side[h]})"
    for side, under in (("home", "_HU"), ("away", "_AU")):
        out[(f"{side}_over_under_1.5", "over")], out[(f"{side}_over_under_1.5", "under")] = f"1D - {under}", under
    return v.selectExpr(*keep, *[f"{e} AS `{m}|{s}`" for (m, s), e in out.items()])


def book_columns(markets=None) -> list[tuple[str, str]]:
    """(market, selection) pairs of the wide form, in payload order."""
    pairs = [("1X2", s) for s in ("1", "X", "2")] + [("double_chance", s) for s in ("1X", "12", "X2")]
    pairs += [(f"over_under_{l}", s) for l in LINES for s in ("over", "under")]
    pairs += [("btts", "yes"), ("btts", "no"), ("odd_even", "odd"), ("odd_even", "even")]
    pairs += [("goal_range", s) for s in ("0-1", "2-3", "4-6", "7+")]
    pairs += [(f"asian_handicap_{h}", s) for h in HANDICAPS for s in ("home", "away")]
    pairs += [(f"{side}_over_under_1.5", s) for side in ("home", "away") for s in ("over", "under")]
    return pairs if markets is None else [p for p in pairs if p[0] in markets]


ENUMERATED = ["1X2", "double_chance"] + [f"over_under_{l}" for l in LINES] + ["btts", "odd_even"]


def long_book(df: DataFrame, markets=None) -> DataFrame:
    """market_probs(keys..., market, selection, prob, ord): row-local expansion of the wide form.

    An unpivot, not an exploded array: it plans as Expand, which copies no arrays and keeps the
    optimizer from carrying the long sums through every filter above it.
    """
    return unpivoted(wide_book(df), df.columns, book_columns(markets))


def unpivoted(wide: DataFrame, keys, pairs) -> DataFrame:
    names = [f"{m}|{s}" for m, s in pairs]
    rows = wide.unpivot(keys, [f"`{n}`" for n in names], "_v", "prob")
    order = "array(" + ", ".join(f"'{n}'" for n in names) + ")"
    return rows.selectExpr(*[f"`{c}`" for c in keys], "substring_index(_v, '|', 1) AS market", "substring_index(_v, '|', -1) AS selection", "prob",
                           f"CAST(array_position({order}, _v) AS INT) AS ord")


LABELS = sorted(f"{i}-{j}" for i in range(N + 1) for j in range(N + 1))
_RANK = {s: r for r, s in enumerate(LABELS)}


def top_scores(df: DataFrame, k: int = 10) -> DataFrame:
    """Add ``top``: the k likeliest scores as [(score, p)], ties to the larger label.

    Each cell is packed as probability (twelve digits) and label rank in one long, so a
    row sorts 121 plain numbers in place instead of shuffling 121 rows.
    """
    keep = [f"`{c}`" for c in df.columns]
    packed = ", ".join(f"floor(({_cell(i, j)}) * 1e12D + 0.5D) * 128 + {_RANK[f'{i}-{j}']}"
                       for i in range(N + 1) for j in range(N + 1))
    labels = "array(" + ", ".join(f"'{s}'" for s in LABELS) + ")"
    ranked = with_goal_vectors(df).selectExpr(*keep, f"slice(sort_array(array({packed}), false), 1, {k}) AS _k")
    return ranked.selectExpr(
        *keep,
        f"transform(_k, x -> struct({labels}[CAST(x % 128 AS INT)] AS score, floor(x / 128D) / 1e12D AS p)) AS top")


def cells(df: DataFrame) -> DataFrame:
    """Long score matrix (keys..., i, j, p): 121 rows per match, made inside the row.

    Home goals are expanded first, away goals second: eleven terms each, short code that the JVM compiles.
    """
    keep = [f"`{c}`" for c in df.columns]
    low = lambda i, j: f"d{i}{j}" if (i, j) in LOW else "0D"
    homes = ", ".join(f"struct({i} AS i, h{i} AS _h, {low(i, 0)} AS _d0, {low(i, 1)} AS _d1)" for i in range(N + 1))
    away = f"array({', '.join(f'a{j}' for j in range(N + 1))})"
    by_home = with_goal_vectors(df).selectExpr(*keep, f"{away} AS _a", f"inline(array({homes}))")
    return by_home.selectExpr(*keep, "i", "_h", "_d0", "_d1", "posexplode(_a) AS (j, _p)").selectExpr(
        *keep, "i", "j", "_h * _p + CASE j WHEN 0 THEN _d0 WHEN 1 THEN _d1 ELSE 0D END AS p")


def sharpened_book(df: DataFrame, t: float) -> DataFrame:
    """The long book with p^(1/t) rescaled to sum to one over each market of a ``match_id``.

    The sums run over one row a match (rows that share a match_id share them too), before the row is expanded into selections.
    """
    pairs = book_columns()
    keep = [f"`{c}`" for c in df.columns]
    # sorted while rows are narrow; the window below finds them in order
    w = wide_book(df.sortWithinPartitions("match_id")).selectExpr(*keep, *[f"pow(greatest(`{m}|{s}`, 1e-12D), 1D / {t}D) AS `{m}|{s}`" for m, s in pairs])
    by_market = {m: _sum(f"`{x}|{s}`" for x, s in pairs if x == m) for m, _ in pairs}
    w = w.selectExpr("*", *[f"sum({q}) OVER (PARTITION BY match_id) AS `{m}`" for m, q in by_market.items()])
    w = w.selectExpr(*keep, *[f"`{m}|{s}` / `{m}` AS `{m}|{s}`" for m, s in pairs])
    return unpivoted(w, df.columns, pairs)


def payload_json(df: DataFrame) -> DataFrame:
    """keys..., payload: the nested prediction document, assembled only for the sink."""
    keep = [f"`{c}`" for c in df.columns]
    w = wide_book(top_scores(df))

    def flat(market):
        return "struct(" + ", ".join(f"`{m}|{s}` AS `{s}`" for m, s in book_columns([market])) + ")"

    single = ["1X2", "double_chance", "btts", "odd_even", "goal_range"] + [f"asian_handicap_{h}" for h in HANDICAPS]
    single += [f"{s}_over_under_1.5" for s in ("home", "away")]
    parts = [f"{flat(m)} AS `{m}`" for m in single]
    lines = ", ".join(f"{flat(f'over_under_{l}')} AS `{l}`" for l in LINES)
    parts.append(f"struct({lines}) AS over_under")
    parts.append("transform(top, s -> map(s.score, s.p)) AS correct_score_top10")
    return w.selectExpr(*keep, f"to_json(struct({', '.join(parts)})) AS payload")


def payload_probs(df: DataFrame, payload: str = "payload") -> DataFrame:
    """The way back: flat numeric markets of a stored payload as long rows."""
    keep = [c for c in df.columns if c != payload]
    entries = df.select(*keep, F.explode(F.from_json(payload, "map<string,string>")).alias("market", "body"))
    # each body is parsed once (a filter on the parsed map would parse it again), lists and objects of objects not at all
    parsed = "IF(startswith(body, '{') AND (NOT contains(body, '\":{') OR contains(body, '\\\\')), from_json(body, 'map<string,double>'), NULL)"
    numeric = f"transform(array({parsed}), m -> IF(exists(map_values(m), v -> v IS NULL), NULL, m))[0]"
    return entries.selectExpr(*[f"`{c}`" for c in keep], "market", f"explode({numeric}) AS (selection, prob)")
