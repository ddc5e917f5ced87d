"""Coupons: composer, fallback, singles, hit-probability variants, signatures, settlement.

The composer and the fallback run in ranked rounds: one row per day says what the day's coupon in hand still
needs, and a round finds the best pick that meets it as one grouped minimum over all picks. Days advance
together, a day's picks are never gathered, and no pick is left out.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.operators.picks import best_per_match
from touchline.session import stored

# The variants' least combined probability and odds window.
VARIANTS = [("safe", 0.60, 1.40, 2.20), ("balanced", 0.40, 2.20, 3.50), ("bold", 0.20, 3.50, 6.00)]
_LEG = "struct(match_id, market, selection, ord, base, prob, odds, composite)"
_BEST_FIRST = "struct(-round(composite, 9), match_id, ord)"
_LONGEST_FIRST = "struct(-round(odds, 9), synthetic, -round(composite, 9), match_id)"
_PRICE = "aggregate({0}, 1D, (p, l) -> p * l.odds)"
_SHORTEST = "array_position(transform(legs, l -> l.odds), array_min(transform(legs, l -> l.odds)))"
ROUNDS_A_TABLE = 4   # rounds planned as one job before the state is stored
_STATE = ["size", "least_size", "legs", "taken", "found", "swaps", "done"]


def _round(picks: DataFrame, state: DataFrame, floor: float, coupons: int, diverse: bool, shrink: bool) -> DataFrame:
    """One step of every open day.

    A coupon short of legs takes the best pick of a free match (and family); a full one below the price floor
    replaces its shortest price by the best pick that is longer. No such pick, or as many replacements as legs
    where sizes may ``shrink``: the coupon is given up and the next smaller one is tried.

    The state rides along with the picks it meets and comes back out of the same aggregate, so a round is one
    join and one grouped minimum, and rounds planned together stay a chain. Every day has a pick, so none is lost.
    """
    rivals = f"IF(full, filter(legs, (l, i) -> i <> {_SHORTEST} - 1), legs)" if diverse else "filter(legs, l -> FALSE)"
    need = state.withColumn("full", F.expr("size(legs) = size")).selectExpr(
        "day", "done", f"struct({', '.join(_STATE)}) AS state", "concat(taken, transform(legs, l -> l.match_id)) AS barred", f"transform({rivals}, l -> l.base) AS families",
        "IF(full, array_min(transform(legs, l -> l.odds)), 0D) AS above")
    fits = "NOT done AND pick.odds > above AND NOT array_contains(barred, pick.match_id) AND NOT array_contains(families, pick.base)"
    best = picks.join(need, "day").groupBy("day").agg(F.first("state").alias("state"), F.expr(f"min_by(pick, IF({fits}, rank, NULL)) AS pick"))
    new = best.selectExpr("day", "pick", "state.*").withColumn("hand", F.expr(
        f"CASE WHEN pick IS NULL THEN legs WHEN size(legs) < size THEN concat(legs, array(pick)) ELSE transform(legs, (l, i) -> IF(i = {_SHORTEST} - 1, pick, l)) END"))
    new = new.withColumn("turns", F.expr("swaps + IF(pick IS NOT NULL AND size(legs) = size, 1, 0)")) \
        .withColumn("made", F.expr(f"NOT done AND pick IS NOT NULL AND size(hand) = size AND {_PRICE.format('hand')} >= {floor}D"))
    given_up = "pick IS NULL" + (" OR (size(hand) = size AND turns >= size)" if shrink else "")
    new = new.withColumn("lost", F.expr(f"NOT done AND NOT made AND ({given_up})"))
    after = "size - IF(lost, 1, 0)"
    return new.selectExpr("day", f"{after} AS size", "least_size", "IF(made OR lost, filter(hand, l -> FALSE), hand) AS legs",
                          "IF(made, concat(taken, transform(hand, l -> l.match_id)), taken) AS taken", "IF(made, concat(found, array(hand)), found) AS found",
                          "IF(made OR lost, 0, turns) AS swaps", f"done OR size(found) + IF(made, 1, 0) >= {coupons} OR {after} < least_size AS done")


def _rounds(picks: DataFrame, state: DataFrame, rank: str, **how) -> DataFrame:
    """Rounds until no day is open; every round either adds or replaces a leg or ends a try, so they end."""
    picks, state = stored(picks.selectExpr("day", f"{_LEG} AS pick", f"{rank} AS rank")), stored(state)
    closed = state.filter("done")
    while not state.filter("NOT done").isEmpty():
        state = state.filter("NOT done")
        for _ in range(ROUNDS_A_TABLE):
            state = _round(picks, state, **how)
        state = stored(state)
        closed = closed.unionByName(state.filter("done"))
    return closed


def _legs_of(state: DataFrame, kind: str) -> DataFrame:
    coupons = state.select("day", F.posexplode("found").alias("c", "coupon"))
    return coupons.select("day", "c", F.posexplode("coupon").alias("i", "l")).selectExpr(
        "day", f"{kind} AS kind", "c + 1 AS coupon_no", "i + 1 AS leg_no", "l.match_id", "l.market", "l.selection", "l.prob", "l.odds", "l.composite")


def compose(picks: DataFrame, *, num_legs: int = 3, min_legs: int = 1, max_legs: int = 4, max_coupons: int = 5,
            min_odds: float = 1.6, diverse: bool = True) -> DataFrame:
    """Coupons per ``day``, best picks first: primary, then alternatives, no match used twice.

    Leg counts go from the wanted size down; a size stops at the first coupon that is not
    found or stays under the price floor.
    """
    top, least = min(num_legs, max_legs), max(min_legs, 1)
    state = picks.groupBy("day").agg(F.expr(f"filter(array(any_value({_LEG})), l -> FALSE) AS legs")).selectExpr(
        "day", f"{top} AS size", f"{least} AS least_size", "legs", "transform(legs, l -> l.match_id) AS taken", "filter(array(legs), x -> FALSE) AS found", "0 AS swaps",
        f"{top} < {least} AS done")
    done = _rounds(picks, state, _BEST_FIRST, floor=min_odds, coupons=max_coupons, diverse=diverse, shrink=True)
    return _legs_of(done, "IF(c = 0, 'primary', 'alternative')")


def fallback(picks: DataFrame, *, num_legs: int = 3, min_legs: int = 1, min_odds: float = 1.6) -> DataFrame:
    """One coupon per day without an edge gate: best pick per match, real prices first.

    While the price floor is missed, the shortest price is swapped for the longest unused one;
    a day that cannot reach the floor gets no coupon.
    """
    best = best_per_match(picks)
    order = Window.partitionBy("day").orderBy("synthetic", F.round("composite", 9).desc(), "match_id")
    first = best.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max(min_legs, num_legs))
    hand = first.groupBy("day").agg(F.expr(f"transform(array_sort(collect_list(struct(r, {_LEG} AS l))), x -> x.l) AS legs"))
    good = f"{_PRICE.format('legs')} >= {min_odds}D"
    state = hand.selectExpr("day", "size(legs) AS size", "size(legs) AS least_size", "legs", "filter(transform(legs, l -> l.match_id), x -> FALSE) AS taken",
                            f"IF({good}, array(legs), filter(array(legs), x -> FALSE)) AS found", "0 AS swaps", f"{good} AS done")
    done = _rounds(best, state, _LONGEST_FIRST, floor=min_odds, coupons=1, diverse=False, shrink=False)
    return _legs_of(done, "'fallback'")


def suggest(strict: DataFrame, open_picks: DataFrame, *, num_legs: int = 3, min_legs: int = 1, max_legs: int = 4,
            max_coupons: int = 5, min_odds: float = 1.6, diverse: bool = True) -> DataFrame:
    """Composed coupons, and a fallback for the days that got none."""
    main = compose(strict, num_legs=num_legs, min_legs=min_legs, max_legs=max_legs, max_coupons=max_coupons, min_odds=min_odds, diverse=diverse)
    rest = open_picks.join(main.select("day").distinct(), "day", "left_anti")
    return main.unionByName(fallback(rest, num_legs=num_legs, min_legs=min_legs, min_odds=min_odds))


def singles(picks: DataFrame, top: int = 5) -> DataFrame:
    """The best single of each of the ``top`` matches by composite."""
    return best_per_match(picks).orderBy(F.round("composite", 9).desc(), "match_id").limit(top)


VARIANT_SCHEMA = "day string, variant string, ids array<long>, combined_prob double, combined_odds double, proven boolean"


def likeliest(prob: np.ndarray, odds: np.ndarray, family: np.ndarray, legs: int, least: float, lo: float, hi: float):
    """Rows of the likeliest combination of different families inside the odds window, and its probability; (None, 0) without one.

    Rows come likeliest first, prices are at least 1. Partial combinations grow one leg at a time and stop where
    even the likeliest rows could not bring them to ``least``, or where they are already too long.
    """
    combo = np.arange(len(prob))[:, None]
    p, o = prob.copy(), odds.copy()
    for size in range(1, legs):
        ahead = p * prob[0] ** (legs - size) >= least - 2e-9
        combo, p, o = combo[ahead & (o <= hi)], p[ahead & (o <= hi)], o[ahead & (o <= hi)]
        many = len(prob) - 1 - combo[:, -1]
        row = np.repeat(np.arange(len(combo)), many)
        nxt = combo[row, -1] + 1 + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        new = (family[combo[row]] != family[nxt][:, None]).all(axis=1)
        row, nxt = row[new], nxt[new]
        combo, p, o = np.column_stack([combo[row], nxt]), p[row] * prob[nxt], o[row] * odds[nxt]
    ok = (o >= lo) & (o <= hi) & (p >= least)
    if not ok.any():
        return None, 0.0
    best = int(np.argmax(np.where(ok, p.round(12), -1.0)))
    return combo[best], float(p[best])


def _search(limit: int, num_legs: int, variants):
    """One day's variants over its ``limit`` likeliest matches, or a row that says more are needed."""
    columns = [c.split()[0] for c in VARIANT_SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.list_(pa.int64()), pa.float64(), pa.float64(), pa.bool_()]

    def table(rows):
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=columns)

    def one_day(key, day):
        order = np.argsort(day["rn"].to_numpy(), kind="stable")
        prob, odds, ids = (day[c].to_numpy()[order] for c in ("prob", "odds", "match_id"))
        name_of_day = key[0].as_py()
        beyond = float(prob[limit]) if len(order) > limit else 0.0
        prob, odds, ids = prob[:limit].astype(float), odds[:limit].astype(float), ids[:limit]
        family = np.unique(day["base"].to_numpy().astype(str), return_inverse=True)[1][order[:limit]]
        free, out = np.ones(len(ids), bool), []
        for name, least, lo, hi in variants:
            rows = np.flatnonzero(free)
            combo, p = likeliest(prob[rows], odds[rows], family[rows], num_legs, least, lo, hi) if len(rows) >= num_legs else (None, 0.0)
            reach = beyond * (prob[rows[0]] if len(rows) else 1.0) ** (num_legs - 1)
            if beyond and reach >= least - 2e-9 and reach >= p - 2e-9:
                return table([(name_of_day, None, None, None, None, False)])
            if combo is not None:
                at = rows[combo]
                free[at] = False
                out.append((name_of_day, name, ids[at].tolist(), p, float(odds[at].prod()), True))
        return table(out)

    return one_day


def hit_variants(picks: DataFrame, num_legs: int = 2, variants=VARIANTS, first: int = 60) -> DataFrame:
    """Likeliest leg combination inside each odds window, per day, no match in two variants; all of a day's matches count.

    A day is searched over its ``first`` likeliest matches, one pick each. The answer is proven when no combination with
    a match beyond these can be likelier, or reach the variant's least probability; days without
    that proof are searched again over twice as many.
    """
    by_prob = Window.partitionBy("day").orderBy(F.round("prob", 9).desc(), "match_id")
    ranked = stored(best_per_match(picks).withColumn("rn", F.row_number().over(by_prob)).select("day", "rn", "match_id", "base", "prob", "odds"))
    # a fixed partition count keeps small tables from being packed into one Python worker
    parts = int(picks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers, left, limit = None, ranked, first
    while True:
        answers_of = _search(limit, num_legs, variants)
        found = stored(left.filter(F.col("rn") <= limit + 1).repartition(parts, "day").groupBy("day").applyInArrow(answers_of, VARIANT_SCHEMA))
        answers = found if answers is None else answers.unionByName(found)
        again = found.filter("NOT proven").select("day").distinct()
        if again.isEmpty():
            return answers.filter("proven").drop("proven")
        left, limit = stored(left.join(again, "day")), 2 * limit


def signature(legs: str = "legs") -> str:
    """SQL text: stable coupon signature from an array of (match_id, market, selection)."""
    text = f"array_sort(transform({legs}, l -> concat(l.match_id, '|', l.market, '|', l.selection)))"
    return f"substr(sha2(array_join({text}, '||'), 256), 1, 32)"


def coupon_headers(legs: DataFrame, keys=("day", "kind", "coupon_no")) -> DataFrame:
    """Combined probability and odds (missing price counts as 1/prob), mean score, signature."""
    price = F.coalesce("odds", F.lit(1.0) / F.col("prob"))
    return legs.groupBy(*keys).agg(
        F.count("*").alias("num_legs"), F.product("prob").alias("combined_prob"), F.product(price).alias("combined_odds"),
        F.avg("composite").alias("avg_composite"),
        F.expr(signature("collect_list(struct(match_id, market, selection))")).alias("signature"))


def settle_coupons(legs: DataFrame, key="coupon_id") -> DataFrame:
    """(coupon, legs, open legs, hit): null while a leg is open, else whether all legs hit."""
    return legs.groupBy(key).agg(
        F.count("*").alias("num_legs"), F.count_if(F.col("hit").isNull()).alias("open_legs"),
        F.expr("IF(count_if(hit IS NULL) = 0, bool_and(hit), NULL)").alias("hit"))


def history_summary(coupons: DataFrame) -> DataFrame:
    """Totals, win rate and flat-stake ROI; null rates when nothing is settled."""
    return coupons.agg(*[F.expr(x) for x in (
        "count(*) AS total", "count_if(hit IS NOT NULL) AS settled", "count_if(hit IS NULL) AS pending",
        "count_if(hit) AS won", "count_if(NOT hit) AS lost",
        "try_divide(count_if(hit), count_if(hit IS NOT NULL)) AS win_rate",
        "try_divide(sum(CASE WHEN combined_odds IS NULL OR hit IS NULL THEN 0D WHEN hit THEN combined_odds - 1D ELSE -1D END),"
        " count_if(hit IS NOT NULL AND combined_odds IS NOT NULL)) AS roi")])


def notifications(coupons: DataFrame) -> DataFrame:
    """One message row per closed coupon."""
    odds = "IF(combined_odds IS NULL OR combined_odds = 0, '—', format_string('%.2fx', combined_odds))"
    return coupons.filter("hit IS NOT NULL").selectExpr(
        "coupon_id", f"IF(hit, concat('✅ Kupon TUTTU — ', {odds}), concat('❌ Kupon yatti — ', {odds})) AS title",
        "IF(hit, concat(num_legs, ' bacaklı kupon kazandı. İstatistiklere bak.'), concat(num_legs, ' bacaklı kupon kaybetti.')) AS body",
        "concat('coupon-', coupon_id) AS tag", "'/istatistikler' AS url")
