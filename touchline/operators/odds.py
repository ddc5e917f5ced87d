"""Price series: one best or latest price per selection, margins, probability-price joins."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.functions import naming
from touchline.operators import markets as mk

# Which bookmaker's price counts first.
API_PRIORITY = ["B365C", "PSC", "B365", "PS", "WH"]
CLOSING_PRIORITY = ["B365C", "PSC", "BFEC", "B365", "PS", "WH", "AvgC", "MaxC", "Avg", "Max"]
OPENING_PRIORITY = ["B365", "PS", "WH", "Avg", "Max", "B365C", "PSC", "BFEC", "AvgC", "MaxC"]
# Selections a market must price before its margin can be taken out.
EXPECTED_SELECTIONS = {"1X2": 3, "double_chance": 3, "btts": 2}


def best_prices(odds: DataFrame, priority=API_PRIORITY, tie: str = "last") -> DataFrame:
    """(match_id, market, selection, odds): the most trusted source wins.

    One conditional max_by per listed source keeps this a hash aggregate with a map-side
    combine, so a match that holds a large share of the price rows shrinks before the shuffle.
    Ties inside a source go to the last row (``tie="last"``) or the first.
    """
    pick = F.max_by if tie == "last" else F.min_by
    src = F.col("source")
    ranked = [
        pick(F.when(src == s, F.col("decimal_odds")), F.when(src == s, F.col("odds_id"))) for s in priority
    ]
    other = ~src.isin(priority)
    ranked.append(pick(F.when(other, F.col("decimal_odds")), F.when(other, F.col("odds_id"))))
    return (
        odds.withColumn("market", naming.price_market(F.col("market")))
        .groupBy("match_id", "market", "selection")
        .agg(F.coalesce(*ranked).alias("odds"))
    )


def priced_markets(odds: DataFrame) -> list[str]:
    """The modelled markets that have a price at all: a handful of names, so only these are expanded."""
    found = {r["market"] for r in odds.select(naming.price_market(F.col("market")).alias("market")).distinct().collect()}
    return sorted(found & {m for m, _ in mk.book_columns()})


def latest_prices(odds: DataFrame) -> DataFrame:
    """The newest price of each selection, whatever its source."""
    return (
        odds.withColumn("market", naming.price_market(F.col("market")))
        .groupBy("match_id", "market", "selection")
        .agg(F.max_by("decimal_odds", F.struct("fetched_at", "odds_id")).alias("odds"))
    )


def expected_count(market: Column) -> Column:
    return F.coalesce(naming.lookup(market, EXPECTED_SELECTIONS), F.lit(2))


def price_lists(best: DataFrame, markets=None, borrow: bool = False) -> DataFrame:
    """(match_id, prices): the prices of a match as one row, from one price row per selection as ``best_prices`` gives them.

    ``prices`` holds odds and margin by the selection's place in ``book_columns(markets)``, and in the bits of ``has`` which places have a
    price row. A margin is the sum of 1/odds of the market, 1.0 unless every selection is priced; with ``borrow`` a double
    chance without its own takes two thirds of the 1X2 margin. Every part is a plain hash aggregate, so nothing is sorted or collected.
    """
    pairs = mk.book_columns(markets)
    names = list(dict.fromkeys(["1X2", *(m for m, _ in pairs)]))
    listed = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    known = best.filter(F.col("match_id").isNotNull() & F.col("market").isin(names)).selectExpr(
        "match_id", "odds", f"CAST(array_position({listed(names)}, market) AS INT) AS m",
        f"CAST(coalesce(array_position({listed(f'{m}|{s}' for m, s in pairs)}, concat(market, '|', selection)), 0) AS INT) AS pos")
    sums = [F.expr(x) for i in range(1, len(names) + 1) for x in (
        f"count_if(m = {i} AND odds > 0) AS _n{i}", f"sum(IF(m = {i} AND odds > 0, 1D / odds, NULL)) AS _s{i}")]
    odds = [F.expr(f"max(IF(pos = {k}, odds, NULL)) AS _o{k}") for k in range(1, len(pairs) + 1)]
    per = known.groupBy("match_id").agg(F.expr("bit_or(IF(pos > 0, shiftleft(1L, pos - 1), 0L)) AS has"), F.expr("count_if(m = 1) AS _one"), *odds, *sums)
    margin = {n: f"IF(_n{i} >= {EXPECTED_SELECTIONS.get(n, 2)}, _s{i}, 1D)" for i, n in enumerate(names, 1)}
    if borrow and "double_chance" in margin:
        own = margin["double_chance"]
        margin["double_chance"] = f"IF({own} = 1D, IF(_one > 0, {margin['1X2']} * 2 / 3, 1D), {own})"
    return per.selectExpr("match_id", f"struct(has, array({', '.join(f'_o{k}' for k in range(1, len(pairs) + 1))}) AS odds,"
                                      f" array({', '.join(margin[m] for m, _ in pairs)}) AS margin) AS prices")


def with_prices(matches: DataFrame, best: DataFrame, markets=None, how: str = "inner", borrow: bool = False) -> DataFrame:
    """Rows of a match with its prices, joined before the rows are expanded into selections: one narrow row a match is sorted."""
    return matches.join(price_lists(best, markets, borrow), "match_id", how)


def overrounds(best: DataFrame) -> DataFrame:
    ok = F.count(F.when(F.col("odds") > 0, 1)) >= expected_count(F.col("market"))
    return best.groupBy("match_id", "market").agg(
        F.when(ok, F.sum(F.lit(1.0) / F.col("odds"))).otherwise(F.lit(1.0)).alias("overround"))


def double_chance_overround(overround: DataFrame) -> DataFrame:
    """A double chance without own prices borrows two thirds of the 1X2 margin."""
    one = overround.filter(F.col("market") == "1X2")
    return one.select(
        "match_id", F.lit("double_chance").alias("market"),
        F.when(F.col("overround") == 0, 1.0).otherwise(F.col("overround") * 2 / 3).alias("overround"))


def priced(probs: DataFrame, how: str = "inner") -> DataFrame:
    """Selections (long rows that carry ``prices`` and ``ord``) with odds and overround of their price; ``left`` keeps those without one."""
    keep = [f"`{c}`" for c in probs.columns if c != "prices"]
    has = "(shiftright(prices.has, ord - 1) & 1L) = 1L"
    rows = probs if how == "left" else probs.filter(has)
    return rows.selectExpr(*keep, f"IF({has}, prices.odds[ord - 1], NULL) AS odds", f"IF({has}, prices.margin[ord - 1], NULL) AS overround")
