"""Settlement of selections and the labels of what really happened."""
from pyspark.sql import Column
from pyspark.sql import functions as F


def result_1x2(fh: Column, fa: Column) -> Column:
    return F.when(fh > fa, "1").when(fh < fa, "2").otherwise("X")



def line_of(market: Column) -> Column:
    """Goal line carried by an over/under market name; null when there is none."""
    text = F.regexp_extract(market, r"^over_under_(-?[0-9]+(?:\.[0-9]+)?)$", 1)
    return F.when(text != "", text.cast("double"))


def hit(market: Column, selection: Column, fh: Column, fa: Column, push: str = "under") -> Column:
    """True/false for a played match, null for an unplayed one, false for an unknown market.

    ``push`` says what a whole-number total that lands on its line settles to: the
    default counts it as under, ``"null"`` leaves it open.
    """
    r = result_1x2(fh, fa)
    total = fh + fa
    line = line_of(market)
    both = (fh > 0) & (fa > 0)
    ou = F.when(total > line, selection == "over").otherwise(selection == "under")
    if push == "null":
        ou = F.when(total != line, ou)
    settled = (
        F.when(market == "1X2", selection == r)
        .when(market == "double_chance", selection.contains(r) & selection.isin("1X", "12", "X2"))
        .when(line.isNotNull(), ou)
        .when(market == "btts", F.when(both, selection == "yes").otherwise(selection == "no"))
        .when(market == "odd_even", selection == F.when(total % 2 == 1, "odd").otherwise("even"))
        .when(market == "correct_score", selection == F.concat_ws("-", fh.cast("string"), fa.cast("string")))
        .otherwise(False)
    )
    return F.when(fh.isNotNull() & fa.isNotNull(), settled)


def actual_label(market: Column, fh: Column, fa: Column) -> Column:
    """The outcome text per market; a double chance has two winners, joined by a slash."""
    total = fh + fa
    r = result_1x2(fh, fa)
    dc = F.when(r == "1", "12/1X").when(r == "2", "12/X2").otherwise("1X/X2")
    return (
        F.when(market == "1X2", r)
        .when(market == "double_chance", dc)
        .when(line_of(market).isNotNull(), F.when(total > line_of(market), "over").otherwise("under"))
        .when(market == "btts", F.when((fh > 0) & (fa > 0), "yes").otherwise("no"))
        .when(market == "odd_even", F.when(total % 2 == 1, "odd").otherwise("even"))
        .when(market == "correct_score", F.concat_ws("-", fh.cast("string"), fa.cast("string")))
    )


def pnl(is_hit: Column, odds: Column) -> Column:
    return F.when(is_hit, odds - F.lit(1.0)).otherwise(F.lit(-1.0))
