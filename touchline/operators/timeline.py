"""Row numbers on a timeline without sorting it in one task, and walk-forward folds."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.session import stored

RANGE_ROWS = 1 << 20  # rows of one second that are ranked in one task


def _range_of(key: str, cuts):
    """How many cuts lie at or below the key: a balanced CASE."""
    def between(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col(key) < F.lit(cuts[m]), between(a, m)).otherwise(between(m + 1, b))

    return between(0, len(cuts))


def with_row_index(df: DataFrame, time: str, key: str, group=None, name: str = "idx") -> DataFrame:
    """0-based position in (time, key) order, overall or per ``group``.

    Rows are ranked inside (group, day, second, key range); these are counted in one pass and turned into offsets:
    ranges inside a day, days on the calendar. Where a second holds more than RANGE_ROWS rows, the ranges are cut
    at quantiles of the key, so no task sorts much more than that. ``time`` is whole seconds wherever that happens.
    """
    group = [] if group is None else [group] if isinstance(group, str) else list(group)
    x = df.withColumns({"_day": F.to_date(time), "_sec": F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time), "_b": F.lit(0)})
    part = [*group, "_day", "_sec", "_b"]
    counts = stored(x.groupBy(*part).agg(F.count("*").alias("_n")))
    most = counts.agg(F.max("_n").alias("n")).first()["n"] or 0
    if most > RANGE_ROWS:
        n = 2 * -(-most // RANGE_ROWS)
        found = df.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10000).alias("cuts")).first()
        x = x.withColumn("_b", _range_of(key, sorted(set(found["cuts"] or []))))
        counts = stored(x.groupBy(*part).agg(F.count("*").alias("_n")))
    day_n = counts.groupBy(*group, "_day").agg(F.sum("_n").alias("_dn"))
    by_day = Window.partitionBy(*group).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    day_off = day_n.select(*group, "_day", F.coalesce(F.sum("_dn").over(by_day), F.lit(0)).alias("_doff"))
    in_day = Window.partitionBy(*group, "_day").orderBy("_sec", "_b").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(*part, F.coalesce(F.sum("_n").over(in_day), F.lit(0)).alias("_boff")).join(day_off, [*group, "_day"])
    pos = F.row_number().over(Window.partitionBy(*part).orderBy(time, key))
    ranked = x.withColumn("_rn", pos).join(off, part)
    return ranked.select(*df.columns, (F.col("_doff") + F.col("_boff") + F.col("_rn") - 1).cast("long").alias(name))


def fold_of(index: str, min_train: int, refit_every: int) -> str:
    """SQL text: the fit that serves row ``index``; -1 for rows that only train."""
    return f"IF({index} < {min_train}, -1L, CAST(floor(({index} - {min_train}) / {refit_every}D) AS BIGINT))"


def sample_every(df: DataFrame, index: str, k: int) -> DataFrame:
    """Deterministic 1-in-K sample by position."""
    return df.filter(F.col(index) % k == 0)
