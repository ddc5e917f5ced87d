"""Rolling calibration: when a calibrator is refitted, which fit serves a prediction, and the calibrated values.

A group's calibrator is refitted after a prediction once ``minimum`` of its predictions are known and at least ``every``
positions of the timeline have passed since its last refit. The timeline may be the group's own or one that all groups share,
and predictions may be missing on it, so the refits form a chain. Blocks of the timeline are followed side by side for
every state that can enter them (at most ``every``), the short list of blocks is composed per group, and the blocks are read once
more with their true entry. So no task holds more than one block of predictions, or one row per block and state.
"""
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from touchline.operators.calibrate import log_probabilities, temperatures_of

MINIMUM, EVERY, WINDOW = 100, 50, 500
BLOCK = 16_384  # positions of the timeline in a block, more than EVERY


def _chain(x: np.ndarray, every: int) -> np.ndarray:
    """For each possible refit at x[i] the next one it allows."""
    return np.searchsorted(x, x + every)


def refits(preds: DataFrame, group, seq: str, clock: str, minimum: int = MINIMUM, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """``preds`` with ``serves`` (number of the newest fit before the prediction, null before the first) and ``refit`` (fitted right after it).

    ``seq`` numbers a group's predictions from 0, ``clock`` is their position on the timeline, strictly rising with ``seq``.
    Fits of a group are numbered from 0.
    """
    group = [group] if isinstance(group, str) else list(group)
    if block < every:
        raise ValueError("a block holds at least the distance between two refits")
    types, columns = dict(preds.dtypes), preds.columns
    named = ", ".join(f"{g} {types[g]}" for g in group)
    rows = preds.withColumn("_block", F.floor(F.col(clock) / F.lit(block)).cast("long"))

    def states(key, pdf):
        """One row per run of entry states with the same outcome: refits allowed from ``wait`` positions into the block."""
        x = np.sort(pdf[clock].to_numpy(np.int64))
        start, follow = int(key[-1]) * block, _chain(x, every)
        last, count = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for i in range(len(x) - 1, -1, -1):
            j = follow[i]
            last[i], count[i] = (x[i], 1) if j == len(x) else (last[j], count[j] + 1)
        first = np.searchsorted(x, start + np.arange(every))
        out = []
        for wait in np.flatnonzero(np.append(True, first[1:] != first[:-1])).tolist():
            i = first[wait]
            out.append((*key, wait, None if i == len(x) else int(last[i]) + every, 0 if i == len(x) else int(count[i])))
        return pd.DataFrame(out, columns=[*group, "_block", "wait", "free", "n"]).astype({"free": "Int64"})

    def compose(key, pdf):
        pdf = pdf.sort_values(["_block", "wait"])
        free, before, out = 0, 0, []
        for b, one in pdf.groupby("_block", sort=True):
            wait = min(max(0, free - int(b) * block), every - 1)
            out.append((*key, int(b), wait, before))
            row = one[one.wait <= wait].iloc[-1]
            before += int(row.n)
            free = free if pd.isna(row.free) else int(row.free)
        return pd.DataFrame(out, columns=[*group, "_block", "wait", "before"])

    ready = rows.filter(F.col(seq) >= minimum - 1).select(*group, "_block", clock)
    tables = ready.groupBy(*group, "_block").applyInPandas(states, f"{named}, _block long, wait long, free long, n long")
    entry = tables.groupBy(*group).applyInPandas(compose, f"{named}, _block long, wait long, before long")

    def read(key, table):
        order = np.argsort(table[clock].to_numpy(), kind="stable")
        table = table.take(pa.array(order))
        x, able = table[clock].to_numpy().astype(np.int64), table[seq].to_numpy() >= minimum - 1
        ready_at = np.flatnonzero(able)
        fit = np.zeros(len(x), bool)
        if len(ready_at):
            follow = _chain(x[ready_at], every)
            i = int(np.searchsorted(x[ready_at], key[-1].as_py() * block + table["wait"][0].as_py()))
            while i < len(ready_at):
                fit[ready_at[i]] = True
                i = int(follow[i])
        serves = table["before"][0].as_py() + np.cumsum(fit) - fit - 1
        table = table.select(columns)
        return table.append_column("serves", pa.array(serves, pa.int64(), mask=serves < 0)).append_column("refit", pa.array(fit))

    # a block before the group's first possible refit has no entry and serves nothing
    opened = rows.join(entry, [*group, "_block"], "left").fillna({"wait": 0, "before": 0})
    schema = StructType([*preds.schema.fields, StructField("serves", LongType()), StructField("refit", BooleanType())])
    # Arrow tables, so columns that only pass through are never made into Python objects
    return opened.select(*columns, "_block", "wait", "before").groupBy(*group, "_block").applyInArrow(read, schema)


def training_rows(marked: DataFrame, group, seq: str, window: int = WINDOW) -> DataFrame:
    """(group..., fit, and the columns of ``marked``): the last ``window`` predictions of every fit, its own included.

    Predictions are met by stretches of ``window`` of them, so a fit reads two stretches and the join stays a hash join.
    """
    group = [group] if isinstance(group, str) else list(group)
    fits = marked.filter("refit").select(*group, F.expr("coalesce(serves + 1, 0L) AS fit"), F.col(seq).alias("_to"))
    fits = fits.withColumn("_part", F.explode(F.expr(f"array_distinct(array(_to DIV {window}, greatest(_to - {window - 1}, 0) DIV {window}))")))
    rows = marked.withColumn("_part", F.expr(f"{seq} DIV {window}"))
    met = rows.join(fits, [*group, "_part"]).filter((F.col(seq) <= F.col("_to")) & (F.col(seq) > F.col("_to") - window))
    return met.select(*group, "fit", *[c for c in marked.columns if c not in group])


def temperatures(marked: DataFrame, group, seq: str, window: int = WINDOW) -> DataFrame:
    """(group..., market, fit, T, n) from rows with ``books``: an array of (market, p: probabilities, y: number of the true one, from 1).

    A fit's rows are those of ``training_rows``. A task holds the fits of one stretch of ``window`` predictions, with these and
    the stretch before, so a row is sent twice whatever the number of fits, and all fits of a stretch are solved side by side.
    """
    group = [group] if isinstance(group, str) else list(group)
    types = dict(marked.dtypes)
    schema = pa.schema([(c, t) for c, t in zip([*group, "market", "fit", "T", "n"], [*(to_arrow_type(marked.schema[g].dataType) for g in group), pa.string(), pa.int64(), pa.float64(), pa.int64()])])

    def solve(key, table):
        table = table.take(pa.array(np.argsort(table[seq].to_numpy(), kind="stable"))).combine_chunks()
        at, stretch = table[seq].to_numpy().astype(np.int64), key[-1].as_py()
        ends = np.flatnonzero(table["refit"].to_numpy(zero_copy_only=False).astype(bool) & (at // window == stretch))
        if not len(ends):
            return schema.empty_table()
        fit, out = [0 if x is None else x + 1 for x in table["serves"].take(pa.array(ends)).to_pylist()], []
        books = table["books"].combine_chunks()
        books = books.chunk(0) if isinstance(books, pa.ChunkedArray) else books
        of = np.repeat(np.arange(len(at)), np.diff(books.offsets.to_numpy()))
        flat = books.flatten()
        names, p, y = flat.field("market"), flat.field("p"), flat.field("y").to_numpy(zero_copy_only=False).astype(np.int64)
        codes = names.dictionary_encode()
        size, values = np.diff(p.offsets.to_numpy()), p.flatten().to_numpy(zero_copy_only=False)
        first = np.append(0, np.cumsum(size))[:-1]
        for m, market in enumerate(codes.dictionary.to_pylist()):
            mine = np.flatnonzero(codes.indices.to_numpy(zero_copy_only=False) == m)
            slot = np.arange(size[mine].max())
            logs = log_probabilities(values, first[mine][:, None] + slot, slot < size[mine][:, None])
            true, pos = logs[np.arange(len(mine)), y[mine] - 1], at[of[mine]]
            lo, hi = np.searchsorted(pos, at[ends] - window, "right"), np.searchsorted(pos, at[ends], "right")
            pick = lo[:, None] + np.arange((hi - lo).max())
            use = pick < hi[:, None]
            pick = np.where(use, pick, 0)
            t = temperatures_of(logs[pick], true[pick], use)
            out += [(market, f, float(v), int(n)) for f, v, n in zip(fit, t, hi - lo) if n]
        cols = [pa.array([k.as_py()] * len(out), schema.field(i).type) for i, k in enumerate(key[:-1])]
        return pa.Table.from_arrays([*cols, *(pa.array([r[i] for r in out], schema.field(len(group) + i).type) for i in range(4))], schema=schema)

    rows = marked.select(*group, seq, "serves", "refit", "books").dropna(subset=group)
    rows = rows.withColumn("_part", F.explode(F.expr(f"array_distinct(array({seq} DIV {window}, ({seq} + {window - 1}) DIV {window}))")))
    named = ", ".join(f"`{g}` {types[g]}" for g in group)
    return rows.groupBy(*group, "_part").applyInArrow(solve, f"{named}, market string, fit long, T double, n long")


def calibrated(marked: DataFrame, fits: DataFrame, group, market: str = "market") -> DataFrame:
    """Replace ``p`` by p^(1/T), rescaled to sum to one, under the fit that serves the row; rows before the first fit keep it.

    An as-of join by position that needs no range: each row already names the fit that serves it.
    """
    group = [group] if isinstance(group, str) else list(group)
    t = fits.select(*group, market, F.col("fit").alias("serves"), "T")
    q = marked.join(t, [*group, market, "serves"], "left").withColumn("_q", F.expr("transform(p, x -> pow(greatest(x, 1e-12D), 1D / T))"))
    return q.withColumn("p", F.expr("IF(T IS NULL, p, transform(_q, x -> x / aggregate(_q, 0D, (s, y) -> s + y)))")).select(*marked.columns, "T")
