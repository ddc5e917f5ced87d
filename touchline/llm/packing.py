"""Sequence packing: Martello-Toth dominance reduction on the length histogram, then best fit for the rest.

Lengths are integers up to the capacity, so the instance is its histogram: at most ``capacity`` numbers
for any corpus. The packing is planned on counts (classes of equal bins), then every document finds its
place by its rank among those of equal length. Ranks come from counts of hashed shards, so no length,
however common, meets in one task.

Reduction, for the longest length s still there and the room r = capacity - s:
- nothing left fits into r: the bins {s} dominate every alternative and are fixed;
- the longest k that fits is exactly r: {s, k} dominates, since whatever else stood beside s fits where k stood;
- no two of the shortest fit together into r: beside s stands at most one more, and {s, k} with the
  longest such k dominates.
Every fixed set leaves an instance whose optimum is smaller by just the bins fixed.

Edge cases: a null text is empty and has the single token id 0; repeated rows are packed each; ties are
broken by doc_id and piece; an empty table packs to an empty one; a null doc_id is kept as null.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of, settled, written
from touchline.llm.wordids import WordIds

CAPACITY = 2048
END = 0
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, tuple[tuple[int, int], ...]]], dict[int, int]]:
    """Fixed bins as (how many, ((length, how many in a bin), ...)), and the counts that remain."""
    left = np.zeros(capacity + 2, np.int64)
    for s, n in counts.items():
        left[s] += n
    fixed = []
    for s in range(capacity, 0, -1):
        while left[s]:
            room = capacity - s
            here = np.flatnonzero(left[:room + 1])
            if room and s <= room and left[s] == 1:  # itself is no partner
                here = here[here != s]
            if not len(here):
                fixed.append((int(left[s]), ((s, 1),)))
                left[s] = 0
                break
            k = int(here[-1])
            low = int(here[0])
            used = left[low] - (low == s)  # one of s stands in the bin already
            two = 2 * low if used > 1 else low + (int(here[1]) if len(here) > 1 else capacity)
            if k != room and two <= room:
                break
            n = int(left[s] // 2 if k == s else min(left[s], left[k]))
            fixed.append((n, ((s, 2),) if k == s else ((s, 1), (k, 1))))
            left[s] -= n * (2 if k == s else 1)
            if k != s:
                left[k] -= n
        # a length that no rule settles stays for best fit, shorter ones may still be settled
    return fixed, {int(s): int(left[s]) for s in np.flatnonzero(left)}


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best fit, longest first, on counts: classes of equal open bins take a length many bins at a time."""
    rooms: dict[int, list[list]] = {}
    for s in sorted(counts, reverse=True):
        n = counts[s]
        for room in sorted(r for r in rooms if r >= s):
            while n and rooms.get(room):
                many, inside = rooms[room].pop()
                each = room // s
                full = min(many, n // each)
                if full:
                    rooms.setdefault(room - each * s, []).append([full, inside + ((s, each),)])
                    n -= full * each
                    many -= full
                if many and n:  # the last bin takes what is left
                    rooms.setdefault(room - n * s, []).append([1, inside + ((s, n),)])
                    n, many = 0, many - 1
                if many:
                    rooms[room].append([many, inside])
                    break
            if not n:
                break
        each = capacity // s
        if n // each:
            rooms.setdefault(capacity - each * s, []).append([n // each, ((s, each),)])
        if n % each:
            rooms.setdefault(capacity - n % each * s, []).append([1, ((s, n % each),)])
    return [(many, inside) for r in sorted(rooms) for many, inside in rooms[r]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, one past the last rank, first bin, per bin, offset in the bin)."""
    fixed, rest = reduce_by_dominance(counts, capacity)
    slots, ranks, base = [], dict.fromkeys(counts, 0), 0
    for many, inside in fixed + best_fit(rest, capacity):
        at = 0
        for s, each in inside:
            slots.append((s, ranks[s], ranks[s] + many * each, base, each, at))
            ranks[s] += many * each
            at += s * each
        base += many
    return slots


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces: ids of the public tokenizer and a final 0, cut only where longer than the capacity."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = WordIds.of(tokenizer)
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 20):
                yield _pieces(batch["doc_id"][a:b], *ids_of.rows(batch["text"][a:b]), capacity)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(settled(work), PIECES)


def _pieces(doc_ids: pa.Array, ids: np.ndarray, off: np.ndarray, capacity: int) -> pa.RecordBatch:
    from zlib import crc32

    n = np.diff(off)
    many = n // capacity + 1  # with the final id
    row = np.repeat(np.arange(len(n)), many)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = piece * capacity
    length = np.minimum(n[row] + 1 - start, capacity)
    whole = np.full(len(ids) + len(n), END, "<u4")
    whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    at = off[row] + row + start
    view = memoryview(whole).cast("B")
    crc = [crc32(view[4 * i:4 * (i + m)]) for i, m in zip(at.tolist(), length.tolist())]
    return pa.RecordBatch.from_arrays([doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=[c.split()[0] for c in PIECES.split(", ")])


def pack(pieces: DataFrame, capacity: int = CAPACITY, shards: int | None = None) -> DataFrame:
    """Add sequence_id and offset to rows that have a length of 1 to ``capacity``; ``pieces`` should be a stored table."""
    spark = pieces.sparkSession
    shards = shards or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)))
    counts = rows.groupBy("length", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(plan(histogram, capacity), "length long, lo long, hi long, base long, each long, at long")  # bounded by the capacity
    inner = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("inner", F.row_number().over(inner) - 1).join(before, ["length", "shard"]) \
        .withColumn("rank", F.col("inner") + F.col("before"))
    p = places.alias("p")
    placed = ranked.alias("r").join(F.broadcast(p), (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    index = F.col("rank") - F.col("lo")
    return placed.select(*[F.col(f"r.{c}") for c in pieces.columns],
                         (F.col("base") + F.floor(index / F.col("each"))).cast("long").alias("sequence_id"),
                         (F.col("at") + index % F.col("each") * F.col("r.length")).cast("long").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise once, store the piece lengths, plan and place."""
    return pack(written(token_pieces(docs, tokenizer, capacity)), capacity)


def bins_needed(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return sum(n for n, _ in fixed) + sum(n for n, _ in best_fit(rest, capacity))


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer bins (Martello-Toth L2)."""
    sizes = sorted(counts)
    best = -(-sum(s * n for s, n in counts.items()) // capacity)
    for a in [0, *[s for s in sizes if 2 * s <= capacity]]:
        one = sum(counts[s] for s in sizes if s > capacity - a)
        two = sum(counts[s] for s in sizes if capacity - a >= s > capacity / 2)
        room = two * capacity - sum(s * counts[s] for s in sizes if capacity - a >= s > capacity / 2)
        small = sum(s * counts[s] for s in sizes if capacity / 2 >= s >= a)
        best = max(best, one + two + max(0, -(-(small - room) // capacity)))
    return best
