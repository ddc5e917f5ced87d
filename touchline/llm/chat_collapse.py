"""Chat formatting after collapsing cumulative snapshots.

Chat logs often hold every state of a growing conversation. A rolling hash over a conversation's first turns is a
running sum of turn hashes (128 bits in four halves of 32, so sums never overflow), computed in blocks of turns:
sums of blocks first, then inside each block, so a very long conversation is no single group. A conversation whose
whole hash is the prefix hash of a longer one is a snapshot of it; an anti-join drops snapshots, equal
conversations keep the one with the smallest id. What stays is rendered in parts of ``PART`` turns.

A turn's place is its ``turn`` number. Edge cases: rows with equal conv_id and turn belong together, ordered by role and
text; null role or text is empty, a null turn is 0; rows with a null conv_id are one conversation of that id; other
columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 256
PART = 64
NO_ID = -(2**63)
KEY = ("n", "a", "b", "c", "d")


def _turns(conversations: DataFrame) -> DataFrame:
    return conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID)).alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _halves(h: Column) -> tuple[Column, Column]:
    return h.bitwiseAND(0xFFFFFFFF), F.shiftright(h, 32)


def _summed(turns: DataFrame, *by: str) -> DataFrame:
    """Number of rows and the four hash sums per group; sums of parts add up."""
    a, b = _halves(F.xxhash64("turn", "role", "text"))
    c, d = _halves(F.xxhash64(F.lit("chat"), "text", "role", "turn"))
    rows = turns.select(*by, F.lit(1).cast("long").alias("n"), a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))
    return rows.groupBy(*by).agg(*[F.sum(k).alias(k) for k in KEY])


def prefixes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, n, a, b, c, d): count and hash of everything up to each turn."""
    each = _summed(_turns(conversations), "conv_id", "turn").withColumn("block", F.floor(F.col("turn") / block))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    blocks = each.groupBy("conv_id", "block").agg(*[F.sum(k).alias(f"{k}_all") for k in KEY])
    run = Window.partitionBy("conv_id").orderBy("block")
    before = blocks.select("conv_id", "block", *[(F.sum(f"{k}_all").over(run) - F.col(f"{k}_all")).alias(f"{k}_before") for k in KEY])
    within = each.select("conv_id", "turn", "block", *[F.sum(k).over(inside).alias(k) for k in KEY])
    return within.join(before, ["conv_id", "block"]).select("conv_id", "turn", *[(F.col(k) + F.col(f"{k}_before")).alias(k) for k in KEY])


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies): conversations that are no snapshot of a longer one, one of each set of equal ones."""
    whole = _summed(_turns(conversations), "conv_id")
    equal = whole.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    passing = prefixes(conversations).groupBy(*KEY).agg(F.count(F.lit(1)).alias("passing"))
    # more conversations pass through this state than end in it: a longer one exists
    longer = passing.join(equal.select(*KEY, "copies"), list(KEY)).where("passing > copies").select(*KEY)
    return equal.join(longer, list(KEY), "left_anti").select("conv_id", "copies")


def rendered(conversations: DataFrame, part: int = PART) -> DataFrame:
    """One row per ``part`` turns of every maximal conversation: its place, size and text with role marks."""
    kept = maximal(conversations).select("conv_id", "copies")
    rows = _turns(conversations).join(kept, "conv_id").withColumn("part", F.floor(F.col("turn") / part))
    line = F.struct("turn", "role", "text")
    parts = rows.groupBy("conv_id", "copies", "part").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<|"), x["role"], F.lit("|>\n"), x["text"], F.lit("<|end|>\n"))), "")
    conv_id = F.when(F.col("conv_id") != NO_ID, F.col("conv_id"))
    return parts.select(conv_id.alias("conv_id"), F.col("part").cast("long").alias("part"), F.size("lines").alias("n_turns"), "copies", text.alias("text"))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS line FROM conversations),
p AS (SELECT conv_id, turn, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM t),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS copies, prefix FROM p WHERE back = 1 GROUP BY prefix),
kept AS (SELECT conv_id, copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE back > 1))
SELECT t.conv_id, CAST(floor(t.turn / {PART}) AS BIGINT) AS part, CAST(count(*) AS INTEGER) AS n_turns, any_value(copies) AS copies, string_agg(line, '' ORDER BY t.turn) AS text
FROM t JOIN kept ON t.conv_id = kept.conv_id GROUP BY t.conv_id, floor(t.turn / {PART})
"""
