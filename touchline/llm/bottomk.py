"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct 64-bit hashes of a text's five-word shingles, ascending. The
sketch of a union is the k smallest of the merged sketches, so sketches of parts can be merged in any
order. Estimated from sketches alone: resemblance, containment and the number of distinct shingles.

Edge cases: a null text is empty; a text without words has the empty sketch; two empty sketches have
likeness 1, one empty sketch 0; rows with equal ids are ordered by text; null ids come first;
extra columns are ignored.
"""
from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of
from touchline.llm.words import shingle_hashes

SHINGLE = 5
K = 128


def sketches(texts: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of every row of a text array."""
    out: list[np.ndarray] = []
    for a, b in pieces_of(texts):
        h, off = shingle_hashes(texts[a:b], size)
        for i in range(b - a):
            own = h[off[i]:off[i + 1]]
            if len(own) > 4 * k:  # the k smallest distinct ones lie below a cut that holds k distinct values
                m = 2 * k
                while True:
                    low = np.unique(np.partition(own, m - 1)[:m]) if m < len(own) else np.unique(own)
                    if len(low) >= k or m >= len(own):
                        break
                    m *= 4
                out.append(low[:k])
            else:
                out.append(np.unique(own)[:k])
    return out


def encode(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<u8")


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of what two sketches stand for."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Share of the union's k smallest hashes that lie in both sets."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]), kind="stable")
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    union = both[first][:k]
    twice = both[1:][~first[1:]]
    return float(np.searchsorted(twice, union[-1], side="right")) / len(union)


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / (k-th smallest as a fraction)."""
    if len(a) < k:
        return float(len(a))
    return (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b holds too (1 for an empty a)."""
    if not len(a):
        return 1.0
    if not len(b):
        return 0.0
    union = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * union / distinct(a, k))


def in_ranges(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows (doc_id, text, part, tail) in id ranges, sorted: every row of the table once, then the row that follows the range.

    Ranges are cut at ids that occur, so the follower of a range is the first row of the next cut's id (after
    the last range: of the smallest id). It is sent along, marked ``tail``. The texts are shuffled once.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = rows.agg(F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("nulls"),
                     F.percentile_approx("doc_id", [i / parts for i in range(1, max(parts, 2))], 10000).alias("cuts")).first()
    cuts = sorted({c for c in found["cuts"] or [] if c != found["lo"]}) if parts > 1 else []
    smallest = None if found["nulls"] else found["lo"]
    follows = {c: i for i, c in enumerate(cuts)}  # the range that each cut's first row follows
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(_range_of(cuts)).cast("int")
    home = rows.select("doc_id", "text", part.alias("part"), F.lit(False).alias("tail"))
    ends = rows.where(F.col("doc_id").isNull() if smallest is None else F.col("doc_id") == smallest) \
        .groupBy("doc_id").agg(F.min("text").alias("text")).withColumn("part", F.lit(len(cuts)))
    if follows:
        ends = ends.unionByName(rows.where(F.col("doc_id").isin(cuts)).groupBy("doc_id").agg(F.min("text").alias("text"))
                                .withColumn("part", _range_of(cuts) - 1))
    ends = ends.select("doc_id", "text", F.col("part").cast("int").alias("part"), F.lit(True).alias("tail"))
    return home.unionByName(ends).repartitionByRange(len(cuts) + 1, "part") \
        .sortWithinPartitions("part", "tail", F.col("doc_id").asc_nulls_first(), "text")


def _range_of(cuts: list[int]):
    """How many cuts lie at or below doc_id: a balanced CASE, so log2(n) comparisons a row."""
    def between(a: int, b: int):
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(F.col("doc_id") < F.lit(cuts[m]), between(a, m)).otherwise(between(m + 1, b))

    return between(0, len(cuts))


COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, distinct_shingles double, contained_in_edited double"


def fingerprints(docs: DataFrame, k: int = K, size: int = SHINGLE) -> DataFrame:
    """Every document's sketch, the sketch of its edited text, and their likeness to each other and to the next document's.

    The edited text has its last half of code points replaced by as many of the next document's first ones.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        for batch in batches:
            ids, texts, tails = batch["doc_id"].to_pylist(), batch["text"], batch["tail"].to_pylist()
            for a, b in pieces_of(texts, 1 << 21):
                rows = kept + list(zip(ids[a:b], texts[a:b].to_pylist(), tails[a:b]))
                yield _rows(rows, k, size)
                kept = rows[-1:]

    return in_ranges(docs).mapInArrow(work, COLUMNS)


def _rows(rows: list[tuple], k: int, size: int) -> pa.RecordBatch:
    own = sketches(pa.array([t for _, t, _ in rows], pa.large_string()), k, size)
    at = [i for i in range(len(rows) - 1) if not rows[i][2]]
    edited = []
    for i in at:
        text, after = rows[i][1], rows[i + 1][1]
        half = len(text) // 2
        edited.append(text[:len(text) - half] + after[:half])
    new = sketches(pa.array(edited, pa.large_string()), k, size)
    return pa.RecordBatch.from_arrays([
        pa.array([rows[i][0] for i in at], pa.int64()),
        pa.array([len(rows[i][1]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([encode(own[i]) for i in at], pa.string()),
        pa.array([encode(s) for s in new], pa.string()),
        pa.array([resemblance(own[i], s, k) for i, s in zip(at, new)], pa.float64()),
        pa.array([resemblance(own[i], own[i + 1], k) for i in at], pa.float64()),
        pa.array([distinct(own[i], k) for i in at], pa.float64()),
        pa.array([containment(own[i], s, k) for i, s in zip(at, new)], pa.float64()),
    ], names=[c.split()[0] for c in COLUMNS.split(", ")])
