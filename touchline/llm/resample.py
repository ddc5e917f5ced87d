"""Importance resampling towards a target: hashed n-gram features by an Aho-Corasick scan whose payloads are composed.

The distinct words of a slice of texts, bounded by delimiters, are the automaton's dictionary; each carries its CRC-32
and its length. Scanning the slice emits the payloads of its words in order. A word's CRC gives its bucket, and the CRC
of two adjacent words is composed from their payloads without touching their letters. Buckets of all documents and of
the target are counted, a bucket's gain is the log of its two shares, and a document's weight is the mean gain of its
features. With Gumbel noise from its id added, the highest scores are a draw without replacement.

Memory: a task holds a slice of texts with its automaton; words over LONG bytes stand in it by a short name of their own.
The features are stored as two bytes each, so texts are scanned once. The driver holds the bucket counts, a fixed number. Ranks come from ranges of the order and their counts.

Edge cases: null and empty texts have no features, weight 0 and no rank; a null doc_id hashes as an empty string and
comes last among equal scores; repeated rows count, score and rank each; other columns are ignored; an empty table gives an
empty result, an empty target leaves gains that only say how rare a bucket is.
"""
from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from ahocorasick import Automaton
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.crc import CRC_TABLE, Parts, crc_sql, lower_sql
from touchline.llm.shared import pieces_of, written
from touchline.llm.words import utf8_bytes

BUCKETS = 10_000
LEAST_WORDS = 20      # of a document that may be drawn
PERCENT = 25          # of those documents that are drawn
LONG = 64             # bytes of a word the automaton spells out
SLICE = 1 << 20       # bytes of text under one automaton, about
_SPACE = np.array([zlib.crc32(b" ")]), np.array([1])
_PLAIN = np.full(128, 32, np.uint8)  # delimiters become spaces, A-Z small letters
for _c in (*range(48, 58), *range(97, 123)):
    _PLAIN[_c] = _c
_PLAIN[65:91] = np.arange(97, 123)
_TABLE = np.append(_PLAIN, np.arange(128, 256, dtype=np.uint8))


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, row offsets): of each text the buckets of its words in order, then those of its pairs of adjacent words."""
    data, off = utf8_bytes(texts)
    raw, bounds = _TABLE[data].tobytes(), off.tolist()
    line = b" ".join([b"", *(raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])), b""])  # a space before every text
    letter = np.frombuffer(line, np.uint8) != 32
    starts = np.flatnonzero(letter[1:] & ~letter[:-1])
    words = line.split()
    distinct = list(set(words))
    long = {w: b"\1%d" % k for k, w in enumerate(distinct) if len(w) > LONG}  # no text holds the byte 1 any more
    found = np.zeros(0, np.int64)
    if words:
        if long:
            line = b" ".join([b"", *(long.get(w, w) for w in words), b""])
        automaton = Automaton()
        for k, w in enumerate(b" ".join(long.get(w, w) for w in distinct).decode("latin-1").split(" ")):
            automaton.add_word(f" {w} ", k)
        automaton.make_automaton()
        found = np.fromiter(map(itemgetter(1), automaton.iter(line.decode("latin-1"))), np.int64, len(words))
    crc = np.array(list(map(zlib.crc32, distinct)), np.uint32)
    known = Parts(crc, np.array(list(map(len, distinct)), np.int64))
    spaced = Parts(*_SPACE).behind(crc, np.zeros(len(crc), np.int64))  # each word and a space
    single = (crc % BUCKETS)[found]
    pair = known.behind(spaced[found[:-1]], found[1:]) % BUCKETS
    bound = np.searchsorted(starts, off + np.arange(len(off)))  # words before each text
    n = np.diff(bound)
    ends = np.append(0, np.cumsum(np.maximum(2 * n - 1, 0)))
    out = np.zeros(ends[-1], np.uint16)
    at = np.arange(len(found)) - np.repeat(bound[:-1], n)  # place in its text
    row = np.repeat(np.arange(len(n)), n)
    out[ends[row] + at] = single
    first = np.flatnonzero(at + 1 < n[row])  # words with another one behind
    out[ends[row[first]] + n[row[first]] + at[first]] = pair[first]
    return out, ends


def features(table: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` (long) and ``features``: two bytes a feature."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(batch["text"], SLICE):
                found, ends = features_of(batch["text"][a:b])
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(2 * ends), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays([*(batch[k][a:b] for k in keep), packed.cast(pa.binary())], names=[*keep, "features"])

    rows = table.select(*(F.col(k).cast("long").alias(k) for k in keep), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, ", ".join([*(f"{k} long" for k in keep), "features binary"]))


def unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    packed = packed.cast(pa.large_binary())
    off = np.frombuffer(packed.buffers()[1], np.int64, len(packed) + 1, packed.offset * 8) // 2
    if off[-1] == off[0]:
        return np.zeros(0, np.uint16), off - off[0]
    return np.frombuffer(packed.buffers()[2], np.uint16, off[-1] - off[0], off[0] * 2), off - off[0]


def bucket_counts(table: DataFrame) -> np.ndarray:
    """Features in each bucket over a whole table of ``features``: a fixed number of rows a task."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch["features"])[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in table.select("features").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of a bucket's share of the target over its share of the corpus, floored."""
    s_all, t_all = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def noise(doc_id: int | None) -> int:
    h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(table: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight, score) of a table of doc_id and features."""
    spread = table.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = unpacked(batch["features"])
            total = np.append(0, np.cumsum(spread.value[found]))[ends]
            n = np.diff(ends)
            weight = np.diff(total) // np.maximum(n, 1)
            score = weight + np.array([noise(i) for i in batch["doc_id"].to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n), pa.array(weight), pa.array(score)], names=["doc_id", "n_features", "weight", "score"])

    return table.mapInArrow(work, "doc_id long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Every document's features, weight and score, and the rank of those drawn."""
    held = written(features(docs, "doc_id"))
    table = written(scored(held, gains_of(bucket_counts(held), bucket_counts(features(target))))).withColumn("_at", F.monotonically_increasing_id())
    may = F.col("n_features") >= 2 * LEAST_WORDS - 1
    draw = table.where(may).count() * PERCENT // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_at")]  # the place in the table parts equal rows
    ranges = written(table.where(may).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = ranges.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(  # one row a range
        "_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    chosen = ranges.join(before, "_range").withColumn("rank", F.when(place <= draw, place)).select(names)
    return chosen.unionByName(table.where(~may).withColumn("rank", F.lit(None).cast("long")).select(names))


def _features_sql(table: str, key: str) -> str:
    return f"""SELECT {key}, w, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f
  FROM (SELECT {key}, regexp_extract_all({lower_sql("text")}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM {table})"""


ORACLE = f"""
WITH {CRC_TABLE},
rows AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS ({_features_sql("rows", "r")}),
b AS ({_features_sql("benchmark", "item_id")}),
coded AS (SELECT f, {crc_sql("f")} % {BUCKETS} AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b)), crc_table),
s AS (SELECT k, count(*) AS n FROM d JOIN coded USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM b JOIN coded USING (f) GROUP BY k),
gain AS (SELECT k, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + {BUCKETS} FROM s)
    / ((coalesce(s.n, 0) + 1)::DOUBLE * (SELECT coalesce(sum(n), 0) + {BUCKETS} FROM t)))) AS g FROM s FULL JOIN t USING (k)),
weights AS (SELECT r, count(*) AS n_features, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM d JOIN coded USING (f) JOIN gain USING (k) GROUP BY r),
noisy AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(
    (CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score,
    coalesce(n_features, 0) >= {2 * LEAST_WORDS - 1} AS may FROM rows LEFT JOIN weights USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY may ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY may) AS many FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= many * {PERCENT} // 100 THEN place END AS rank FROM placed
"""
