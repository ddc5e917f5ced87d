"""Repeated passages by content-defined chunking.

A gear rolling hash over the last 16 bytes of UTF-8 decides where a chunk ends, so an insertion moves only the
chunks around it. Chunks of all documents meet by a 128-bit digest. A digest that two documents hold is shared;
runs of adjoining shared chunks of at least ``MIN_RUN`` characters are reported. Of each shared chunk the
document with the smallest id keeps its copy; the others' copies are removable.

Every slice of a task's input first combines what it has seen: of the documents that hold one digest only the one
with the smallest id sends it on, the others are already known to be copies. So a passage that a third of
all documents hold sends one row a slice, not one a document.

Edge cases: null and empty texts have no chunks; rows with equal ids count as one document, and so do rows with a
null id; repeats inside one document alone are no finding; other columns are ignored by ``repeated`` and kept
by ``deduplicated``; an empty table gives an empty result.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of
from touchline.llm.words import _BYTE, _powers, mix, utf8_bytes

SMALLEST, LARGEST, BITS = 16, 256, 5     # bytes a chunk has, and zero bits that end one
MIN_RUN = 80                             # characters
_RNG = np.random.default_rng(77_001)
_GEAR = _RNG.integers(0, 2**16, 256, dtype=np.uint16)
_OTHER = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
CHUNKS = "d1 long, d2 long, doc_id long, at array<int>, shared boolean, first boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: sum of gear[byte k back] << k modulo 2**16, by doubling."""
    h = _GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def chunk_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of every chunk in bytes, number of chunks before each row)."""
    n = len(data)
    whole = np.ones(n + 1, bool)            # a chunk never cuts a character
    whole[:n] = (data & 0xC0) != 0x80
    hit = np.flatnonzero((gear(data) >> np.uint16(16 - BITS)) == 0) + 1
    hit = hit[whole[hit]]
    bound = np.searchsorted(hit, off, side="right").tolist()
    hits, rows = hit.tolist(), off.tolist()
    ends: list[int] = []
    before = [0]
    for r in range(len(rows) - 1):
        last, stop = rows[r], rows[r + 1]
        for c in [*hits[bound[r]:bound[r + 1]], stop]:
            if c > stop:
                continue
            while c - last > LARGEST:
                last += LARGEST
                while not whole[last]:
                    last -= 1
                ends.append(last)
            if c - last >= SMALLEST or (c == stop and c > last):
                ends.append(c)
                last = c
        before.append(len(ends))
    return np.array(ends, np.int64), np.array(before)


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end in code points, two digests) of every chunk in order."""
    data, off = utf8_bytes(texts)
    n = len(data)
    ends, before = chunk_ends(data, off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(before))
    starts = np.append(0, ends[:-1])[:len(ends)]
    starts[before[:-1][np.diff(before) > 0]] = off[:-1][np.diff(before) > 0]
    p, q = _powers(n)
    digests = []
    for table in (_BYTE, _OTHER):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * p[:n], out=total[1:])
        digests.append(mix((total[ends] - total[starts]) * q[starts]))
    points = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    base = points[off[:-1]][row] if n else np.zeros(0, np.int64)
    return row, points[starts] - base, points[ends] - base, digests[0], digests[1]


def _combined(ids: np.ndarray, texts: pa.Array) -> list[pa.RecordBatch]:
    """What one slice knows: rows to be matched by digest, and one row a document of chunks known to be copies."""
    row, start, end, d1, d2 = chunks(texts)
    doc = ids[row]
    order = np.lexsort((start, doc, d2, d1))
    row, start, end, d1, d2, doc = (x[order] for x in (row, start, end, d1, d2, doc))
    new = np.ones(len(d1), bool)
    new[1:] = (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
    group = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    smallest = doc[head][group] if len(head) else doc
    mine = doc == smallest
    shared = np.zeros(len(head), bool)
    shared[group[~mine]] = True
    spans = np.stack([start, end], axis=1)
    out = []
    keep = np.flatnonzero(mine)
    cut = np.flatnonzero(np.diff(group[keep])) + 1
    lists = pa.ListArray.from_arrays(pa.array(2 * np.concatenate([[0], cut, [len(keep)]]) if len(keep) else [0], pa.int32()), pa.array(spans[keep].ravel(), pa.int32()))
    out.append((d1[head].view(np.int64), d2[head].view(np.int64), doc[head], lists, shared, np.ones(len(head), bool)))
    rest = np.flatnonzero(~mine)
    rest = rest[np.argsort(doc[rest], kind="stable")]
    cut = np.flatnonzero(np.diff(doc[rest])) + 1
    heads = np.concatenate([[0], cut]).astype(np.int64) if len(rest) else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(2 * np.append(heads, len(rest)), pa.int32()), pa.array(spans[rest].ravel(), pa.int32()))
    own = doc[rest][heads]
    spread = mix(own.view(np.uint64) + np.arange(len(own), dtype=np.uint64))  # these rows meet no other, they only travel along
    out.append((spread.view(np.int64), own, own, lists, np.ones(len(own), bool), np.zeros(len(own), bool)))
    return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c), at, pa.array(s), pa.array(f)], names=[c.split()[0] for c in CHUNKS.split(", ")])
            for a, b, c, at, s, f in out]


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, at, removable): starts and ends of the chunks that another document holds too."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b in pieces_of(batch["text"], 1 << 22):
                yield from _combined(ids[a:b], batch["text"][a:b])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, CHUNKS)
    same = Window.partitionBy("d1", "d2", "first")
    met = rows.withColumn("low", F.min("doc_id").over(same)).withColumn("high", F.max("doc_id").over(same)).withColumn("any", F.max("shared").over(same))
    return met.where(F.col("any") | (F.col("low") != F.col("high"))) \
        .select("doc_id", "at", (~F.col("first") | (F.col("doc_id") != F.col("low"))).alias("removable"))


def repeated(docs: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """One row per document with a repeated passage: how many, their characters, how many of these other documents keep, and where."""
    schema = "doc_id long, passages int, repeated_chars long, removable_chars long, spans string, removable string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, all_, cut in zip(batch["doc_id"].to_pylist(), batch["every"].to_pylist(), batch["cut"].to_pylist()):
                runs = [r for r in joined(all_) if r[1] - r[0] >= least]
                if runs:
                    off = within(joined(cut), runs)
                    rows.append((None if doc == -(2**63) else doc, len(runs), sum(b - a for a, b in runs), sum(b - a for a, b in off),
                                 ",".join(f"{a}:{b}" for a, b in runs), ",".join(f"{a}:{b}" for a, b in off)))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=[c.split()[0] for c in schema.split(", ")])

    # one group a document: its chunks, never more than its text
    found = shared_chunks(docs).groupBy("doc_id").agg(F.flatten(F.collect_list("at")).alias("every"),
                                                      F.flatten(F.collect_list(F.when(F.col("removable"), F.col("at")))).alias("cut"))
    return found.mapInArrow(work, schema)


def joined(flat: list[int]) -> list[tuple[int, int]]:
    """Ascending runs of spans given as start, end, start, end, ...; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(flat[::2], flat[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def within(spans: list[tuple[int, int]], runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in one of the runs."""
    out, i = [], 0
    for a, b in spans:
        while i < len(runs) and runs[i][1] <= a:
            i += 1
        if i < len(runs) and runs[i][0] <= a:
            out.append((a, b))
    return out


def deduplicated(docs: DataFrame, least: int = MIN_RUN) -> DataFrame:
    """All documents and columns, the text without the repeated passages that another document keeps (unique doc_ids)."""
    names = docs.columns
    spans = repeated(docs, least).select(F.col("doc_id").alias("cut_id"), F.col("removable").alias("cut_spans"))
    both = docs.join(spans, docs["doc_id"].cast("long").eqNullSafe(F.col("cut_id")), "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip([*names, "cut_id", "cut_spans"], batch.columns))
            texts = []
            for text, cut in zip(columns["text"].to_pylist(), columns["cut_spans"].to_pylist()):
                for span in reversed(cut.split(",")) if cut and text else ():
                    a, b = map(int, span.split(":"))
                    text = text[:a] + text[b:]
                texts.append(text)
            columns["text"] = pa.array(texts, columns["text"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return both.mapInArrow(work, docs.schema)
