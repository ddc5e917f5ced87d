"""Masked pseudo-likelihood of tokens: every token id is hidden in turn and predicted from two ids on each side.

The model is what the whole corpus says about the hidden place, itself left out. Windows (l2, l1, token, r1, r2) are counted
exactly, under the context of four ids and under that of two (l1, r1). With c, n and k for how often a token occurs
in a context, how many tokens and how many different ones do, all without the hidden occurrence,

    p = (max(c - D, 0) + D k p') / n,    p' if n is 0,

where p' is the same for the next shorter context: four ids, two, none, and last the distribution of the character network
(``pseudo_likelihood``) over the vocabulary, so no token of any script is without weight. A document's score is the sum of log p.

Tables of counts have no fixed size. Documents are tokenised once into stored chunks; a chunk sends its distinct windows, packed, to the
parts that own their contexts, gets probabilities in the same order back and sums them by document. A context meets in one part, at
most once a chunk and token; the number of parts grows with the number of tokens.

Edge cases: a null or empty text has no tokens, sum 0 and mean 0; repeated rows are scored each, and see each other; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm import pseudo_likelihood
from touchline.llm.shared import discard, pieces_of, settled, written
from touchline.llm.wordids import WordIds
from touchline.llm.words import mix

EDGE = 0xFFFF          # stands beyond a text's ends
DISCOUNT = 0.75
CHUNK = 1 << 22        # bytes of text
PART_LOG = 20          # a part is made for so many tokens (log)
LEAST = 1e-3           # share of the last distribution that is the same for every id
CHUNKS = "chunk long, doc_id array<long>, size array<int>, ids binary, n long"
BLOBS = "chunk long, wide boolean, part int, data binary"
COLUMNS = pseudo_likelihood.COLUMNS


def chunks(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of many documents' ids."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, at = WordIds.of(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in pieces_of(batch["text"], CHUNK):
                parts = [words.rows(batch["text"][a + i:a + j]) for i, j in pieces_of(batch["text"][a:b])]
                ids = np.concatenate([x for x, _ in parts])
                if len(ids) and ids.max() >= EDGE:
                    raise ValueError("the vocabulary has more than 65,535 ids")
                size = np.concatenate([np.diff(off) for _, off in parts])
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([batch["doc_id"][a:b].to_pylist()], pa.list_(pa.int64())), pa.array([size.astype(np.int32)], pa.list_(pa.int32())),
                                                  pa.array([ids.astype("<u2").tobytes()], pa.binary()), pa.array([len(ids)], pa.int64())], names=["chunk", "doc_id", "size", "ids", "n"])
                at += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(settled(work), CHUNKS)


def _ordered(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The order by two keys, the second of so many bits: two sorts of 64-bit numbers take a fraction of a stable sort by both."""
    order = np.argsort(first)
    ahead = first[order]
    run = np.cumsum(np.append(False, ahead[1:] != ahead[:-1])[:len(ahead)]).astype(np.uint64)
    return order[np.argsort(run << np.uint64(bits) | second[order].astype(np.uint64))]


class Windows:
    """The distinct windows of a chunk: ``near`` is (l1, r1, token) and ``far`` (l2, r2); equal windows stand once, with their count."""

    def __init__(self, ids: bytes, size: np.ndarray) -> None:
        flat = np.frombuffer(ids, "<u2").astype(np.uint64)
        at = np.arange(len(flat)) + np.repeat(2 * np.arange(1, len(size) + 1), size)
        padded = np.full(len(flat) + 2 * (len(size) + 1), EDGE, np.uint64)
        padded[at] = flat
        near = padded[at - 1] << np.uint64(32) | padded[at + 1] << np.uint64(16) | flat
        far = (padded[at - 2] << np.uint64(16) | padded[at + 2]).astype(np.uint32)
        del at, padded
        order = _ordered(near, far, 32)
        near, far = near[order], far[order]
        short = np.append(True, near[1:] != near[:-1])[:len(near)]
        long = short | np.append(True, far[1:] != far[:-1])[:len(near)]
        self.keys, self.index = {}, {}
        for wide, first in ((False, short), (True, long)):
            start = np.flatnonzero(first)
            self.keys[wide] = near[start], far[start] if wide else np.zeros(0, np.uint32), np.diff(np.append(start, len(near))).astype(np.uint32)
            self.index[wide] = np.empty(len(near), np.int64)
            self.index[wide][order] = np.cumsum(first) - 1

    def dealt(self, wide: bool, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """The order of the distinct windows by the part that owns their context, and the parts in it."""
        near, far, _ = self.keys[wide]
        context = near >> np.uint64(16)
        part = (mix(context << np.uint64(32) | far if wide else context) % np.uint64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)
        order = np.argsort(part, kind="stable")
        return order, part[order]


def _planes(values: np.ndarray) -> bytes:
    """Byte by byte: the upper bytes of neighbours are alike."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _values(data: memoryview, kind: str, rows: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(-1, rows).T).view(kind).ravel()


def packed(*columns: np.ndarray) -> bytes:
    """Columns of little-endian numbers, compressed behind their number of rows and of bytes."""
    raw = b"".join(_planes(c) for c in columns)
    return len(columns[0]).to_bytes(8, "little") + len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    rows, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw, out, at = memoryview(pa.decompress(data[16:], decompressed_size=size, codec="zstd", asbytes=True)), [], 0
    for kind in kinds:
        n = rows * np.dtype(kind).itemsize
        out.append(_values(raw[at:at + n], kind, rows))
        at += n
    return out


def asked(stored: DataFrame, parts: int) -> DataFrame:
    """What chunks ask the parts: distinct windows and their counts."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                windows = Windows(batch["ids"][i].as_py(), batch["size"][i].values.to_numpy())
                for wide in (False, True):
                    near, far, n = windows.keys[wide]
                    order, part = windows.dealt(wide, parts)
                    start = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
                    rows = []
                    for a, b in zip(start.tolist(), np.append(start[1:], len(part)).tolist()):
                        pick = order[a:b]
                        rows.append(packed(np.diff(near[pick], prepend=np.uint64(0)), n[pick], *([far[pick]] if wide else [])))
                    yield pa.RecordBatch.from_arrays([batch["chunk"][i:i + 1].take(pa.array(np.zeros(len(rows), np.int64))), pa.array([wide] * len(rows), pa.bool_()),
                                                      pa.array(part[start].astype(np.int32)), pa.array(rows, pa.binary())], names=["chunk", "wide", "part", "data"])

    return stored.select("chunk", "size", "ids").mapInArrow(settled(work), BLOBS)


def left_out(context: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) for every row of counts: p = a + b p' for one occurrence of the token that is left out."""
    order = _ordered(context, token, 16)
    c, t = context[order], token[order]
    new = np.append(True, c[1:] != c[:-1])[:len(c)]
    first = new | np.append(True, t[1:] != t[:-1])[:len(c)]
    start = np.flatnonzero(first)
    count = np.add.reduceat(n[order].astype(np.int64), start)
    group = np.cumsum(new[start]) - 1
    whole = np.bincount(group, count)[group] - 1
    kinds = np.bincount(group)[group] - (count == 1)
    alone = whole == 0
    whole = np.maximum(whole, 1)
    a, b = np.maximum(count - 1 - DISCOUNT, 0) / whole, np.where(alone, 1.0, DISCOUNT * kinds / whole)
    place = np.empty(len(c), np.int64)
    place[order] = np.cumsum(first) - 1
    return a[place], b[place]


def answered(questions: DataFrame, shared) -> DataFrame:
    """The parts' answers: p of the short contexts, (a, b) of the wide ones, in the order of the question."""
    def work(key: tuple, table: pa.Table) -> pa.Table:
        wide = key[1].as_py()
        found = [unpacked(d, "<u8", "<u4", *(["<u4"] if wide else [])) for d in table["data"].to_pylist()]
        near = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in found])
        token = (near & np.uint64(0xFFFF)).astype(np.uint16)
        context = near >> np.uint64(16)
        if wide:
            context = context << np.uint64(32) | np.concatenate([x[2] for x in found])
        a, b = left_out(context, token, np.concatenate([x[1] for x in found]))
        at = np.cumsum([len(x[0]) for x in found])[:-1]
        columns = [np.split(v.astype("<f4"), at) for v in ([a, b] if wide else [a + b * shared.value[token]])]
        return pa.table({"chunk": table["chunk"], "wide": table["wide"], "part": table["part"], "data": pa.array([packed(*v) for v in zip(*columns)], pa.binary())})

    return questions.groupBy("part", "wide").applyInArrow(work, BLOBS)


def summed(stored: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """One row per document: tokens, summed and mean log-probability."""
    def work(chunk: pa.Table, found: pa.Table) -> pa.Table:
        names = [c.split()[0] for c in COLUMNS.split(", ")]
        if not len(chunk):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())], names=names)
        size = chunk["size"][0].values.to_numpy()
        windows, got = Windows(chunk["ids"][0].as_py(), size), {}
        rows = sorted(zip(found["part"].to_pylist(), found["wide"].to_pylist(), found["data"].to_pylist()))
        for wide in (False, True):
            kinds = ["<f4"] * (1 + wide)
            parted = [unpacked(d, *kinds) for _, w, d in rows if w == wide]
            order, _ = windows.dealt(wide, parts)
            for k in range(len(kinds)):
                values = np.empty(len(order))
                values[order] = np.concatenate([x[k] for x in parted]) if parted else 0
                got[wide, k] = values[windows.index[wide]]
        p = np.minimum(got[True, 0] + got[True, 1] * got[False, 0], 1)
        total = np.bincount(np.repeat(np.arange(len(size)), size), np.log(p), minlength=len(size)) if len(p) else np.zeros(len(size))
        n = size.astype(np.int64)
        return pa.table([chunk["doc_id"][0].values, pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))], names=names)

    return stored.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, COLUMNS)


def token_counts(stored: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs; a table of the vocabulary's size."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(EDGE + 1, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                counts += np.bincount(np.frombuffer(ids.as_buffer(), "<u2"), minlength=EDGE + 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["id", "n"])

    out = np.zeros(vocabulary, np.int64)
    for r in stored.select("ids").mapInArrow(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


def vocabulary_weights(spark, net: pseudo_likelihood.WindowNet, tokenizer: str) -> np.ndarray:
    """The distribution over the vocabulary that the character network gives: every id's text by itself."""
    words = WordIds.of(tokenizer)
    byte = {c: i for i, c in enumerate(words.chars)}
    vocabulary = words.whole.get_vocab()  # fixed by the tokenizer
    texts = [(i, bytes(byte[c] for c in t).decode("utf-8", "replace") if all(c in byte for c in t) else t) for t, i in vocabulary.items()]
    out = np.full(max(vocabulary.values()) + 1, -np.inf)
    for r in pseudo_likelihood.scored(spark.createDataFrame(texts, "doc_id long, text string"), net).collect():
        out[r["doc_id"]] = r["log_likelihood"]
    p = np.exp(out - out.max())
    return (1 - LEAST) * p / p.sum() + LEAST / len(p)


def scored(docs: DataFrame, net: pseudo_likelihood.WindowNet, tokenizer: str, part_log: int = PART_LOG) -> DataFrame:
    """One row per document: tokens, summed and mean log-probability of each token hidden in turn."""
    spark = docs.sparkSession
    stored = written(chunks(docs, tokenizer))
    last = vocabulary_weights(spark, net, tokenizer)
    counts = token_counts(stored, len(last))
    seen = np.flatnonzero(counts)
    single = np.zeros(len(last))
    if len(seen):
        a, b = left_out(np.zeros(len(seen), np.uint64), seen, counts[seen])
        single[seen] = a + b * last[seen]
    parts = (int(counts.sum()) >> part_log) + 1
    shared = spark.sparkContext.broadcast(single)  # a number for each id of the vocabulary
    answers = written(answered(asked(stored, parts), shared))
    out = written(summed(stored, answers, parts))
    discard(stored, answers)
    return out
