"""Masked pseudo-likelihood: a window network predicts every character from both sides.

Characters fold to 32 symbols (base letters, white space, digit, two kinds of punctuation, other letter, text edge).
The network sees the two symbols on each side of a hidden one and gives a distribution over the 32; a document's
score is the sum of the log-probabilities of all its characters, each hidden in turn.

What the network learns from is counted over every document: how often each window of five symbols occurs. The
table has at most 2**25 rows whatever the corpus; it is stored, and training runs on it in rounds: each of a fixed
number of parts starts from the shared weights, takes Adam steps over its own windows, and the parts' weights are
averaged by how much text they stand for. A scoring worker evaluates the network once for all 2**20 contexts and then reads
log-probabilities from that table.

Edge cases: a null or empty text has no characters, sum 0 and mean 0; repeated rows are scored each; an empty
corpus gives the untrained network; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of, written

SYMBOLS, SIDE = 32, 2
SPACE, DIGIT, STOP, SIGN, LETTER, EDGE = range(26, 32)
HIDDEN = 48
PARTS, ROUNDS, EPOCHS = 8, 3, 6
COLUMNS = "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double"
_TABLE: list[np.ndarray] = []


def symbol_table() -> np.ndarray:
    """Code point -> symbol."""
    if not _TABLE:
        out = np.full(0x110000, SIGN, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                base = unicodedata.normalize("NFKD", c)[0].lower()
                out[i] = ord(base) - 97 if len(base) == 1 and "a" <= base <= "z" else LETTER
            elif c.isspace():
                out[i] = SPACE
            elif c.isdigit():
                out[i] = DIGIT
        for c in ".,;:!?'\"()-":
            out[ord(c)] = STOP
        _TABLE.append(out)
    return _TABLE[0]


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code of the five-symbol window around every character, hidden symbol last, and the row offsets."""
    size = np.array([len(t) for t in texts], np.int64)
    off = np.append(0, np.cumsum(size))
    n = int(off[-1])
    flat = symbol_table()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.full(n + SIDE * (len(texts) + 1), EDGE, np.int32)
    at = np.arange(n) + np.repeat(SIDE * np.arange(1, len(texts) + 1), size)
    padded[at] = flat
    code = np.zeros(n, np.int32)
    for k in (-2, -1, 1, 2, 0):
        code = (code << 5) | padded[at + k]
    return code, off


def window_counts(docs: DataFrame) -> DataFrame:
    """(code, n) over all documents: counted in each task, then summed."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SYMBOLS**5, np.uint32)
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 21):
                np.add.at(counts, windows([t or "" for t in batch["text"][a:b].to_pylist()])[0], 1)
                if counts.max(initial=0) > 2**31:
                    yield from emitted(counts)
                    counts[:] = 0
        yield from emitted(counts)

    def emitted(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(counts)
        for a in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a:a + 50_000].astype(np.int32)), pa.array(counts[at[a:a + 50_000]].astype(np.int64))], names=["code", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(work, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


class WindowNet:
    """Four position tables summed into a tanh layer, plus direct tables, into a softmax over the symbols."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @staticmethod
    def new(seed: int = 3, hidden: int = HIDDEN) -> WindowNet:
        rng = np.random.default_rng(seed)
        return WindowNet({k: v.astype(np.float32) for k, v in {
            "e": rng.normal(0, 0.5, (4, SYMBOLS, hidden)), "o": rng.normal(0, 0.1, (hidden, SYMBOLS)),
            "d": np.zeros((4, SYMBOLS, SYMBOLS)), "b": np.zeros(SYMBOLS)}.items()})

    def forward(self, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        parts = [(context >> s) & 31 for s in (15, 10, 5, 0)]
        h = np.tanh(sum(self.w["e"][k][p] for k, p in enumerate(parts)))
        z = h @ self.w["o"] + self.w["b"] + sum(self.w["d"][k][p] for k, p in enumerate(parts))
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return parts, h, z

    def loss(self, context: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-probability of the counted hidden symbols (rows: contexts), and its gradient."""
        parts, h, z = self.forward(context)
        total = counts.sum()
        dz = (np.exp(z) * counts.sum(axis=1, keepdims=True) - counts) / total
        grad = {k: np.zeros_like(v) for k, v in self.w.items()}
        grad["o"], grad["b"] = h.T @ dz, dz.sum(axis=0)
        da = dz @ self.w["o"].T * (1 - h * h)
        for k, p in enumerate(parts):
            np.add.at(grad["e"][k], p, da)
            np.add.at(grad["d"][k], p, dz)
        return float(-(counts * z).sum() / total), grad

    def train(self, context: np.ndarray, counts: np.ndarray, epochs: int, seed: int, batch: int = 2048, rate: float = 0.01) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(context))
            for a in range(0, len(order), batch):
                pick = order[a:a + batch]
                _, grad = self.loss(context[pick], counts[pick])
                step += 1
                for k, g in grad.items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)

    def packed(self) -> bytes:
        return b"".join(self.w[k].astype("<f4").tobytes() for k in sorted(self.w))

    def unpacked(self, data: bytes) -> dict[str, np.ndarray]:
        flat, out, at = np.frombuffer(data, "<f4"), {}, 0
        for k in sorted(self.w):
            out[k] = flat[at:at + self.w[k].size].reshape(self.w[k].shape).copy()
            at += self.w[k].size
        return out

    def table(self) -> np.ndarray:
        """Log-probability of every window code."""
        out = np.empty((SYMBOLS**4, SYMBOLS), np.float32)
        for a in range(0, len(out), 1 << 14):
            out[a:a + (1 << 14)] = self.forward(np.arange(a, a + (1 << 14), dtype=np.int32))[2]
        return out.ravel()


def learn(docs: DataFrame, parts: int = PARTS, rounds: int = ROUNDS, epochs: int = EPOCHS) -> WindowNet:
    counted = window_counts(docs).withColumn("part", F.pmod(F.xxhash64(F.shiftright("code", 5)), F.lit(parts)).cast("int"))
    stored = written(counted.repartition(parts, "part"))
    net = WindowNet.new()

    def trained(start: bytes, turn: int):
        def work(key: tuple, table: pa.Table) -> pa.Table:
            own = WindowNet(WindowNet.new().unpacked(start))
            code, n = table["code"].to_numpy(), table["n"].to_numpy()
            context, row = np.unique(code >> 5, return_inverse=True)
            counts = np.zeros((len(context), SYMBOLS), np.float32)
            np.add.at(counts, (row, code & 31), n)
            # Adam's steps don't scale with counts, so a batch weighs its contexts by frequency
            own.train(context.astype(np.int32), counts, epochs, 100 * turn + key[0].as_py(), rate=0.01 / (1 + turn))
            return pa.table({"weights": pa.array([own.packed()], pa.binary()), "n": pa.array([int(n.sum())], pa.int64())})

        return work

    for turn in range(rounds):
        # `parts` rows of a few 10 KB
        found = stored.groupBy("part").applyInArrow(trained(net.packed(), turn), "weights binary, n long").collect()
        if not found:
            break
        total = sum(r["n"] for r in found)
        sets = [(net.unpacked(bytes(r["weights"])), r["n"] / total) for r in sorted(found, key=lambda r: bytes(r["weights"]))]
        net = WindowNet({k: sum(w[k] * s for w, s in sets).astype(np.float32) for k in net.w})
    return net


_SCORES: dict[str, np.ndarray] = {}


def scores_of(packed: bytes) -> np.ndarray:
    """The table of a network, made once a worker."""
    key = hashlib.md5(packed).hexdigest()
    if key not in _SCORES:
        _SCORES.clear()
        _SCORES[key] = WindowNet(WindowNet.new().unpacked(packed)).table()
    return _SCORES[key]


def scored(docs: DataFrame, net: WindowNet) -> DataFrame:
    """One row per document: characters, summed and mean log-probability."""
    spread = docs.sparkSession.sparkContext.broadcast(net.packed())  # tens of KB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = scores_of(spread.value)
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 21):
                code, off = windows([t or "" for t in batch["text"][a:b].to_pylist()])
                n = np.diff(off)
                row = np.repeat(np.arange(b - a), n)
                total = np.bincount(row, table[code], minlength=b - a) if len(code) else np.zeros(b - a)
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], pa.array(n), pa.array(total), pa.array(total / np.maximum(n, 1))],
                                                 names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, COLUMNS)
