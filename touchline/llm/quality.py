"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is cut into blocks of 1024 bytes, every block is compressed once with each dictionary, and the
normalised difference of the summed sizes, (bad - good) / bytes, becomes a score by a logistic curve
fitted on labelled rows that the dictionaries have not seen. Beside the difference the curve sees the
compressed share good / bytes: text that repeats itself shrinks to little under either dictionary, and
its difference with it. A few bytes of the average are added to every text, so short ones stay near it.

Learning rows: ``crc32(doc_id as text) mod 5`` 1 to 3 for the dictionaries, 4 for the curve, 0 for
nothing. Of these, the ``sample`` rows with the smallest hash per label and use are taken: the bound of
the fit. Everything that is scored is scored whole.

Edge cases: a null or empty text scores the labels' share; a null doc_id counts as held out; null
labels are ignored; without labels of both kinds every score is the share of good labels (0.5 where
there are none); other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import settled, slices

BLOCK = 1024
LEVEL = 3
DICTIONARY = 112_640
SAMPLE = 1500
THRESHOLD = 0.3
FOLDS, HELD_OUT, CURVE = 5, 0, 4
SHRINK = 64.0
COLUMNS = "doc_id long, held_out boolean, score double, predicted int, size_bad long, size_good long"


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    share: float     # of label 1 among the labelled
    usual: tuple[float, ...]   # mean difference and mean compressed size per byte
    slope: tuple[float, ...]
    shift: float


def blocks(text: bytes, size: int = BLOCK) -> list[bytes]:
    return [text[i:i + size] for i in range(0, len(text), size)]


def dictionary(texts: list[str], size: int = DICTIONARY):
    """A trained dictionary; from too little text to train on, the text itself."""
    import zstandard

    pieces = [b for t in texts for b in blocks(t.encode())]
    try:
        if len(pieces) < 200:
            raise zstandard.ZstdError("few samples")
        return zstandard.train_dictionary(size, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-size:]


class Sizes:
    """Compressed sizes of a text under the two dictionaries."""

    def __init__(self, model: QualityModel) -> None:
        import zstandard

        self.pair = []
        for raw in (model.bad, model.good):
            known = zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None
            if known is not None:
                known.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_dict_id=False, write_checksum=False))

    def of(self, text: str) -> tuple[int, int, int]:
        cut = blocks(text.encode())
        bad, good = (sum(len(c.compress(b)) for b in cut) for c in self.pair)
        return bad, good, sum(map(len, cut))


def measures(bad, good, n, usual: tuple[float, ...]) -> np.ndarray:
    """(bad - good) / bytes and good / bytes, each drawn a little to its mean."""
    return np.stack([bad - good + SHRINK * usual[0], good + SHRINK * usual[1]], axis=-1) / (np.asarray(n)[..., None] + SHRINK)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], float]:
    """Slopes and shift of a weighted, slightly regularised logistic curve (Newton steps)."""
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    ridge = np.array([1e-2] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (weight * (p - y)) + ridge * w)
        step *= min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple((w[:-1] / scale).tolist()), float(w[-1])


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id's decimal text; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def _constant(share: float) -> QualityModel:
    return QualityModel(b"", b"", share, (0.0, 0.0), (0.0, 0.0), float(np.log((share + 1e-3) / (1 - share + 1e-3))))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")) \
        .where("doc_id is not null and quality in (0, 1)").distinct().withColumn("fold", fold())
    known = {r["quality"]: r["n"] for r in marked.where(F.col("fold") != HELD_OUT).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = known.get(1, 0) / sum(known.values()) if known else 0.5
    if len(known) < 2:
        return _constant(share)
    picks = None
    for quality in (0, 1):
        for use, where in (("dictionary", ~F.col("fold").isin(HELD_OUT, CURVE)), ("curve", F.col("fold") == CURVE)):
            part = marked.where((F.col("quality") == quality) & where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality", F.lit(use).alias("use"))
            picks = part if picks is None else picks.unionByName(part)
    # at most 4 * sample ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null") \
        .join(F.broadcast(picks), "doc_id").select("doc_id", "quality", "use", "text").toPandas().sort_values(["doc_id", "text"])
    seen = {q: rows[(rows.use == "dictionary") & (rows.quality == q)].text.tolist() for q in (0, 1)}
    curve = rows[rows.use == "curve"]
    if curve.quality.nunique() < 2:
        curve = rows
    if curve.quality.nunique() < 2:
        return _constant(share)
    good_bytes, bad_bytes = dictionary(seen[1]), dictionary(seen[0])
    sizes = Sizes(QualityModel(good_bytes, bad_bytes, share, (0.0, 0.0), (0.0, 0.0), 0.0))
    bad, good, n = np.array([sizes.of(t) for t in curve.text], float).T
    y = curve.quality.to_numpy(float)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    usual = tuple(np.average(np.stack([bad - good, good]) / np.maximum(n, 1), axis=1, weights=weight).tolist())
    return QualityModel(good_bytes, bad_bytes, share, usual, *logistic(measures(bad, good, n, usual), y, weight))


def _scores(sizes: Sizes, model: QualityModel, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = np.array([sizes.of(t) if t else (0, 0, 0) for t in texts], np.int64).reshape(-1, 3)
    bad, good, n = found.T
    score = 1 / (1 + np.exp(-np.clip(measures(bad, good, n, model.usual) @ np.array(model.slope) + model.shift, -700, 700)))
    score[(n == 0) | (not any(model.slope))] = model.share
    return score, bad, good


def scored(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: held_out, score, predicted and the two compressed sizes."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of 110 KB at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        sizes = Sizes(model)
        for batch in slices(batches):
            score, bad, good = _scores(sizes, model, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                                              pa.array(bad), pa.array(good)], names=[c.split()[0] for c in COLUMNS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold() == HELD_OUT, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(settled(work), COLUMNS)


def kept(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns unchanged, whose score reaches the threshold."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = spread.value
        sizes = Sizes(model)
        for batch in slices(batches):
            score, _, _ = _scores(sizes, model, batch["text"].to_pylist())
            yield batch.filter(pa.array(score >= threshold))

    return docs.mapInArrow(settled(work), docs.schema)
