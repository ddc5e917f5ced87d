"""Table reading and Arrow plumbing shared by the corpus operators."""
from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from touchline.session import discard
from touchline.session import stored as written

__all__ = ["discard", "documents", "pieces_of", "settled", "slices", "written"]


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces_of(texts: pa.Array, limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least: bounds the working memory, drops nothing."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of text, so few texts are held in Python at a time."""
    for batch in batches:
        for a, b in pieces_of(batch["text"], limit):
            yield batch.slice(a, b - a)


def settled(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` whose Python worker gives the memory it has freed back when a task ends: later stages use the same workers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return run
