"""Near-duplicate texts by improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its five-word shingles, each weighing its count times the mean inverse document
frequency of its words. Document frequencies are counted over all documents in ``SLOTS`` hashed word slots,
so the table has a fixed size. ``SAMPLES`` weighted samples agree between two texts with a chance equal to
their weighted Jaccard similarity. They form ``BANDS`` keys of ``SAMPLES // BANDS`` samples; texts that share
a key are candidates, and the exact weighted Jaccard similarity of their whole texts decides.

Texts with the same words are one node from the start, so copies cost one sketch row each and no pairs. In a
bucket all members of like weight are compared with one leader, not with each other. Then turns follow: every bucket that
still holds several components gets another leader, and a member is compared with the few leaders of other components
whose sketches agree with its own most. Turns go on while they find links worth their comparisons, so a large group of near copies grows
together before any pairs are made. Of the members that remain, two of different components can only be alike if they
share one of the rarest shingles that make up a fifth of their weight, with enough weight behind it in both; they
are joined on these, the largest component of a shingle with the others only, and no pair that could be a link is left out.
That join is made in ``ROUNDS``, pairs whose sketches agree most first: what they link is one component in the next round, so
a large group of near copies meets itself a few times a member, not in all pairs.

Edge cases: null and empty texts are copies of each other (no words); texts of one to four words have one
shingle; rows with equal ids are told apart by their text; a null doc_id is a row like others and sorts
first; other columns are ignored by ``classes`` and kept by ``one_of_each``; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.components import components
from touchline.llm.shared import discard, pieces_of, settled, written
from touchline.llm.words import distinct_per_row, mix, shingles_of_words, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
SAMPLES, BANDS = 64, 16
SLOTS_LOG = 16
POOL = 1 << 14
RARE_LOG = 18
AGREE = 36            # of 64 samples: at similarity 0.8 fewer agree once in a million pairs
LIKELY = 46           # agreeing samples from which on a turn compares a node with a leader
BEST = 3              # leaders a node is compared with in a turn
WORTH = 8             # turns go on while more than one in so many comparisons is a link
ROUNDS = (56, 52, AGREE)  # agreeing samples from which on the join on rare shingles makes a pair, round after round
SKETCH = "doc_id long, text_key long, node string, weight double, bands array<long>, samples array<short>"


def word_slots(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each hashed word slot occurs, and the number of documents."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros(1 << SLOTS_LOG, np.int64), 0
        for batch in batches:
            rows += len(batch["text"])
            for a, b in pieces_of(batch["text"]):
                h, off = word_hashes(batch["text"][a:b])
                slot = (h >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)
                row = np.repeat(np.arange(b - a), np.diff(off))
                counts += np.bincount(np.unique((row << SLOTS_LOG) | slot) & ((1 << SLOTS_LOG) - 1), minlength=1 << SLOTS_LOG)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(counts[at], rows), pa.int64())], names=["slot", "n"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(settled(work), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << SLOTS_LOG, np.int64)
    inside = found[found.slot >= 0]
    counts[inside.slot.to_numpy()] = inside.n.to_numpy()
    return counts, int(found[found.slot < 0].n.sum())


def slot_weights(docs: DataFrame) -> np.ndarray:
    counts, rows = word_slots(docs)
    return (1 + np.log((1 + rows) / (1 + counts))).astype(np.float32)


def weighted_sets(texts: pa.Array, weights: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(shingle hashes, their weights, row offsets, node of each row); the node is a digest of the words in order."""
    h, off = word_hashes(texts)
    nodes = [hashlib.md5(h[off[i]:off[i + 1]].tobytes()).hexdigest() for i in range(len(off) - 1)]
    own = weights[(h >> np.uint64(64 - SLOTS_LOG)).astype(np.int64)]
    s, soff = shingles_of_words(h, off, size)
    total = np.append(0.0, np.cumsum(own, dtype=np.float64))
    n = np.diff(off)
    at = np.arange(len(s)) + np.repeat(off[:-1] - soff[:-1], np.diff(soff))
    end = np.minimum(at + size, np.repeat(off[1:], np.diff(soff)))
    mean = ((total[end] - total[at]) / np.maximum(end - at, 1)).astype(np.float32)
    e, count, eoff = distinct_per_row(s, soff)
    # equal shingles have equal words, so any occurrence's mean will do: look it up by hash within the row
    row = np.repeat(np.arange(len(n)), np.diff(soff))
    order = np.lexsort((s, row))
    first = np.append(0, np.cumsum(count))[:-1].astype(np.int64)
    return e, mean[order][first] * count, eoff, nodes


class Sampler:
    """Weighted samples: the random variates of a shingle are a row of a fixed pool that its hash picks."""

    def __init__(self, samples: int = SAMPLES, seed: int = 20_100) -> None:
        rng = np.random.default_rng(seed)
        shape = (POOL, samples)
        r = rng.gamma(2, 1, shape)
        self.r = r.astype(np.float32)
        self.inverse = (1 / r).astype(np.float32)
        self.beta = rng.random(shape).astype(np.float32)
        self.base = (np.log(rng.gamma(2, 1, shape)) - r).astype(np.float32)
        self.samples = samples

    def of(self, e: np.ndarray, w: np.ndarray, step: int = 8192) -> np.ndarray:
        """Sample codes of one set (one at least): hash of the shingle with the least a, and its quantised weight."""
        low, code = None, None
        for a in range(0, len(e), step):
            at = (e[a:a + step] & np.uint64(POOL - 1)).astype(np.int64)
            beta = self.beta[at]
            t = np.floor(np.log(w[a:a + step])[:, None] * self.inverse[at] + beta)
            value = self.base[at] - self.r[at] * (t - beta)
            best = value.argmin(axis=0)
            k = np.arange(self.samples)
            new = value[best, k]
            codes = mix(e[a + best] + t[best, k].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + k.astype(np.uint64))
            if low is None:
                low, code = new, codes
            else:
                code = np.where(new < low, codes, code)
                low = np.minimum(new, low)
        return code


def sketches(docs: DataFrame, weights: np.ndarray, samples: int = SAMPLES, bands: int = BANDS) -> DataFrame:
    """One row per document: its node and its band keys (none for a text without words)."""
    spread = docs.sparkSession.sparkContext.broadcast(weights)  # 2**16 floats

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(samples)
        rows = samples // bands
        for batch in batches:
            for a, b in pieces_of(batch["text"]):
                e, w, off, nodes = weighted_sets(batch["text"][a:b], spread.value)
                keys, short = [], []
                total = np.append(0.0, np.cumsum(w, dtype=np.float64))
                for i in range(b - a):
                    if off[i] == off[i + 1]:
                        keys.append([])
                        short.append([])
                        continue
                    code = sampler.of(e[off[i]:off[i + 1]], w[off[i]:off[i + 1]])
                    band = np.arange(bands, dtype=np.uint64)
                    for j in range(rows):
                        band = mix(band * np.uint64(0xD6E8FEB86659FD93) + code[j::rows][:bands])
                    keys.append(band.view(np.int64))
                    short.append((code >> np.uint64(48)).astype(np.uint16).view(np.int16))
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["text_key"][a:b], pa.array(nodes, pa.string()), pa.array(total[off[1:]] - total[off[:-1]]),
                                                  pa.array(keys, pa.list_(pa.int64())),
                                                  pa.array(short, pa.list_(pa.int16()))], names=["doc_id", "text_key", "node", "weight", "bands", "samples"])

    return _rows(docs).mapInArrow(settled(work), SKETCH)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets given as ascending hashes and weights: sum of minima over sum of maxima."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - low
    return low / whole if whole else 1.0


def verified(pairs: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (u, v) of nodes whose whole texts have at least the given similarity."""
    spread = pairs.sparkSession.sparkContext.broadcast(weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = (None, None)
        for batch in batches:
            keep = []
            left, right = batch["left"], batch["right"]
            for i, u in enumerate(batch["u"].to_pylist()):
                e, w, off, _ = weighted_sets(right[i:i + 1], spread.value)
                if known[0] != u:  # pairs of a leader follow each other
                    f, x, _, _ = weighted_sets(left[i:i + 1], spread.value)
                    known = (u, (f, x))
                keep.append(weighted_jaccard(known[1], (e, w)) >= threshold)
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("right")), "v") \
        .join(texts.select(F.col("node").alias("u"), F.col("text").alias("left")), "u")
    return both.select("u", "v", "left", "right").mapInArrow(settled(work), "u string, v string")


def agreeing(a: str, b: str) -> Column:
    """How many of two texts' samples are equal."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def linked(docs: DataFrame, weights: np.ndarray, rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, root) of every node that is linked to another; ``rows``: the stored sketches."""
    nodes = rows.groupBy("node").agg(F.first("weight").alias("weight"), F.first("bands").alias("bands"), F.first("samples").alias("samples"), F.min(F.struct("doc_id", "text_key")).alias("one"))
    keyed = nodes.select("node", "weight", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "weight")).alias("first")).where("n > 1") \
        .select("key", F.col("first.node").alias("leader"), F.col("first.weight").alias("leader_weight"))
    members = written(keyed.join(shared, "key"))

    def weighty(a: str, b: str):
        """Sets whose weights differ too much cannot be as alike as the threshold."""
        return F.least(a, b) >= (threshold - 1e-4) * F.greatest(a, b)

    wanted = written(nodes.join(members.select("node").distinct(), "node").select("node", "one", "samples"))
    # a list of ids that grows with the corpus is never broadcast, however short it is here
    ids = wanted.select("node", F.col("one.doc_id").alias("d"), F.col("one.text_key").alias("k")).hint("merge")
    texts = written(_rows(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k"))).dropDuplicates(["node"]).select("node", "text"))
    tried = written(members.where(F.expr("node <> leader") & weighty("weight", "leader_weight")).select(F.col("leader").alias("u"), F.col("node").alias("v")).distinct())
    links = written(verified(tried, texts, weights, threshold))
    found = written(components(links))
    passing = [members, wanted, texts, tried, links]  # tables that nothing reads once the classes are known
    done = members.select("key", F.col("leader").alias("node")).distinct()

    def open_members() -> DataFrame:
        """Members not yet compared with all others of their bucket, where the bucket still holds several components."""
        left = members.join(done, ["key", "node"], "left_anti").join(found, "node", "left").select("key", "node", "weight", F.coalesce("root", "node").alias("root"))
        several = left.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("key")
        return written(left.join(several, "key"))

    def untried(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        return written(pairs.join(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti"))

    open_, turn = open_members(), 0
    while True:
        turn += 1
        held = open_.join(wanted.select("node", "samples"), "node")
        first = held.groupBy("key").agg(F.min_by(F.struct("node", "root", "weight", "samples"), F.struct(F.xxhash64("node", "key", F.lit(turn)), F.col("node"))).alias("f")) \
            .select("key", F.col("f.node").alias("u"), F.col("f.root").alias("u_root"), F.col("f.weight").alias("u_weight"), F.col("f.samples").alias("u_samples"))
        met = held.join(first, "key").where(F.expr("root <> u_root") & weighty("weight", "u_weight")).withColumn("n", agreeing("samples", "u_samples")).where(F.col("n") >= LIKELY)
        best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "u")), asc=False), 1, BEST).alias("best"))  # a node has at most BANDS leaders
        pairs = untried(best.select(F.col("node").alias("v"), F.explode("best.u").alias("u")))
        links = written(verified(pairs, texts, weights, threshold))
        n_pairs, n_links = pairs.count(), links.count()
        passing += [pairs, links]
        if n_links:
            passing += [found, open_]
            found = written(components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)))
            open_ = open_members()
        tried = tried.unionByName(pairs)
        if n_links * WORTH <= n_pairs:
            break
    rest = written(open_.select("node", "root").distinct().join(wanted.select("node", "samples"), "node"))
    held = rare_rows(rest, texts, weights, threshold)
    passing += [open_, rest, held]
    for agree in ROUNDS:
        now = held.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = untried(pairs_of(now, threshold, agree))
        links = written(verified(pairs, texts, weights, threshold))
        passing += [pairs, links]
        if not links.isEmpty():
            passing.append(found)
            found = written(components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(links)))
        tried = tried.unionByName(pairs)
    discard(*passing)
    return found


def rare_pairs(rest: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (u, v) of nodes of different components that share a shingle of both their prefixes and whose sketches agree."""
    return pairs_of(rare_rows(rest, texts, weights, threshold), threshold, AGREE)


def rare_rows(rest: DataFrame, texts: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """Stored rows (node, root, samples, rare, behind, weight), one for each shingle of a text's prefix that several components hold.

    A text's prefix are its rarest shingles, just over 1 - threshold of its weight: texts that are as alike as the
    threshold share more weight than lies outside a prefix. Any order common to all texts will do; shingles are
    ordered by how many of these texts hold their hashed slot, a table of fixed size. From a pair's first common
    shingle on, the lighter rest bounds what the two share; it must reach t / (1 + t) of their weights, for that is
    what similarity t means.
    """
    spark = rest.sparkSession
    own = texts.join(rest.select("node", "root"), "node")
    spread = spark.sparkContext.broadcast(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << RARE_LOG, np.int64)
        for batch in batches:
            for a, b in pieces_of(batch["text"]):
                np.add.at(counts, (weighted_sets(batch["text"][a:b], spread.value)[0] >> np.uint64(64 - RARE_LOG)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        for a in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a:a + 50_000], pa.int32()), pa.array(counts[at[a:a + 50_000]])], names=["slot", "n"])

    found = own.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()  # 2**18 rows at most
    counts = np.zeros(1 << RARE_LOG, np.int64)
    counts[found.slot.to_numpy()] = found.n.to_numpy()
    rarity = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(batch["text"]):
                e, w, off, _ = weighted_sets(batch["text"][a:b], spread.value)
                row = np.repeat(np.arange(b - a), np.diff(off))
                order = np.lexsort((e, rarity.value[(e >> np.uint64(64 - RARE_LOG)).astype(np.int64)], row))
                e, w = e[order], w[order].astype(np.float64)
                total = np.append(0.0, np.cumsum(w))
                before = total[:-1] - total[off[:-1]][row]
                whole = (total[off[1:]] - total[off[:-1]])[row]
                keep = np.flatnonzero(before <= (1 - threshold) * whole + 1e-4 * whole)
                yield pa.RecordBatch.from_arrays([batch["node"][a:b].take(pa.array(row[keep])), batch["root"][a:b].take(pa.array(row[keep])), pa.array(e[keep].view(np.int64)),
                                                  pa.array((whole - before)[keep]), pa.array(whole[keep])], names=["node", "root", "rare", "behind", "weight"])

    held = written(own.select("node", "root", "text").mapInArrow(settled(prefixes), "node string, root string, rare long, behind double, weight double"))
    out = written(_shared(held).drop("main").join(rest.select("node", "samples"), "node"))
    discard(held)
    return out


def _shared(held: DataFrame) -> DataFrame:
    """The rows whose shingle several components hold, with the component that holds it most often."""
    main = held.groupBy("rare", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("rare").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("k"))
    return held.join(main.where("k > 1").drop("k"), "rare")


def pairs_of(held: DataFrame, threshold: float, agree: int) -> DataFrame:
    """Pairs (u, v) of ``rare_rows``: nodes of different components with enough weight behind a common shingle, ``agree`` samples equal."""
    rows = written(_shared(held))
    a, b = rows.where("root <> main").alias("a"), rows.alias("b")
    enough = F.least("a.behind", "b.behind") >= (threshold / (1 + threshold) - 1e-4) * (F.col("a.weight") + F.col("b.weight"))
    once = (F.col("b.root") == F.col("b.main")) | (F.col("a.node") < F.col("b.node"))
    return a.join(b, (F.col("a.rare") == F.col("b.rare")) & (F.col("a.root") != F.col("b.root")) & once & enough & (agreeing("a.samples", "b.samples") >= agree)) \
        .select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def _classed(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Stored rows (doc_id, text_key, node, root): the root is the smallest node of the row's class."""
    weights = slot_weights(docs)
    rows = written(sketches(docs, weights))
    roots = linked(docs, weights, rows, threshold)
    out = written(rows.select("doc_id", "text_key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    discard(rows, roots)
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the smallest doc_id of its class, the class's size, and whether an equal text has a smaller id."""
    rows = _classed(docs, threshold)
    groups = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(groups, "root").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, of which one of each class stays: the one with the smallest id, then text hash."""
    rows = _classed(docs, threshold)
    kept = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    others = written(rows.join(kept, "root").where(~F.col("kept").eqNullSafe(F.struct("doc_id", "text_key"))).select(F.col("doc_id").alias("other_id"), F.col("text_key").alias("other_key")).distinct())
    doc_id, key = docs["doc_id"].cast("long"), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    left = docs.join(others.hint("merge"), doc_id.eqNullSafe(others["other_id"]) & (key == others["other_key"]), "left_anti")
    again = rows.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return left.dropDuplicates(["doc_id", "text"]) if again else left  # only repeated rows need the extra shuffle
