"""Spelling variants: words one edit apart, found by scanning the sorted vocabulary with reused edit-matrix rows.

The vocabulary is cut into ranges of its sorted order, once as it is (mark ``>``) and once reversed (mark ``<``). Two
words one edit apart share the first half of the shorter one, and are near each other in the first order, or else its
second half, and are near in the second. So a word only visits the words that share its first half in either order.
It is sent to the ranges that hold such words, and not to those whose common prefix is already more than one edit away.
In a range the sorted words are scanned: the three cells of the banded edit-matrix row at every depth are kept, the rows
down to the longest common prefix with the word before are used again, and when a row exceeds one edit all words that
share that prefix are skipped. All words of a batch scan in step, as arrays.

Memory: a task holds one range (RANGE keys) and a batch of words; ranges hold distinct words, so no word is hot, and the
words sent to one range are dealt over parts of at most SHARE. The driver holds the first and last key of each range.

Edge cases: null and empty texts have no words; a null doc_id is written as an empty string before the colon; repeated
rows count again; other columns are ignored; an empty table gives an empty result. Of several near words with the largest
count the smallest in code-point order is the form. Following forms ends, since each has at least five times the count.
"""
from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.crc import CRC_TABLE, crc_sql, lower_sql
from touchline.llm.shared import pieces_of, written

LEAST_LETTERS, LEAST_COUNT, RATIO = 6, 5, 5
DROP_EVERY = 199      # one in so many (document, word) pairs loses a code point
RANGE = 20_000        # keys of one range of the sorted vocabulary, about
SHARE = 50_000        # words sent to one part of a range, about
BATCH = 8_192         # words that scan in step
CELLS = 1 << 22       # matrix rows kept at a time
_RUN = re.compile(r"[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)  # on text whose A-Z are lower case; shorter runs never become words
_LAST = "\U0010ffff"


def counted(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all documents, rare ones too."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 23):
                total: Counter[str] = Counter()
                for i, text in zip(batch["id"][a:b].to_pylist(), batch["text"][a:b].to_pylist()):
                    if text:
                        start = zlib.crc32(f"{i}:".encode())
                        for run, n in Counter(_RUN.findall(text.encode().lower().decode())).items():
                            h = zlib.crc32(run.encode(), start)
                            if h % DROP_EVERY == 0:
                                h %= len(run)
                                run = run[:h] + run[h + 1:]
                                if len(run) < LEAST_LETTERS:
                                    continue
                            total[run] += n
                yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


# A row of the band is three cells of 0, 1 or 2 (more than one edit) for the word's prefixes of depth - 1, depth, depth + 1
# letters, coded as one number; bits tell which of the three letters in question equal the letter read.
_CELL = np.array(list(product(range(3), repeat=3)), np.uint8)
START = 1 * 9 + 0 * 3 + 1


def _next_row(code: int, bits: int) -> int:
    a, b, c = _CELL[code].tolist()
    x = min(a + (not bits & 1), b + 1, 2)
    y = min(b + (not bits & 2), c + 1, x + 1, 2)
    z = min(c + (not bits & 4), y + 1, 2)
    return x * 9 + y * 3 + z


_STEP = np.array([_next_row(code, bits) for code in range(27) for bits in range(8)], np.uint8)
_DEAD = _CELL.min(axis=1) > 1


def shares_of_edit(word: str, prefix: str, depth: int) -> bool:
    """Can a word that begins with ``prefix`` be within one edit of ``word``? Their first ``depth`` letters are equal."""
    code = START
    padded = word[depth - 1:] + "\0\0\0"
    for d in range(depth, len(prefix)):
        c = prefix[d]
        three = padded[d - depth:d - depth + 3]
        if len(three) < 3:
            return False
        code = _STEP[code * 8 + (three[0] == c) + 2 * (three[1] == c) + 4 * (three[2] == c)]
        if _DEAD[code]:
            return False
    return True


def first_half(key: str) -> int:
    """Letters, the mark included, that a marked word shares with the near words found in its order."""
    return 1 + (len(key) - (2 if key[0] == ">" else 1)) // 2


class SortedWords:
    """A sorted list of words, the common prefix of each with the one before, and where it first gets shorter."""

    def __init__(self, words: list[str], n: list[int]) -> None:
        self.words, self.n = words, n
        self.length = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.flat = np.append(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.uint32(0))
        self.lcp = np.zeros(len(words) + 1, np.int64)
        self.lcp[-1] = -1
        same, d = np.arange(1, len(words)), 0
        while len(same):
            same = same[np.minimum(self.length[same], self.length[same - 1]) > d]
            same = same[self.flat[self.at[same] + d] == self.flat[self.at[same - 1] + d]]
            d += 1
            self.lcp[same] = d
        self.shorter = np.full(len(words) + 1, len(words), np.int64)
        stack: list[int] = []
        for i, x in enumerate(self.lcp.tolist()):
            while stack and self.lcp[stack[-1]] > x:
                self.shorter[stack.pop()] = i
            stack.append(i)

    def near(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(index of a word, index in the list) of all pairs exactly one edit apart that share the word's first half."""
        half = [first_half(w) for w in words]
        lo = [bisect_left(self.words, w[:h]) for w, h in zip(words, half)]
        hi = [bisect_left(self.words, w[:h] + _LAST, a) for w, h, a in zip(words, half, lo)]
        size = np.array([len(w) for w in words], np.int64)
        width = int(size.max()) + 3
        letters = np.zeros((len(words), width), np.uint32)
        letters[np.arange(width) < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        letters, rows = letters.ravel(), np.zeros(len(words) * width, np.uint8)
        q = np.flatnonzero(np.array(lo) < np.array(hi))
        i, end, d = np.array(lo, np.int64)[q], np.array(hi, np.int64)[q], np.array(half, np.int64)[q]
        rows[q * width + d] = START
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(q):
            at = q * width + d
            over = self.length[i] == d
            code = rows[at]
            done = np.flatnonzero(over)
            if len(done):
                cell = size[q[done]] - d[done] + 1
                fits = (cell >= 0) & (cell <= 2)
                fits[fits] = _CELL[code[done[fits]], cell[fits]] == 1
                out.append((q[done[fits]], i[done[fits]]))
            c = self.flat[self.at[i] + d]
            bits = (letters[at - 1] == c) + 2 * (letters[at] == c) + 4 * (letters[at + 1] == c).astype(np.int64)
            code = _STEP[code.astype(np.int64) * 8 + bits]
            leave = _DEAD[code] | over | (d + 2 >= width)
            stay = ~leave
            rows[at[stay] + 1] = code[stay]
            d[stay] += 1
            if leave.any():
                w = np.flatnonzero(leave)
                to, deep = i[w] + 1, d[w]
                jump = np.flatnonzero(self.lcp[to] > deep)
                while len(jump):  # the words that share the prefix beyond one edit are skipped
                    to[jump] = self.shorter[to[jump]]
                    jump = jump[self.lcp[to[jump]] > deep[jump]]
                i[w], d[w] = to, self.lcp[to]
                keep = stay
                keep[w] = to < end[w]
                q, i, end, d = q[keep], i[keep], end[keep], d[keep]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def plain(key: str) -> str:
    return key[1:] if key[0] == ">" else key[:0:-1]


def best_near(listed: SortedWords, keys: list[str]) -> list[tuple[str, int, int, str]]:
    """(word, near words found, largest count among them, the smallest of these words) of the words that have any."""
    found: dict[int, list] = {}
    for q, i in zip(*(x.tolist() for x in listed.near(keys))):
        key, other = keys[q], listed.words[i]
        forward = key[0] == ">"
        a, b = (key[1:], other[1:]) if forward else (plain(key), plain(other))
        h = min(len(a), len(b)) // 2
        if (a[:h] == b[:h]) != forward:  # each pair counts in one of the two orders
            continue
        n, have = listed.n[i], found.get(q)
        if have is None:
            found[q] = [1, n, b]
        else:
            have[0] += 1
            if n > have[1] or n == have[1] and b < have[2]:
                have[1], have[2] = n, b
    return [(plain(keys[q]), *x) for q, x in found.items()]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near) of all words (word, n) that have a near word. ``words`` is read several times."""
    spark = words.sparkSession
    ranges = max(1, -(-2 * words.count() // RANGE))
    keys = words.selectExpr("explode(array(concat('>', word), concat('<', reverse(word)))) AS key", "n")
    ordered = written(keys.repartitionByRange(ranges, "key").select("key", "n", F.spark_partition_id().alias("slot")))
    ends = sorted((r["slot"], r["a"], r["b"]) for r in ordered.groupBy("slot").agg(F.min("key").alias("a"), F.max("key").alias("b")).collect())
    slots, firsts, lasts = [r[0] for r in ends], [r[1] for r in ends], [r[2] for r in ends]
    common = [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(firsts, lasts)]
    table = spark.sparkContext.broadcast((slots, firsts, lasts, common))  # two keys a range

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, firsts, lasts, common = table.value
        for batch in batches:
            to, sent = [], []
            for key in batch["key"].to_pylist():
                depth = first_half(key)
                start = key[:depth]
                for r in range(bisect_left(lasts, start), bisect_right(firsts, start + _LAST)):
                    if common[r] <= depth or shares_of_edit(key, firsts[r][:common[r]], depth):
                        to.append(slots[r])
                        sent.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(sent, pa.string())], names=["slot", "key"])

    sent = written(ordered.select("key").mapInArrow(send, "slot int, key string"))
    parts = sent.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARE)).cast("int").alias("parts"))
    listed = ordered.join(parts, "slot").selectExpr("slot", "explode(sequence(0, parts - 1)) AS part", "0 AS kind", "key", "n")
    asked = sent.join(parts, "slot").selectExpr("slot", "CAST(pmod(xxhash64(key), parts) AS INT) AS part", "1 AS kind", "key", "0L AS n")
    rows = listed.unionByName(asked).repartition("slot", "part").sortWithinPartitions("slot", "part", "kind", "key")
    near = rows.mapInArrow(_scan, "word string, n_near long, near_n long, near string")
    best = near.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("best"))
    return best.selectExpr("word", "n_near", "-best.m AS near_n", "best.near AS near")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range: first its words in order, then the words that visit it."""
    group, words, counts, listed, waiting = None, [], [], None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if waiting:
            columns = list(zip(*best_near(listed, waiting))) or [()] * 4
            waiting.clear()
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
                                             names=["word", "n_near", "near_n", "near"])

    longest = 0
    for batch in batches:
        for slot, part, kind, key, n in zip(*(c.to_pylist() for c in batch.columns)):
            if (slot, part) != group:
                yield from flush()
                group, words, counts, listed, longest = (slot, part), [], [], None, 0
            if kind == 0:
                words.append(key)
                counts.append(n)
                continue
            if listed is None:
                listed = SortedWords(words, counts)
            longest = max(longest, len(key) + 3) if waiting else len(key) + 3
            waiting.append(key)
            if len(waiting) >= BATCH or longest * len(waiting) >= CELLS:
                yield from flush()
    yield from flush()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from links (word, form): each round follows twice as many links; counts grow fivefold a link, so rounds are few."""
    links = forms.select("word", F.col("form").alias("root"))
    while True:
        onward = links.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        step = written(links.join(onward, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        links = step.select("word", "root")
        if step.where("moved").isEmpty():
            return links


def variants(docs: DataFrame) -> DataFrame:
    """One row per word: its count, near words, form and root."""
    words = written(counted(docs).where(F.col("n") >= LEAST_COUNT))
    near = near_words(words)
    found = written(words.join(near, "word", "left").selectExpr(
        "word", "n", "coalesce(n_near, 0L) AS n_near", f"IF(near_n >= {RATIO} * n, near, NULL) AS form", f"IF(near_n >= {RATIO} * n, near_n, NULL) AS form_n"))
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


_LETTERS = "'[a-zÀ-ÿ]{6,}'"
ORACLE = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({lower_sql('text')}, {_LETTERS})) AS r FROM documents),
per AS (SELECT doc_id, r, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (SELECT r, n, {crc_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r")} AS h FROM per, crc_table),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % {DROP_EVERY} = 0 THEN substr(r, 1, CAST(h % length(r) AS BIGINT)) || substr(r, CAST(h % length(r) AS BIGINT) + 2) ELSE r END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
cut AS (SELECT DISTINCT word, n, substr(word, 1, p - 1) || substr(word, p + 1) AS c FROM spots),
same AS (SELECT word, n, p, substr(word, 1, p - 1) || '*' || substr(word, p + 1) AS c FROM spots),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS m FROM same a JOIN same b USING (p, c) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.c = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.c = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top FROM pairs GROUP BY word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= {RATIO} * w.n THEN b.top END AS form_n FROM words w LEFT JOIN best b USING (word)),
named AS (SELECT f.word, f.n, f.n_near, f.form_n, min(p.near) AS form FROM formed f LEFT JOIN pairs p ON p.word = f.word AND p.m = f.form_n GROUP BY ALL),
walk AS (SELECT word, word AS root FROM named UNION SELECT w.word, f.form FROM walk w JOIN named f ON w.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM walk w JOIN named f ON w.root = f.word WHERE f.form IS NULL)
SELECT n.word, n.form, e.root, n.n, n.n_near, n.form_n FROM named n JOIN ends e USING (word)
"""
