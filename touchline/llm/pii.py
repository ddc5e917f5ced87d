"""Personal data: fixed patterns first, then a bidirectional LSTM-CRF for what their spelling misses.

Base spans (e-mail, IP, card, phone) come from fixed patterns over the whole text. The tagger is trained
on spans that the patterns label in a bounded sample of documents: as they are, respelt (a phone number
without its plus, an address with spaces at its @, a card number in dotted groups), and with another right
behind, where the patterns may read two numbers as one. So it learns surroundings and shapes rather than the patterns. It reads overlapping windows; a window's tags are
decoded by the CRF, and all windows' spans of a text are reconciled at once: parts of one span cut by
window edges are joined, and of overlapping candidates the set with the largest total confidence stays.
A span of any kind holds a digit or an @, so windows with neither are decoded as empty without being read.

Spans the tagger finds are added where they touch no base span.

Edge cases: a null text is empty and has no span; other columns are ignored (``redacted`` keeps them);
repeated rows are treated alike; without a labelled span in the sample nothing is added.
"""
from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.shared import settled, slices
from touchline.llm.tagger import KINDS, WINDOW, Tagger, symbols, window_rows, windows_of

SAMPLE = 800          # documents the tagger is trained on, at most
CONFIDENCE = 0.9      # mean tag probability of an added span
LONGEST = 64          # characters of an added span
COLUMNS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

# The patterns of the four kinds. Quantifiers that cannot give back are possessive: same matches, linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")
_DIGITS = str.maketrans("", "", " ().-+")

Span = tuple[int, int, int]  # start, end, kind number


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@domain: every match holds one @ after the longest local run before it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """All pattern spans by start, then kind."""
    out = [(a, b, 0) for a, b in emails(text)]
    if not _TRIGGER.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        digits = m.group().translate(_DIGITS)
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 9 <= len(m.group().translate(_DIGITS)) <= 15:
            out.append((m.start(), m.end(), 3))
    out.sort(key=lambda s: (s[0], s[2]))
    return out


def respelt(text: str, spans: list[Span], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with each labelled span spelt in a way the patterns don't know, and the new spans."""
    out, moved, done = "", [], 0
    for a, b, kind in spans:
        if a < done:
            continue
        piece = text[a:b]
        if kind == 0:
            piece = piece.replace("@", [" @ ", "@ ", " @"][rng.integers(3)])
        elif kind == 2:
            digits = piece.translate(_DIGITS)
            piece = ".".join(digits[i:i + 4] for i in range(0, len(digits), 4))
        elif kind == 3:
            piece = piece[1:].lstrip() if rng.random() < 0.5 else "00" + piece[1:]
        out += text[done:a]
        moved.append((len(out), len(out) + len(piece), kind))
        out += piece
        done = b
    return out + text[done:], moved


def beside(text: str, spans: list[Span], pool: list[tuple[str, int]], rng: np.random.Generator) -> tuple[str, list[Span]]:
    """The text with another labelled piece right behind each span, where the patterns may read the two as one."""
    out, moved, done = "", [], 0
    for a, b, kind in spans:
        piece, other = pool[rng.integers(len(pool))]
        out += text[done:b]
        moved += [(len(out) - (b - a), len(out), kind), (len(out) + 1, len(out) + 1 + len(piece), other)]
        out += " " + piece
        done = b
    return out + text[done:], moved


def fit(texts: list[str], seed: int = 7, steps: int = 400) -> Tagger | None:
    """Train on the spans the patterns label, plain and respelt, and on windows with digits that are no span."""
    rng = np.random.default_rng(seed)
    xs, ys = [], []
    pool = [(t[a:b], k) for t in texts for a, b, k in base_spans(t)]
    for text in texts:
        labelled = base_spans(text)
        spans = [s for i, s in enumerate(labelled) if not i or s[0] >= labelled[i - 1][1]]
        for t, s in ((text, spans), respelt(text, spans, rng), beside(text, spans, pool, rng)) if spans else ((text, spans),):
            x, y = window_rows(t, s)
            digit = (((x >= 20) & (x < 30)) | (x == 36)).any(axis=1)  # symbols of 0-9 and @
            xs.append(x[digit])
            ys.append(y[digit])
    x, y = (np.concatenate(v) if v else np.zeros((0, WINDOW), np.int64) for v in (xs, ys))
    if not y.any():
        return None
    tagger = Tagger.new(seed)
    tagger.train(x, y, steps)
    return tagger


def learn(docs: DataFrame, sample: int = SAMPLE) -> Tagger | None:
    """Train on at most ``sample`` documents that hold a digit or @, those with the smallest hash."""
    rows = docs.select(F.col("text").cast("string").alias("text")).where(F.col("text").rlike("[0-9@]")).withColumn("h", F.xxhash64("text"))
    many = rows.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    cut = int(min(1.0, 4 * sample / max(many, 1)) * (2**64 - 1)) - 2**63
    picked = rows.where(F.col("h") <= F.lit(min(cut, 2**63 - 1))).orderBy("h", "text").limit(sample).select("text").toPandas()
    return fit(picked.text.tolist())


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """Spans with confidence for each text: all windows that hold a digit or @ decoded together, then reconciled."""
    codes = [symbols(t) for t in texts]
    where: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        marks = [m.start() for m in _TRIGGER.finditer(text)]
        for a in windows_of(len(text)):
            i = bisect_left(marks, a)
            if i < len(marks) and marks[i] < a + WINDOW:
                where.append((k, a))
    parts: list[list[tuple[int, int, int, float, bool, bool]]] = [[] for _ in texts]
    for lo in range(0, len(where), 256):
        some = where[lo:lo + 256]
        x = np.zeros((len(some), WINDOW), np.int64)
        for row, (k, a) in enumerate(some):
            part = codes[k][a:a + WINDOW]
            x[row, :len(part)] = part
        e, p = tagger.marginals(x)
        path = tagger.best_path(e)
        for row in np.flatnonzero(path.any(axis=1)).tolist():
            k, a = some[row]
            n = min(WINDOW, len(texts[k]) - a)
            parts[k] += _spans_of(path[row, :n], p[row], a, len(texts[k]))
    return [reconciled(text, found) for text, found in zip(texts, parts)]


def _spans_of(path: np.ndarray, p: np.ndarray, at: int, length: int):
    i, n = 0, len(path)
    while i < n:
        tag = int(path[i])
        if tag % 2 == 0:
            i += 1
            continue
        j = i + 1
        while j < n and path[j] == tag + 1:
            j += 1
        sure = float(p[np.arange(i, j), path[i:j]].mean())
        yield at + i, at + j, (tag - 1) // 2, sure, i == 0 and at > 0, j == n and at + n < length
        i = j


def reconciled(text: str, parts: list[tuple[int, int, int, float, bool, bool]]) -> list[tuple[int, int, int, float]]:
    """One set of spans without overlaps: parts cut by window edges are joined, then the heaviest set is chosen."""
    parts = sorted(set(parts))
    merged: list[list] = []
    for a, b, kind, sure, cut_left, cut_right in parts:
        last = merged[-1] if merged else None
        if last and last[2] == kind and a < last[1] and (cut_left or last[5]):  # the same span, cut by an edge in one window
            last[3] = (last[3] * (last[1] - last[0]) + sure * (b - a)) / (last[1] - last[0] + b - a)
            if b >= last[1]:
                last[1], last[5] = b, cut_right
            continue
        merged.append([a, b, kind, sure, cut_left, cut_right])
    spans = sorted({(a, b, kind): sure for a, b, kind, sure, *_ in merged}.items(), key=lambda s: s[0][1])
    ends = [s[0][1] for s in spans]
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)]
    for i, ((a, b, kind), sure) in enumerate(spans):
        j = bisect_left(ends, a + 1, 0, i)
        take = best[j][0] + sure * (b - a)
        best.append((take, j, True) if take > best[i][0] else (best[i][0], i, False))
    out, i = [], len(spans)
    while i:
        _, j, taken = best[i]
        if taken:
            (a, b, kind), sure = spans[i - 1]
            out.append((a, b, kind, sure))
        i = j
    return out[::-1]


def all_spans(tagger: Tagger | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, added spans) of each text."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    at = [i for i, t in enumerate(texts) if _TRIGGER.search(t)] if tagger else []
    added: list[list[Span]] = [[] for _ in texts]
    for i, found in zip(at, tagged(tagger, [texts[i] for i in at]) if at else []):
        for a, b, kind, sure in found:
            while a < b and texts[i][a].isspace():
                a += 1
            while a < b and (texts[i][b - 1].isspace() or texts[i][b - 1] in ".,;:!?"):
                b -= 1
            piece = texts[i][a:b]
            if sure < CONFIDENCE or b - a > LONGEST or not plausible(piece, kind):
                continue
            if all(b <= x or a >= y for x, y, _ in base[i]):
                added[i].append((a, b, kind))
    return list(zip(base, added))


def plausible(piece: str, kind: int) -> bool:
    """The least that any spelling of a kind holds."""
    if kind == 0:
        return bool(piece.partition("@")[0].strip()) and "." in piece.partition("@")[2]
    digits = sum(c.isdigit() for c in piece)
    if any(c.isalpha() for c in piece):
        return False
    if kind == 1:
        return 4 <= digits <= 12 and piece.count(".") == 3
    if kind == 2:
        return 12 <= digits <= 19 and luhn("".join(c for c in piece if c in "0123456789"))
    return 9 <= digits <= 17 and any(c in " ().-" for c in piece)


def written_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def found(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans."""
    spread = docs.sparkSession.sparkContext.broadcast(tagger)  # 80 KB of weights

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for base, added in all_spans(spread.value, [t or "" for t in batch["text"].to_pylist()]):
                many = [sum(k == kind for *_, k in base) for kind in range(len(KINDS))]
                rows.append((*many, hashlib.sha256(written_spans(base).encode()).hexdigest(), written_spans(base + added), len(added)))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(settled(work), COLUMNS)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span, overlapping ones joined, replaced by its kind in brackets."""
    joined: list[list[int]] = []
    for a, b, k in sorted(spans):
        if joined and a < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b, k])
    out, done = [], 0
    for a, b, k in joined:
        out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = b
    return "".join(out) + text[done:]


def redacted(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    """All documents and columns; personal data is masked in ``text``, and ``n_chars``, where there is one, follows."""
    spread = docs.sparkSession.sparkContext.broadcast(tagger)
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch["text"].to_pylist()
            new = [t if t is None else masked(t, base + added) if base or added else t
                   for t, (base, added) in zip(old, all_spans(spread.value, [t or "" for t in old]))]
            columns = dict(zip(names, batch.columns))
            columns["text"] = pa.array(new, batch["text"].type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if a == b else len(b) for n, a, b in zip(kept, old, new)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=batch.schema)

    return docs.mapInArrow(settled(work), docs.schema)
