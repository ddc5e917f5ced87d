"""Language identification by unigram pieces, summed over every segmentation.

The pieces are those of a fixed public vocabulary. Each language has a probability for every piece, and
a word's probability is the sum over all ways of cutting it into pieces (forward algorithm). The
probabilities are fitted by expectation-maximisation on labelled texts. A text's language is the one
whose product over all its words is largest; the score is that language's share of the sum.

A word is a run of letters of any length, lower case, with a word-begin mark before it. All letters of the vocabulary and
of the learning texts are told apart and all pieces of letters take part; other letters have a small fixed probability in every language.

Learning rows: a known ``lang`` and ``crc32(doc_id as text) mod 4`` other than 2; of these the ``sample``
rows with the smallest hash per language (the bound of the fit). Whole texts are predicted.

Edge cases: a text that is null or without a letter is ``und`` with score 0; without learning rows every
text is; a null doc_id counts as held out; ties go to the first language in order; other columns are
ignored.
"""
from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from touchline.llm.shared import pieces_of
from touchline.llm.words import _powers, mix

FOLDS, HELD_OUT = 4, 2
SAMPLE = 800
ROUNDS = 3
FLOOR = 1e-7       # probability of a letter that neither the vocabulary nor a learning text holds
RESCALE = 16       # positions between two rescalings of a word's sums
CELLS = 800_000    # symbols of words at a time
MARK = "▁"
NONE = "und"
COLUMNS = "doc_id long, held_out boolean, lang_pred string, score double"


def public_pieces(name: str) -> list[str]:
    import sentencepiece

    if not os.path.exists(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    model = sentencepiece.SentencePieceProcessor(model_file=name)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not model.is_byte(i) and not model.is_control(i) and not model.is_unknown(i)]


_LETTERS: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _LETTERS[0]


@dataclass
class Trie:
    """Pieces over an alphabet. Symbols: 0 none, 1 unknown letter, 2 the mark, 3.. letters. The transitions of all nodes lie in one table."""
    alphabet: str
    pieces: list[str]
    longest: int = field(init=False)        # symbols in a piece
    base: np.ndarray = field(init=False)    # node + symbol -> place
    owner: np.ndarray = field(init=False)   # place -> node it belongs to
    target: np.ndarray = field(init=False)  # place -> next node
    piece: np.ndarray = field(init=False)   # node -> piece + 1, 0: none; the last node is dead

    def __post_init__(self) -> None:
        symbol = {MARK: 2} | {c: i + 3 for i, c in enumerate(self.alphabet)}
        # every single symbol is a piece, so that each word has a segmentation
        self.pieces = sorted({p for p in self.pieces if p and all(c in symbol for c in p)} | set(symbol))
        self.longest = max(map(len, self.pieces))
        children: list[dict[int, int]] = [{}]
        piece = [0]
        for k, text in enumerate(self.pieces):
            node = 0
            for c in text:
                nxt = children[node].get(symbol[c])
                if nxt is None:
                    nxt = children[node][symbol[c]] = len(children)
                    children.append({})
                    piece.append(0)
                node = nxt
            piece[node] = k + 1
        self.piece = np.array([*piece, 0], np.int32)
        self._place(children, len(symbol) + 2)

    def _place(self, children: list[dict[int, int]], many: int) -> None:
        """Each node's row of transitions goes where its symbols fall on free places, the largest first; places below ``many`` stay free."""
        self.base = np.zeros(len(children) + 1, np.int32)
        free = np.ones(2 * (many + 1) + 2 * len(children), bool)
        self.owner, self.target = np.full(len(free), -1, np.int32), np.full(len(free), len(children), np.int32)
        low = many + 1
        for node in sorted((i for i, c in enumerate(children) if c), key=lambda i: (-len(children[i]), i)):
            own = np.array(sorted(children[node]))
            reach, begin = own - own[0], low
            while True:
                if begin + 4096 + many >= len(free):
                    more = len(free) + 4096
                    free = np.append(free, np.ones(more, bool))
                    self.owner, self.target = np.append(self.owner, np.full(more, -1, np.int32)), np.append(self.target, np.full(more, len(children), np.int32))
                at = begin + np.flatnonzero(free[begin:begin + 4096])
                at = at[:1] if len(own) == 1 else at[free[at[:, None] + reach].all(axis=1)] if len(at) else at
                if len(at):
                    break
                begin += 4096
            self.base[node] = at[0] - own[0]
            put = at[0] + reach
            free[put] = False
            self.owner[put], self.target[put] = node, [children[node][c] for c in own.tolist()]
            while not free[low]:
                low += 1
        used = int(self.base.max()) + many + 1
        self.owner, self.target = self.owner[:used].copy(), self.target[:used].copy()

    def symbols(self) -> np.ndarray:
        """Code point -> symbol."""
        out = letter_table().astype(np.uint16 if len(self.alphabet) + 3 <= 1 << 16 else np.uint32)
        for i, c in enumerate(self.alphabet):
            out[ord(c)] = i + 3
        return out

    def matches(self, words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, length, piece + 1 of every word or 0) for all stretches of a matrix of symbols (rows: words, 0 behind the end)."""
        width = words.shape[1]
        for i in range(width):
            node = np.zeros(len(words), np.int32)
            for k in range(1, min(self.longest, width - i) + 1):
                place = self.base[node] + words[:, i + k - 1]
                node = np.where(self.owner[place] == node, self.target[place], len(self.piece) - 1)
                if k > 1 and (node == len(self.piece) - 1).all():
                    break
                yield i, k, self.piece[node]


def word_groups(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words in groups of equal length: (indices, matrix of symbols with the mark in front)."""
    length = ends - starts
    order = np.argsort(length, kind="stable")
    cut = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cut):
        if len(group):
            n = int(length[group[0]])
            out = np.full((len(group), n + 1), 2, symbols.dtype)
            out[:, 1:] = symbols[starts[group][:, None] + np.arange(n)]
            yield group, out


def chunks(group: np.ndarray, matrix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    many = max(1, CELLS // matrix.shape[1])
    for a in range(0, len(group), many):
        yield group[a:a + many], matrix[a:a + many]


def alphas(steps: Iterable[tuple[int, int, np.ndarray]], prob: np.ndarray, words: np.ndarray, longest: int) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Sums over the segmentations of every beginning of the words; what lies at or behind a key of the second result is divided by its value."""
    many, width = words.shape
    alpha = np.zeros((width + 1, many, prob.shape[1]))
    alpha[0] = 1
    scale: dict[int, np.ndarray] = {}
    unknown = words == 1
    for i, k, piece in steps:
        if i and i % RESCALE == 0 and i not in scale:  # keeps very long words within range
            scale[i] = np.maximum(alpha[i:i + longest].max(axis=0), 1e-300)
            alpha[i:i + longest] /= scale[i]
        alpha[i + k] += alpha[i] * prob[piece]
        if k == 1 and unknown[:, i].any():
            alpha[i + 1][unknown[:, i]] += alpha[i][unknown[:, i]] * FLOOR
    return alpha, scale


def forward(trie: Trie, prob: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log-probability of each word (rows) in each language: all segmentations summed. prob: (pieces + 1, languages), row 0 is 0."""
    alpha, scale = alphas(trie.matches(words), prob, words, trie.longest)
    return np.log(np.maximum(alpha[-1], 1e-300)) + sum(np.log(x) for x in scale.values())


def expected(trie: Trie, prob: np.ndarray, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of words (with their counts per language) over all segmentations."""
    width = words.shape[1]
    steps = list(trie.matches(words))
    unknown = words == 1
    alpha, scale = alphas(steps, prob, words, trie.longest)
    # beta is divided by the word's sum and multiplied by what alpha was divided by, so alpha * beta is a position's share
    beta = np.zeros_like(alpha)
    beta[width] = 1 / np.maximum(alpha[width], 1e-300)
    out = np.zeros_like(prob)
    for i, k, piece in reversed(steps):
        behind = beta[i + k]
        for c in range(i // RESCALE * RESCALE + RESCALE, i + k + 1, RESCALE):
            if c in scale:
                behind = behind / scale[c]
        beta[i] += prob[piece] * behind
        if k == 1 and unknown[:, i].any():
            beta[i][unknown[:, i]] += behind[unknown[:, i]] * FLOOR
        part = alpha[i] * prob[piece] * behind * counts
        for g in range(prob.shape[1]):
            out[:, g] += np.bincount(piece, part[:, g], minlength=len(prob))
    out[0] = 0
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    trie: Trie | None
    prob: np.ndarray | None


def fit(texts: list[str], langs: list[str], pieces: list[str], rounds: int = ROUNDS) -> LanguageModel:
    names = sorted(set(langs))
    words: dict[str, Counter] = {g: Counter() for g in names}
    letter = letter_table()
    for t, g in zip(texts, langs):
        words[g].update("".join([c if letter[ord(c)] else " " for c in t.lower()]).split())
    letters = Counter()
    for c in words.values():
        for w, n in c.items():
            for x in set(w):
                letters[x] += n
    if not letters:
        return LanguageModel(names, None, None)
    trie = Trie("".join(sorted(set(letters) | {c for p in pieces for c in p if letter[ord(c)]})), pieces)
    vocabulary = sorted({w for c in words.values() for w in c})
    counts = np.array([[words[g][w] for g in names] for w in vocabulary], float)
    table = trie.symbols()
    flat = table[np.frombuffer("".join(vocabulary).encode("utf-32-le"), np.uint32)]
    ends = np.cumsum([len(w) for w in vocabulary])
    starts = np.append(0, ends[:-1])
    prob = np.zeros((len(trie.pieces) + 1, len(names)))
    prob[1:] = 1 / len(trie.pieces)
    for _ in range(rounds):
        found = np.zeros_like(prob)
        for group, matrix in word_groups(flat, starts, ends):
            for some, part in chunks(group, matrix):
                found += expected(trie, prob, part, counts[some])
        found[1:] += 0.05
        prob = found / found[1:].sum(axis=0)
    return LanguageModel(names, trie, prob)


def learn(docs: DataFrame, pieces: list[str], sample: int = SAMPLE, rounds: int = ROUNDS) -> LanguageModel:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")) \
        .where("doc_id is not null and lang is not null and text is not null").where(_fold() != HELD_OUT)
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row a language
    if not counts:
        return LanguageModel([], None, None)
    # ids whose hash lies in the share of all that holds about four samples; of these the exact sample is ranked
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * sample / r["n"]))])[F.col("lang")]
    some = rows.select("lang", "doc_id").where((F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5) <= share)
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample).select("doc_id").distinct()
    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", "lang").toPandas().sort_values(["doc_id", "text", "lang"])
    return fit(found.text.tolist(), found.lang.tolist(), pieces, rounds)


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


class Reader:
    """Predicts batches of whole texts with a model."""

    def __init__(self, model: LanguageModel) -> None:
        self.model, self.table = model, model.trie.symbols() if model.trie else letter_table().astype(np.uint8)

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Per text: log-probability in each language, and whether it has a letter."""
        texts = pc.utf8_lower(pc.fill_null(texts, ""))
        size = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
        off = np.append(0, np.cumsum(size))
        flat = self.table[np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)]
        n = len(flat)
        out = np.zeros((len(texts), len(self.model.langs)))
        if not n:
            return out, np.zeros(len(texts), bool)
        inside = flat != 0
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        row = off[:-1][off[:-1] < n]
        first[row] = inside[row]
        end = off[1:][off[1:] > 0] - 1
        last[end] = inside[end]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        bound = np.searchsorted(starts, off)
        letters = np.diff(bound) > 0
        if self.model.trie is None or not len(starts):
            return out, letters
        p, q = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(7)) * p[:n], out=total[1:])
        _, index, back = np.unique(mix((total[ends] - total[starts]) * q[starts]), return_index=True, return_inverse=True)
        logs = np.zeros((len(index), out.shape[1]))
        s, e = starts[index], ends[index]
        for group, matrix in word_groups(flat, s, e):
            for some, part in chunks(group, matrix):
                logs[some] = forward(self.model.trie, self.model.prob, part)
        text = np.repeat(np.arange(len(texts)), np.diff(bound))
        for g in range(out.shape[1]):
            out[:, g] = np.bincount(text, logs[back, g], minlength=len(texts))
        return out, letters

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        sums, letters = self.sums(texts)
        if not self.model.langs or self.model.trie is None:
            return [NONE] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)
        share = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.model.langs[b] if x else NONE for b, x in zip(best, letters)], np.where(letters, share, 0.0)


def predicted(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """One row per document: held_out, lang_pred and score."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the vocabulary

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(spread.value)
        for batch in batches:
            for a, b in pieces_of(batch["text"], 1 << 22):
                lang, score = reader.predict(batch["text"][a:b])
                yield pa.RecordBatch.from_arrays([batch["doc_id"][a:b], batch["held_out"][a:b], pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=[c.split()[0] for c in COLUMNS.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(_fold() == HELD_OUT, F.lit(True)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, COLUMNS)
