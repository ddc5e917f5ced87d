"""Token ids of whole texts under a public word-BPE vocabulary, vectorised over batches.

The vocabulary's pre-tokeniser never joins characters across white space, and splits letters from
punctuation; so a text's ids are those of its units in order. Units are cut with numpy on the UTF-8
bytes, and the library encodes each distinct unit once per worker. Stretches between white space that
hold anything but ASCII or Latin-1 letters, digits and plain punctuation (an apostrophe, "<", other
scripts, control characters) stay whole and are given to the tokenizer as they are.
"""
from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from touchline.llm.words import _BYTE, _powers, mix, utf8_bytes

_SPACE, _LETTER, _DIGIT, _PUNCT, _WHOLE = range(5)
_CLASS = np.full(256, _WHOLE, np.uint8)
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[33:127] = _PUNCT
_CLASS[[ord("'"), ord("<")]] = _WHOLE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SLOTS = 1 << 20
MOST = 1_500_000  # distinct units a worker remembers; beyond that it starts afresh


def _byte_chars() -> dict[int, str]:
    """The public byte-to-character rule of byte-level BPE: printable bytes stand for themselves, the others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class WordIds:
    _made: dict[str, WordIds] = {}

    @classmethod
    def of(cls, name: str) -> WordIds:
        if name not in cls._made:
            cls._made[name] = cls(name)
        return cls._made[name]

    def __init__(self, name: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if not os.path.exists(name):
            import public_tokenizers

            name = public_tokenizers.path(name)
        self.whole = Tokenizer.from_file(name)
        chars = _byte_chars()
        self.chars = [chars[b] for b in range(256)]
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # all known units, sorted
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.slot_key = np.zeros(SLOTS, np.uint64)  # the first known unit of each slot, found without a search
        self.slot_at = np.zeros(SLOTS, np.int64)
        self.slot_size = np.zeros(SLOTS, np.int32)

    def _encode(self, unit: bytes, letters: bool) -> list[int]:
        if letters:
            return [t.id for t in self.whole.model.tokenize("".join([self.chars[b] for b in unit]))]
        return self.whole.encode(unit.decode(), add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, units: list[bytes], letters: list[bool]) -> None:
        """keys ascending, none known yet."""
        new = [self._encode(u, x) for u, x in zip(units, letters)]
        size = np.array([len(x) for x in new], np.int32)
        total = int(size.sum())
        if self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(total, len(self.pool)), np.uint32)])
        self.pool[self.used:self.used + total] = [i for x in new for i in x]
        at = self.used + np.cumsum(size) - size
        self.used += total
        put = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, put, keys), np.insert(self.at, put, at), np.insert(self.size, put, size)
        slot = (keys & np.uint64(2 * SLOTS - 1)).astype(np.int64) >> 1  # the lowest bit is always 1
        free = self.slot_key[slot] == 0
        self.slot_key[slot[free]], self.slot_at[slot[free]], self.slot_size[slot[free]] = keys[free], at[free], size[free]

    def rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows one after another, and the n + 1 row offsets into them (null: no ids)."""
        data, off = utf8_bytes(texts)
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        kind = _CLASS[data]
        low = _LOWER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3) if n > 1 else np.zeros(0, np.int64)
        after = data[lead + 1]
        safe = lead[(after != 0x97) & (after != 0xB7)]
        kind[safe] = kind[safe + 1] = _LETTER
        upper = lead[(after < 0x9F) & (after != 0x97)] + 1
        low[upper] += 32
        inside = kind != _SPACE
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        rows = off[:-1][off[:-1] < n]
        first[rows] = inside[rows]
        chunk = np.flatnonzero(first)
        if not len(chunk):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        odd = np.logical_or.reduceat(kind == _WHOLE, chunk)
        cut = first.copy()
        cut[1:] |= inside[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT))
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = off[1:][off[1:] > 0] - 1
        last[ends] = inside[ends]
        chunk_end = np.flatnonzero(last) + 1
        for c in np.flatnonzero(odd).tolist():  # rare
            a, b = chunk[c], chunk_end[c]
            cut[a + 1:b] = False
            kind[a:b] = _WHOLE
            low[a:b] = data[a:b]
        start = np.flatnonzero(cut)
        stop = chunk_end[np.searchsorted(chunk_end, start, side="right")]
        stop[:-1] = np.minimum(stop[:-1], start[1:])
        p, q = _powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[low] * p[:n], out=total[1:])
        key = mix((total[stop] - total[start]) * q[start]) | np.uint64(1)
        if len(self.keys) > MOST:
            self._forget()
        at, size = self._find(key, start, stop, low, kind)
        done = np.cumsum(size)
        ids = self.pool[np.arange(done[-1]) + np.repeat(at - done + size, size)]
        bound = np.searchsorted(start, off)
        return ids, np.concatenate([[0], done])[bound]

    def _find(self, key, start, stop, low, kind):
        slot = (key & np.uint64(2 * SLOTS - 1)).astype(np.int64) >> 1
        at, size = self.slot_at[slot], self.slot_size[slot].astype(np.int64)
        miss = np.flatnonzero(self.slot_key[slot] != key)
        if len(miss):
            new, index, back = np.unique(key[miss], return_index=True, return_inverse=True)
            place = np.searchsorted(self.keys, new)
            known = np.zeros(len(new), bool)
            ok = place < len(self.keys)
            known[ok] = self.keys[place[ok]] == new[ok]
            which = np.flatnonzero(~known)
            if len(which):
                one = miss[index[which]]
                bounds = list(zip(start[one].tolist(), stop[one].tolist()))
                self._learn(new[which], [low[a:b].tobytes() for a, b in bounds], (kind[start[one]] == _LETTER).tolist())
                place = np.searchsorted(self.keys, new)
            at[miss], size[miss] = self.at[place][back], self.size[place][back]
        return at, size
