"""CRC-32 of joined strings from the CRCs and lengths of the parts, as arrays; and CRC-32 as DuckDB SQL.

Appending n bytes to a string is a linear map over bits of its CRC, kept as four tables of 256 numbers a length.
"""
from __future__ import annotations

from functools import lru_cache

import numpy as np

_BYTE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the public polynomial, reflected
    _BYTE = np.where(_BYTE & 1, (_BYTE >> np.uint32(1)) ^ np.uint32(0xEDB88320), _BYTE >> np.uint32(1))


def _tables(basis: np.ndarray) -> np.ndarray:
    """Images of all values of each of the four bytes, from the images of the 32 single bits."""
    out = np.zeros((4, 256), np.uint32)
    for bit in range(32):
        out[bit // 8] ^= np.where(np.arange(256) >> bit % 8 & 1, basis[bit], np.uint32(0))
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][x >> 8 & 255] ^ tables[2][x >> 16 & 255] ^ tables[3][x >> 24]


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """The map for 2**k bytes."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if k == 0:
        return _tables((bits >> np.uint32(8)) ^ _BYTE[bits & 255])
    half = _doubled(k - 1)
    return _tables(_apply(half, _apply(half, bits)))


@lru_cache(maxsize=1024)
def _behind(n: int) -> np.ndarray:
    """The map for n bytes."""
    x = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for k in range(n.bit_length()):
        if n >> k & 1:
            x = _apply(_doubled(k), x)
    return _tables(x)


class Parts:
    """Strings known by their CRC-32 and length in bytes, to be put behind others."""

    def __init__(self, crc: np.ndarray, length: np.ndarray) -> None:
        self.crc = crc.astype(np.uint32)
        sizes, self.which = np.unique(length, return_inverse=True)
        self.tables = np.stack([_behind(int(n)) for n in sizes]) if len(sizes) else np.zeros((0, 4, 256), np.uint32)

    def behind(self, first: np.ndarray, part: np.ndarray) -> np.ndarray:
        """CRC-32 of the strings that begin with those of CRC ``first`` and end with the parts of these numbers."""
        w, t = self.which[part], self.tables
        return t[w, 0, first & 255] ^ t[w, 1, first >> 8 & 255] ^ t[w, 2, first >> 16 & 255] ^ t[w, 3, first >> 24] ^ self.crc[part]


CRC_TABLE = """crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
  FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))))"""


def crc_sql(text: str) -> str:
    """DuckDB text of the unsigned CRC-32 of a string's UTF-8 bytes; needs ``crc_table.t`` in scope."""
    h = f"hex(encode({text}))"
    byte = f"list_transform(range(1, length({h}) + 1, 2), lambda k: CAST('0x' || substr({h}, k, 2) AS BIGINT))"
    return f"xor(list_reduce({byte}, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def lower_sql(text: str) -> str:
    """DuckDB text that lower-cases A-Z only."""
    upper = "".join(map(chr, range(65, 91)))
    return f"translate({text}, '{upper}', '{upper.lower()}')"
