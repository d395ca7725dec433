"""Words and word shingles of an Arrow batch of texts as numpy columns, without a Python object per word.

Words are runs of bytes other than x20 and x09-x0D after A-Z are lower-cased. A word's 64-bit hash is a polynomial in
random values of its bytes, read off prefix sums and scrambled; equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once (one text at least): the arrays made from them take some 60 times as much.
SLICE = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one (the public splitmix64 finaliser)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values."""
    start = seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(start))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTE = random_words(256, 1)
_BASE = 0xD6E8FEB86659FD93
_UNBASE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _POWER["n"] < n:
        _POWER.update(n=n, up=_powers(_BASE, n), down=_powers(_UNBASE, n))
    return _POWER["up"][:n], _POWER["down"][:n]


@dataclass
class Words:
    """Words of some texts: text index, first byte and end, hash; ``sums`` are the prefix sums behind the hashes."""

    n_texts: int
    data: np.ndarray
    offsets: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, down = _power_tables(len(self.sums))
        return mix((self.sums[end] - self.sums[start]) * down[start])

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)

    def per_text(self) -> np.ndarray:
        return np.bincount(self.text, minlength=self.n_texts)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the texts in them) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = column.buffers()[2] if len(column) else None
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> Words:
    n = len(data)
    data = _LOWER[data] if lower else data
    blank = _SPACE[data]
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = blank[:-1], blank[1:]
    edges = offsets[1:-1]
    first[edges[edges < n]] = True
    last[edges[edges > 0] - 1] = True
    start, end = np.flatnonzero(first & ~blank), np.flatnonzero(last & ~blank) + 1
    up, _ = _power_tables(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return Words(len(offsets) - 1, data, offsets, np.searchsorted(offsets, start, "right") - 1, start, end, sums)


def shingles_of(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles, ordered by both; a text of fewer words has its whole sequence as one."""
    hashes, text = words.hashes(), words.text
    count = words.per_text()
    place = random_words(size, 2) | _U(1)
    n = len(hashes)
    total = np.zeros(n, _U)
    for k in range(size):
        at = max(0, n - k)
        same = text[:at] == text[k:]
        total[:at] += np.where(same, hashes[k:] * place[k], _U(0))
    if n:
        rank = np.arange(n) - np.searchsorted(text, text)  # of the word in its text
        whole = np.minimum(count[text], size)
        keep = rank <= count[text] - whole
        text, total = text[keep], mix(total[keep] + whole[keep].astype(_U))
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    fresh = np.ones(len(total), bool)
    fresh[1:] = (total[1:] != total[:-1]) | (text[1:] != text[:-1])
    return text[fresh], total[fresh]
