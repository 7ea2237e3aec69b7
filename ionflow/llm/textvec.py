"""Vectorised tokenising and hashing of Arrow string columns with numpy.

Works on the UTF-8 bytes of the column directly: a polynomial hash modulo 2^64
of every word comes from one prefix sum over the bytes, so that the cost is a
few nanoseconds a byte and no Python object is made per word. Long words, for
which such a hash has known collisions, are hashed by BLAKE2 instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; longer texts are cut at a separator and rejoined.
CHUNK = 1 << 20
#: Bytes of a word beyond which it gets a cryptographic hash.
LONG_WORD = 48
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Hashes words of texts whose separators are given by a 256-entry mask.

    A-Z count as a-z. word_bytes[b] tells whether byte b belongs to a word.
    """

    def __init__(self, word_bytes: np.ndarray, prefixes: tuple[int, ...] = ()):
        """prefixes: byte lengths of word beginnings that are hashed too, as further columns."""
        self.prefixes = prefixes
        rng = np.random.Generator(np.random.PCG64(20240229))
        table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        table[65:91] = table[97:123]
        self.table, self.word = table, word_bytes.astype(bool)
        self._pow = self._inv = np.ones(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            r = 0x5851F42D4C957F2D
            inv = pow(r, -1, 1 << 64)
            self._pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, r, np.uint64)]))
            self._inv = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, inv, np.uint64)]))
        return self._pow[:n], self._inv

    def _piece(self, buf: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words of buf; cuts: where texts begin, and the end. Hash, start, length."""
        if not len(buf):
            z = np.zeros(0, np.int64)
            return np.zeros((0, 1 + len(self.prefixes)) if self.prefixes else 0, np.uint64), z, z
        inside = self.word[buf]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        at = cuts[:-1][cuts[:-1] < len(buf)]
        first[at] = inside[at]
        at = cuts[1:][cuts[1:] > 0] - 1
        last[at] = inside[at]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inv = self._powers(len(buf))
        total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.table[buf] * power, out=total[1:])
        whole = mix((total[e] - total[s]) * inv[s])
        for k in np.flatnonzero(e - s > LONG_WORD).tolist():
            word = buf[s[k] : e[k]].tobytes().lower()  # of bytes: A-Z alone
            whole[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if not self.prefixes:
            return whole, s, e - s
        starts = [mix((total[np.minimum(s + k, e)] - total[s]) * inv[s] + np.uint64(j + 1)) for j, k in enumerate(self.prefixes)]
        return np.stack([whole, *starts], axis=1), s, e - s

    def batches(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first row, last row, word hashes, words per row, byte starts, byte lengths) for row ranges.

        Starts count from the beginning of each row's own text. Nulls are empty.
        """
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type)
        offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        data = column.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        i, n = 0, len(column)
        while i < n:
            j = max(i + 1, int(np.searchsorted(offs, offs[i] + CHUNK, "right")) - 1)
            j = min(j, n)
            lo, hi = int(offs[i]), int(offs[j])
            if hi - lo <= 4 * CHUNK:
                h, s, w = self._piece(data[lo:hi], offs[i : j + 1] - lo)
                at = np.searchsorted(s, offs[i : j + 1] - lo)
                counts = np.diff(at)
                yield i, j, h, counts, s - np.repeat(offs[i:j] - lo, counts), w
            else:  # one long text, cut where a word ends
                parts, at = [], lo
                while at < hi:
                    end = min(at + CHUNK, hi)
                    while end < hi and self.word[data[end]]:  # never within a word, however long
                        stop = np.flatnonzero(~self.word[data[end : end + CHUNK]])
                        end += int(stop[0]) if len(stop) else min(CHUNK, hi - end)
                    h, s, w = self._piece(data[at:end], np.array([0, end - at]))
                    parts.append((h, s + (at - lo), w))
                    at = end
                h, s, w = (np.concatenate(x) for x in zip(*parts))
                yield i, j, h, np.array([len(h)]), s, w
            i = j


def separators(*codes: int) -> np.ndarray:
    mask = np.ones(256, bool)
    mask[list(codes)] = False
    return mask


#: Words are maximal runs of anything but space and \t to \r.
SPACED = separators(0x20, 9, 10, 11, 12, 13)
#: Words are maximal runs of ASCII letters, digits and non-ASCII characters.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])

_GRAM = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(words: np.ndarray, counts: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and the row of each; rows of 1 to k-1 words give one for the whole.

    k is at most 5.
    """
    rows = np.repeat(np.arange(len(counts)), counts)
    if len(words) >= k:
        m = len(words) - k + 1
        acc = words[:m] * _GRAM[0]
        for j in range(1, k):
            acc = acc + mix(words[j : j + m] + _GRAM[j])* _GRAM[j]
        ok = rows[:m] == rows[k - 1 :]
        full, at = mix(acc[ok]), rows[:m][ok]
    else:
        full, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        ends = np.cumsum(counts)
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            pos = (ends - counts)[short[has]] + j
            extra[has] = extra[has] + mix(words[pos] + _GRAM[j]) * _GRAM[j]
        extra = mix(extra + counts[short].astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        full, at = np.concatenate([full, extra]), np.concatenate([at, short])
    return full, at


def distinct_by_row(values: np.ndarray, rows: np.ndarray, n: int, order: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values within each row, sorted by order (or value): values, rows, counts."""
    by = np.lexsort((values if order is None else order, rows))
    v, r = values[by], rows[by]
    if len(v):
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
        v, r = v[new], r[new]
    return v, r, np.bincount(r, minlength=n)
