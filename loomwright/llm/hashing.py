"""Vectorised hashing of words, word windows and byte windows.

Everything works on one chunk of concatenated UTF-8 texts, so that small
documents cost no per-document Python work and memory stays bounded by the
chunk, not by the block a task holds.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Texts are processed in chunks of about this many bytes (one longer text is a chunk of its own).
CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C15 | 1
_A = 0xD6E8FEB86659FD93 | 1
_B = 0xA0761D6478BD642F | 1
_MASK = (1 << 64) - 1


class _Powers:
    """Cumulative powers of an odd base modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse, self.size = base, pow(base, -1, 1 << 64), 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1 << 16)
            self.up = self._table(self.base)
            self.down = self._table(self.inverse)
        return self.up[:n], self.down[:n]

    def _table(self, base: int) -> np.ndarray:
        out = np.full(self.size, U64(base))
        out[0] = U64(1)
        return np.multiply.accumulate(out)


_POWERS = {p: _Powers(p) for p in (_P, _A, _B)}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """The finaliser of splitmix64, keyed by salt."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def sliding(values: np.ndarray, width: int, base: int = _P) -> np.ndarray:
    """A hash of each run of width consecutive values (uint64), by position."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    up, down = _POWERS[base].upto(len(values))
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up, out=total[1:])
    return (total[width:] - total[:-width]) * down[:n]


def chunks(texts: list[bytes]):
    """Yield (first index, last index, concatenated bytes, offsets) over texts; each is followed by a newline."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= CHUNK_BYTES or i == len(texts) - 1:
            part = texts[first : i + 1]
            offsets = np.zeros(len(part) + 1, np.int64)
            np.cumsum([len(x) + 1 for x in part], out=offsets[1:])
            yield first, i + 1, np.frombuffer(b"\n".join(part) + b"\n", np.uint8), offsets
            first, size = i + 1, 0


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and the number of its text in the chunk."""
    space = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits for each word."""
    up, down = _POWERS[_P].upto(len(data))
    total = np.empty(len(data) + 1, U64)
    total[0] = 0
    np.cumsum((data.astype(U64) + U64(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(_A))


def word_windows(hashes: np.ndarray, text_of: np.ndarray, width: int, wide: bool = False) -> tuple[np.ndarray, ...]:
    """Positions (of first words) of the windows of width words that lie in one text, and their hashes.

    wide: a second, independent hash of 32 bits follows.
    """
    if len(hashes) < width:
        none = np.empty(0, U64)
        return (np.empty(0, np.int64), none, none.astype(np.uint32))[: 3 if wide else 2]
    at = np.flatnonzero(text_of[width - 1 :] == text_of[: len(text_of) - width + 1])
    out = [at, mix(sliding(hashes, width, _A)[at], 1)]
    if wide:
        out.append((mix(sliding(mix(hashes, 7), width, _B)[at], 2) >> U64(32)).astype(np.uint32))
    return tuple(out)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z made a-z."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, in about log2(width) passes."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(out) - (width - have)], out[width - have :])
    return out


def covered(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """A mask of n places: those in any run of width places from one of starts."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, n), -1)
    return np.cumsum(delta[:-1]) > 0
