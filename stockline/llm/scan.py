"""Word scanning and hashing of Arrow text batches, vectorised over their UTF-8 bytes.

Every operator that needs Python inside tasks reads its texts through these
functions. A batch is worked on in slabs of bounded size, so memory does not
depend on how many rows a batch has; one text is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLAB_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# Words of letters, digits and everything outside ASCII; UTF-8 bytes of such characters are all 128 or above.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
# Words of anything but white space.
DARK = np.ones(256, dtype=bool)
DARK[[9, 10, 11, 12, 13, 32]] = False

_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD1342543DE82EF95
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit changes about half of the output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLAB_BYTES + 2)
        have = np.full(size, base, dtype=U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        if size <= 8 * SLAB_BYTES:
            _powers[base] = have
    return have[:n]


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values * powers(base, len(values)), out=out[1:], dtype=U64)
    return out


def _between(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial hash of each span, whatever its position."""
    inverse = powers(pow(base, -1, 1 << 64), len(prefix))
    return (prefix[ends] - prefix[starts]) * inverse[starts]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slabs(offsets: np.ndarray, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or one row where that has more."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j
        i = j


class Words:
    """The words of consecutive texts: ``starts``/``ends`` in ``data``; text ``i`` owns words ``first[i]:first[i+1]``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, lower: bool = False):
        self.data = _LOWER[data] if lower else data
        mark = kind[self.data]
        begin, end = mark.copy(), mark.copy()
        begin[1:] &= ~mark[:-1]
        end[:-1] &= ~mark[1:]
        # A text's border ends a word, too.
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        begin[heads] = mark[heads]
        tails = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        end[tails] = mark[tails]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """For each word, the number of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def _span(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self._sums is None:
            self._sums = _prefix(self.data.astype(U64) + U64(1), _BASE)
        return mix(_between(self._sums, starts, ends, _BASE))

    def hashes(self) -> np.ndarray:
        return self._span(self.starts, self.ends)

    def heads(self, n: int) -> np.ndarray:
        """Hashes of each word's first ``n`` bytes (of the whole word where it is shorter)."""
        return self._span(self.starts, np.minimum(self.starts + n, self.ends))

    def tails(self, n: int) -> np.ndarray:
        return self._span(np.maximum(self.ends - n, self.starts), self.ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive items, also those that cross texts; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, dtype=U64)
    prefix = _prefix(hashes, _STEP)
    at = np.arange(len(hashes) - n + 1)
    return mix(_between(prefix, at, at + n, _STEP) + U64(n))


def window_min(values: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edge = np.diff(np.concatenate(([False], flags, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def covered(n: int, starts: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    """Which of ``n`` places lie in any of the spans ``starts .. starts + length``."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + length, n), -1)
    return np.cumsum(delta[:-1]) > 0
