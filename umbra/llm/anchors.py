"""Sampled substring fingerprints in numpy: the vectorised core of the operators that find repeated passages.

A document is a sequence of symbols (bytes, or hashes of words). For windows of W symbols, the *anchor* of a window is
the leftmost of its W - w + 1 subwindows of w symbols whose fingerprint is least. Which subwindow that is depends on
the window's content alone, so two equal windows have equal anchors at equal offsets: windows that occur twice are
found by looking only at anchors that occur twice, and anchors are only about 2 / (W - w + 2) of all positions.

Fingerprints are trees: that of 2 n symbols mixes those of its halves, and that of another length mixes those of its
powers of two. Mixing isn't linear, so structured sequences (Thue-Morse and the like) meet no more often than others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Multiplier of fingerprints, and the mixing constants of splitmix64. Fixed values.
MULTIPLIER = 0x9E3779B97F4A7C15
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Symbols that are processed at a time (arrays then stay in the processor's cache), and bits of a position in a piece.
PIECE = 1 << 17
POSITION_BITS = 24

BYTE_VALUES = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The fingerprint of two neighbours, from theirs."""
    return mixed(a * np.uint64(MULTIPLIER) + b)


class Fingerprints:
    """Fingerprints of all windows of power-of-two lengths over an array of symbol values."""

    def __init__(self, values: np.ndarray, longest: int):
        self.by = {1: values}
        n, now = 1, values
        while 2 * n <= longest and len(now) > n:
            now = joined(now[:-n], now[n:])
            n *= 2
            self.by[n] = now

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        """Fingerprints of the windows of one length that begin at the starts."""
        out, done = np.zeros(len(starts), np.uint64), 0
        for n in sorted(self.by, reverse=True):
            while length - done >= n:
                part = self.by[n][starts + done]
                out = joined(out, part) if done else part
                done += n
        return out

    def all(self, length: int) -> np.ndarray:
        """The same for every start."""
        size = max(len(self.by[1]) - length + 1, 0)
        out, done = np.zeros(size, np.uint64), 0
        for n in sorted(self.by, reverse=True):
            while size and length - done >= n:
                part = self.by[n][done : done + size]
                out = joined(out, part) if done else part
                done += n
        return out


def least_of(keys: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive keys."""
    n, now = 1, keys
    while 2 * n <= k:
        now = np.minimum(now[:-n], now[n:])
        n *= 2
    return np.minimum(now[: len(keys) - k + 1], now[k - n : len(keys) - n + 1]) if n < k else now


def chunked(lengths: list[int], pad: int, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents whose padded symbols make about a piece."""
    start, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n + pad > piece:
            yield start, k
            start, held = k, 0
        held += n + pad
    if start < len(lengths):
        yield start, len(lengths)


def padded(docs: list[np.ndarray], pad: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents' values in one array with ``pad`` zeros before and after each, and where each begins."""
    sizes = np.array([len(x) for x in docs], np.int64)
    starts = pad + np.concatenate([[0], np.cumsum(sizes + pad)[:-1]]) if len(docs) else np.zeros(0, np.int64)
    out = np.zeros(int(sizes.sum()) + pad * (len(docs) + 1), np.uint64)
    for start, doc in zip(starts.tolist(), docs, strict=True):
        out[start : start + len(doc)] = doc
    return out, starts


def anchors(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int, sub: int, prints: Fingerprints) -> np.ndarray:
    """Ascending positions of the anchors of all windows that lie within a document."""
    k = window - sub + 1
    full = np.flatnonzero(sizes >= window)
    if not len(full):
        return np.zeros(0, np.int64)
    low = np.uint64((1 << POSITION_BITS) - 1)
    hashes = mixed(prints.all(sub))
    chosen = np.zeros(len(values), bool)
    # A piece may be longer than positions have bits for (one very long document): cut it, windows overlapping.
    step = (1 << POSITION_BITS) - window
    first, last = starts[full], starts[full] + sizes[full] - window + 1
    edge = np.zeros(len(values) + 1, np.int8)
    edge[first] += 1
    edge[last] -= 1
    valid = np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    for at in range(0, len(hashes), step):
        part = hashes[at : at + step + k - 1]
        if len(part) < k:
            break
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        best = least_of(keys, k)
        best = best[valid[at : at + len(best)]]
        chosen[at + (best & low).astype(np.int64)] = True
    return np.flatnonzero(chosen)


#: Perfect difference sets by period: each non-zero remainder is a difference of two members once. Fixed values.
PERFECT = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}


def positional(n: int, period: int) -> np.ndarray:
    """Places below n whose remainder by the period is in a difference cover: each difference of two remainders occurs
    between two members of the cover. Without a perfect one, the cover is 0..r and the multiples of r + 1, with r about
    the root of half the period."""
    r = max(1, int(np.ceil(np.sqrt(period / 2))))
    members = np.array(PERFECT[period]) if period in PERFECT else np.unique(np.concatenate([np.arange(r + 1), np.arange(0, period, r + 1)]) % period)
    return np.flatnonzero(np.isin(np.arange(n) % period, members))
