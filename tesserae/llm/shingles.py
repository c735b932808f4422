"""Word shingles of whole texts, many texts at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
_BLOCK = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True  # fixed values: what separates words
_LONG = 64  # bytes of a word from which it is hashed by itself
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k bytes of a lane
_TURNS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)  # odd
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and its inverse modulo 2**64, for k below n."""
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)]) for x in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(raw: bytes, halves: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes and start of every word: 64 bits, mixed after each eight bytes, from each of ``halves`` seeds."""
    b = np.frombuffer(raw, np.uint8)
    gap = _SPACE[b]
    word = ~gap
    starts = np.flatnonzero(word & np.r_[True, gap[:-1]])
    size = np.flatnonzero(word & np.r_[gap[1:], True]) + 1 - starts
    lanes = np.ndarray(len(b) + 1, "<u8", raw + bytes(8), strides=(1,))  # eight bytes from every place on
    out = []
    for turn in _TURNS[:halves]:
        h = mixed(size.astype(np.uint64) * turn)
        own = np.arange(len(size))
        for at in range(0, _LONG, 8):
            own = own[size[own] > at]
            if not len(own):
                break
            lane = lanes[starts[own] + at] & _KEEP[np.minimum(size[own] - at, 8)]
            h[own] = mixed((h[own] ^ lane) * turn)
        out.append(h)
    for k in np.flatnonzero(size > _LONG):
        whole = xxhash.xxh3_128_intdigest(raw[starts[k] : starts[k] + size[k]])
        for half, h in enumerate(out):
            h[k] = whole >> 64 * half & (1 << 64) - 1
    return out, starts


def _joined(words: np.ndarray, n: int, turn: np.uint64) -> np.ndarray:
    """A 64-bit hash of every run of n words."""
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h *= turn
        h += words[k : len(words) - n + 1 + k]
    return mixed(h + np.uint64(n))


def _runs(texts: Iterator[str | None], n: int, halves: int) -> Iterator[list[np.ndarray]]:
    """For each text and each of ``halves`` seeds: a hash of every run of n words."""

    def flush(raws: list[bytes]) -> Iterator[list[np.ndarray]]:
        columns, starts = _word_hashes(b"\n".join(raws), halves)
        cuts = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws)]))
        yield from runs(columns, cuts)

    def runs(columns: list[np.ndarray], cuts: np.ndarray) -> Iterator[list[np.ndarray]]:
        whole = [_joined(x, n, t) if len(x) >= n else x[:0] for x, t in zip(columns, _TURNS, strict=False)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a >= n:
                yield [x[a : b - n + 1] for x in whole]
            else:
                yield [_joined(x[a:b], b - a, t) if b > a else x[:0] for x, t in zip(columns, _TURNS, strict=False)]

    def long(raw: bytes) -> Iterator[list[np.ndarray]]:
        """A text over a block: its words a block at a time."""
        parts, lo = [], 0
        while lo < len(raw):
            gap = _GAP.search(raw, lo + _BLOCK) if lo + _BLOCK < len(raw) else None
            hi = gap.start() if gap else len(raw)
            parts.append(_word_hashes(raw[lo:hi], halves)[0])
            lo = hi
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        yield from runs(columns, np.array([0, len(columns[0])]))

    wait, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "replace").lower()  # of bytes: A-Z alone
        if wait and size + len(raw) > _BLOCK:
            yield from flush(wait)
            wait, size = [], 0
        if len(raw) > _BLOCK:
            yield from long(raw)
            continue
        wait.append(raw)
        size += len(raw) + 1
    if wait:
        yield from flush(wait)


def shingle_sets(texts: Iterator[str | None], n: int) -> Iterator[np.ndarray]:
    """The distinct n-word shingles of each text as sorted 64-bit hashes.

    A-Z count as a-z. Fewer than n words: the whole sequence is the only shingle. No words or no text: none.
    """
    for (own,) in _runs(texts, n, 1):
        yield np.unique(own)


def wide_sets(texts: Iterator[str | None], n: int) -> Iterator[np.ndarray]:
    """The same sets with a second, independent hash of each shingle: two rows, in the order of the first."""
    for first, second in _runs(texts, n, 2):
        own, at = np.unique(first, return_index=True)
        yield np.stack([own, second[at]])
