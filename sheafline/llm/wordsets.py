"""Words of texts as 64-bit hashes, whole Arrow batches at a time, without a Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that are taken up together, unless a single word is longer.
SLICE_BYTES = 1 << 17
#: Longer words are hashed one by one.
LONG_WORD = 256
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_up: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if not _up:
        n = max(SLICE_BYTES, LONG_WORD)
        _up.extend((_powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)))
    return _up


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all others."""
    x = x + np.uint64(seed)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Words(NamedTuple):
    """Of each word its hash, row and line: pos counts from 0 within the row's text."""

    hash: np.ndarray
    row: np.ndarray
    pos: np.ndarray


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _hashes(b: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the words b[first:last] of a slice: a polynomial of their bytes, spread."""
    up, down = _tables()
    size = last - first
    if len(b) > SLICE_BYTES or (size > LONG_WORD).any():
        data = b.tobytes()
        out = np.empty(len(first), np.uint64)
        for k, (s, e) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            if e - s > LONG_WORD:
                out[k] = xxhash.xxh64_intdigest(data[s:e])
            else:  # as below
                out[k] = mixed(((b[s:e] + np.uint64(1)) * up[: e - s]).sum(dtype=np.uint64).reshape(1))[0]
        return out
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[: len(b)], out=total[1:])
    return mixed((total[last] - total[first]) * down[first])


def _filled(at: np.ndarray, n: int) -> np.ndarray:
    """For each of n places how many of the ascending `at` are not beyond it."""
    return np.repeat(np.arange(len(at) + 1), np.diff(at, prepend=0, append=n))


def words(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of a string array in order, some rows at a time; nulls have none.

    A row is cut between blanks if it is long; its parts follow each other.
    With `lower`, A-Z are hashed like a-z.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, "right")) - 1)
        at, stop, lines = int(offsets[row]), int(offsets[end]), 0
        while True:  # once, but for a long row
            cut = stop
            if stop - at > SLICE_BYTES:
                blanks = np.flatnonzero(_BLANK[whole[at : at + SLICE_BYTES]])
                if len(blanks):
                    cut = at + int(blanks[-1]) + 1
                else:  # a word beyond a slice
                    step = SLICE_BYTES
                    while not len(blanks) and at + step < stop:
                        blanks = np.flatnonzero(_BLANK[whole[at + step : at + 2 * step]])
                        cut = min(stop, at + step + int(blanks[0]) + 1) if len(blanks) else stop
                        step *= 2
            b = _LOWER[whole[at:cut]] if lower else whole[at:cut]
            bounds = offsets[row : end + 1] - at
            blank = _BLANK[b]
            new = np.zeros(len(b) + 1, bool)
            new[bounds[(bounds >= 0) & (bounds <= len(b))]] = True
            new[[0, -1]] = True
            before = np.ones(len(b) + 1, bool)
            before[1:] = blank
            after = np.ones(len(b) + 1, bool)
            after[:-1] = blank
            first = np.flatnonzero(~after & (before | new))
            last = np.flatnonzero(~before & (after | new))
            breaks = np.flatnonzero(b == 10)
            of = _filled(np.searchsorted(first, np.maximum(bounds[:-1], 0)), len(first)) - 1
            pos = _filled(np.searchsorted(first, breaks), len(first)) + (lines - np.searchsorted(breaks, np.maximum(bounds, 0)))[of]
            yield Words(_hashes(b, first, last), of + row, pos)
            lines += len(breaks)
            at = cut
            if at >= stop:
                break
        row = end


def all_words(texts: pa.Array, lower: bool = False) -> Words:
    parts = list(words(texts, lower)) or [Words(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))]
    return Words(*map(np.concatenate, zip(*parts, strict=True)))


def shingled(w: Words, size: int) -> Words:
    """Hashes of the runs of `size` words of each row, in order; of a row of fewer words the whole sequence."""
    factor = mixed(np.arange(size, dtype=np.uint64), 7) | np.uint64(1)
    count = len(w.hash)
    if not count:
        return w
    start = np.flatnonzero(np.diff(w.row, prepend=-1))
    n = np.diff(start, append=count)
    whole = max(count - size + 1, 0)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total[:whole] += w.hash[k : k + whole] * factor[k]
    left = np.repeat(start + n, n) - np.arange(count)  # words to the end of the row
    few = np.repeat(n < size, n)
    if few.any():
        at = np.arange(count) - np.repeat(start, n)
        own = np.where(few, w.hash * factor[np.minimum(at, size - 1)], np.uint64(0))
        short = start[n < size]
        total[short] = np.add.reduceat(own, start)[n < size] + n[n < size].astype(np.uint64)
        left[short] = size
    keep = left >= size
    return Words(mixed(total[keep], 11), w.row[keep], np.zeros(int(keep.sum()), int))
