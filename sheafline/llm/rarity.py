"""Words and shingles ordered by rarity in the corpus, and the sets of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .wordsets import Words, all_words, mixed, shingled, words

#: Hash buckets in which words are counted.
COUNT_BUCKETS = 1 << 20
COUNT_PARTS = 64
#: The byte of what stands once in the corpus, so no two sets share it.
UNSHARED = 5


def _counted(shingle: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            for w in [shingled(all_words(batch.column(0), lower=True), shingle)] if shingle else words(batch.column(0)):
                np.add.at(counts, w.hash & np.uint64(COUNT_BUCKETS - 1), 1)
        parts = [x.tobytes() for x in counts.reshape(COUNT_PARTS, -1)]
        yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array(parts, pa.binary())], ["part", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[part] = sums.get(part, 0) + np.frombuffer(counts, np.int64)
    of = [(np.minimum(120, 4 * np.log2(x + 1.0)).astype(np.uint8) + 1).tobytes() for x in sums.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(of, pa.binary())], ["part", "classes"])


def rarity(docs: DataFrame, text: str = "text", shingle: int = 0) -> bytes:
    """For each hash bucket of words (or shingles of so many) a byte: 1 + 4 * log2(1 + how many stand in all texts), rounded down.

    The order by (byte, hash) is one order for all sets whatever the counts, so
    results don't depend on buckets.  There are COUNT_BUCKETS bytes for any corpus.
    """
    counts = docs.select(text).mapInArrow(_counted(shingle), "part int, counts binary").repartition(COUNT_PARTS, "part")
    rows = counts.mapInArrow(_summed, "part int, classes binary").collect()  # COUNT_PARTS rows
    empty = bytes([1]) * (COUNT_BUCKETS // COUNT_PARTS)
    of = {r.part: bytes(r.classes) for r in rows}
    return b"".join(of.get(k, empty) for k in range(COUNT_PARTS))


def sets_of(w: Words, classes: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Of each line of w: its first word's place in w, n, h, g, bits, more, where its prefix ends, and all prefixes one after another.

    w has the words (or shingles) of lines in order.  They become 8 bits of
    rarity and 56 of hash; h and g are 128 bits of hash of the set.  bits and more are
    a bitmap of parities: a bit is whether an odd number of words falls on it.  A
    prefix lacks what stands once in the corpus, and sets that are too small
    to be similar to any but an equal one have none.
    """
    new = np.ones(len(w.hash), bool)
    new[1:] = (w.row[1:] != w.row[:-1]) | (w.pos[1:] != w.pos[:-1])
    first = np.flatnonzero(new)
    line = np.cumsum(new) - 1
    line = line.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32)  # those of 16 bits are sorted by radix
    key = (classes[w.hash & np.uint64(COUNT_BUCKETS - 1)].astype(np.uint64) << np.uint64(56)) | (w.hash >> np.uint64(8))
    by = np.argsort(key)
    by = by[np.argsort(line[by], kind="stable")]
    key, line = key[by], line[by]
    keep = np.ones(len(key), bool)
    keep[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    key, line = key[keep], line[keep]
    start = np.flatnonzero(np.diff(line, prepend=line[:1] + 1)) if len(line) else np.zeros(0, int)
    n = np.diff(start, append=len(key))
    if not len(n):
        return first, n, *[np.zeros(0, np.uint64)] * 4, n, key
    h, g = (np.add.reduceat(mixed(key, seed), start) for seed in (1, 2))
    one, half = np.uint64(1) << (key & np.uint64(63)), (key & np.uint64(64)) == 0
    bits, more = (np.bitwise_xor.reduceat(np.where(part, one, np.uint64(0)), start) for part in (half, ~half))
    size = np.where(n * (1 - threshold) >= threshold - 1e-9, n - np.ceil(n * threshold - 1e-9).astype(int) + 1, 0)
    ends = np.cumsum(size)
    prefix = key[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
    shared = prefix >> np.uint64(56) > UNSHARED
    return first, n, h, g, bits, more, np.concatenate(([0], np.cumsum(shared)))[ends], prefix[shared]
