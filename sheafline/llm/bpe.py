"""Byte-level BPE encoding and decoding by corpus-level merge replay (operator 1).

The distinct pre-tokens of a block of the corpus are laid out as one sequence
of symbols.  An inverted index leads from each mergeable pair to the positions
where it stands.  Ranks are then replayed in order: all positions of the lowest
rank merge, and only the pairs with the touched neighbours are indexed anew.
Texts are put together from the tokens of their pre-tokens.

A block is an Arrow batch; a worker numbers the pre-tokens that it meets and
keeps the tokens of those it meets often, so a later block replays only its new
ones.  Blocks change nothing in the results, as no merge crosses a pre-token.
One replay over the pre-tokens of all documents would need every occurrence
shuffled.
"""

from __future__ import annotations

import base64
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import compress, islice
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Words that each Python worker keeps when it has met twice as many.
MEMO = 100_000
#: Characters of new words that are replayed together.
BLOCK_CHARS = 2_000_000
#: Rows of an Arrow batch that are taken out of it together.
SLICE = 512

_codecs: dict[tuple[int, str], "Codec"] = {}


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Encoder and decoder of one rank file (lines of base64 token and rank) and split pattern."""

    def __init__(self, content: bytes, pattern: str) -> None:
        ranks = {t: r for r, t in tokens_of(content).items()}
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)])
        if self.byte.min() < 0:
            raise ValueError("a byte-level vocabulary has a token for each byte")
        #: (left << 32 | right) -> rank of their concatenation, as sorted arrays
        pair = {
            ranks[t[:k]] << 32 | ranks[t[k:]]: r
            for t, r in ranks.items() if len(t) > 1
            for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks
        }
        keys = np.fromiter(pair, np.int64, len(pair))
        by = np.argsort(keys)
        self.keys = np.append(keys[by], np.iinfo(np.int64).max)
        self.of_key = np.append(np.fromiter(pair.values(), np.int64, len(pair))[by], -1)
        self.split = regex.compile(pattern).findall
        #: Words that have been met, in the order of their numbers, and how often; a new one gets the next number.
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.met = np.zeros(0, np.int64)
        #: Their tokens one after another; those of word k stand from ends[k] to ends[k + 1].
        self.tokens, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of symbols; -1 where they don't merge or a word ends."""
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.of_key[at], -1)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words (int32), one word after another, and where each word's end."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1)
        n = int(ends[-1])
        sym = np.full(n, -1, np.int64)  # a -1 ends each word: no pair crosses it
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        sym[inside] = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        rank_at = np.full(n, -1, np.int64)  # rank of the pair that begins here
        rank_at[:-1] = self.rank(sym[:-1], sym[1:])
        index: dict[int, list[np.ndarray]] = {}  # the inverted index: pair (by its rank) -> positions
        heap: list[int] = []

        def enter(ranks: np.ndarray, at: np.ndarray) -> None:
            by = np.argsort(ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            firsts = [0, *cuts.tolist(), len(ranks)]
            for r, a, b in zip(ranks[firsts[:-1]].tolist(), firsts, firsts[1:], strict=False):
                if r in index:
                    index[r].append(at[a:b])
                else:
                    index[r] = [at[a:b]]
                    heapq.heappush(heap, r)

        there = np.flatnonzero(rank_at >= 0)
        if len(there):
            enter(rank_at[there], there)
        odd: list[np.ndarray] = []  # where a lower rank arose from a higher one
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            i = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            i = i[rank_at[i] == r]
            if not len(i):
                continue
            j = after[i]
            if len(i) > 1 and (j[:-1] == i[1:]).any():  # a run of one symbol: from the left, every other pair
                taken, last = [], -1
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    if a != last:
                        taken.append(a)
                        last = b
                    else:
                        last = -1
                i = np.array(taken)
                j = after[i]
            k = after[j]
            sym[i], sym[j], rank_at[j] = r, -2, -1
            after[i], before[k] = k, i
            p = before[i]  # -1 is the last place, where a word ends
            q_right, q_left = self.rank(sym[i], sym[k]), self.rank(sym[p], sym[i])
            rank_at[i] = q_right
            inner = sym[p] >= 0
            rank_at[p[inner]] = q_left[inner]
            q, at = np.concatenate((q_right, q_left)), np.concatenate((i, p))
            new = q >= 0
            if new.any():
                q, at = q[new], at[new]
                if q.min() <= r:
                    odd.append(at[q <= r])
                enter(q, at)
        kept = sym >= 0
        last = np.cumsum(kept)[ends - 1]
        ids = sym[kept].astype(np.int32)
        if odd:  # a vocabulary whose ranks aren't an order of training: such words one by one, leftmost lowest rank first
            lists = [x.tolist() for x in np.split(ids, last[:-1])]
            for k in np.unique(np.searchsorted(ends, np.concatenate(odd), "right")).tolist():
                lists[k] = self.plain(words[k])
            last = np.cumsum([len(x) for x in lists])
            ids = np.array([t for x in lists for t in x], np.int32)
        return ids, last

    def plain(self, word: bytes) -> list[int]:
        """One word by the definition: merge the leftmost pair of the lowest rank until none is left."""
        s = self.byte[np.frombuffer(word, np.uint8)].tolist()
        while len(s) > 1:
            ranks = self.rank(np.array(s[:-1]), np.array(s[1:])).tolist()
            found = [(r, i) for i, r in enumerate(ranks) if r >= 0]
            if not found:
                break
            r, i = min(found)
            s[i : i + 2] = [r]
        return s

    def _known(self, k: int) -> None:
        """Replays the words that are numbered k and above, so many characters at a time, and keeps their tokens."""
        words = list(islice(self.number, k, None))
        first, chars, parts = 0, 0, [(self.tokens, self.ends)]
        for i, w in enumerate(words):
            chars += len(w)
            if chars >= BLOCK_CHARS or i == len(words) - 1:
                ids, ends = self.replay([w.encode("utf-8") for w in words[first : i + 1]])
                parts.append((ids, ends + parts[-1][1][-1]))
                first, chars = i + 1, 0
        if len(parts) > 1:
            self.tokens, self.ends = (np.concatenate(x) for x in zip(*parts, strict=True))

    def _forget(self) -> None:
        """Keeps the words that were met most often, MEMO at most, when twice as many are known."""
        if len(self.number) <= 2 * MEMO:
            return
        most = np.sort(np.argsort(-self.met, kind="stable")[: min(MEMO, int((self.met > 1).sum()))])
        chosen = np.zeros(len(self.number), bool)
        chosen[most] = True
        words = list(compress(self.number, chosen.tolist()))
        self.number.clear()
        self.number.update(zip(words, range(len(words)), strict=True))
        self.tokens, ends = taken(self.tokens, self.ends[:-1][most], np.diff(self.ends)[most])
        self.ends = np.concatenate(([0], ends))
        self.met = self.met[most] >> 1

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens (int32) of all texts, one after another, and where each text's end."""
        k, split, number = len(self.number), self.split, self.number.__getitem__
        rows = [np.array(list(map(number, split(t))) if t else [], np.int32) for t in texts]
        self._known(k)
        word = np.concatenate([np.zeros(0, np.int32), *rows])
        self.met = np.append(self.met, np.zeros(len(self.number) - k, np.int64)) + np.bincount(word, minlength=len(self.number))
        ids, ends = taken(self.tokens, self.ends[word], self.ends[word + 1] - self.ends[word])
        self._forget()
        return ids, np.concatenate(([0], ends))[np.cumsum([len(r) for r in rows], dtype=np.int64)]


def taken(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of values that begin at start, one after another, and where each ends."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(start - (ends - size), size) + np.arange(total)], ends


def tokens_of(content: bytes) -> dict[int, bytes]:
    """The bytes of each token of a rank file."""
    return {int(b): base64.b64decode(a) for a, b in (line.split() for line in content.splitlines() if line)}


class Bytes:
    """The bytes of all tokens as one array, and where each token's are."""

    def __init__(self, content: bytes) -> None:
        tokens = tokens_of(content)
        row = [tokens.get(k, b"") for k in range(max(tokens) + 1)]
        self.size = np.fromiter(map(len, row), np.int64, len(row))
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(row), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of tokens one after another, and where each token's end."""
        return taken(self.all, self.start[ids], self.size[ids])


_tables: dict[int, Bytes] = {}


def _token_table(content: Any) -> Bytes:
    key = hash(content.value)
    if key not in _tables:
        _tables.clear()
        _tables[key] = Bytes(content.value)
    return _tables[key]


def codec(content: Any, pattern: str) -> Codec:
    key = (hash(content.value), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(content.value, pattern)
    return _codecs[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, array<int> of the tokens of every whole text, without special tokens.

    A null text is encoded as the empty one: no tokens.  Other columns pass
    through unchanged; a column named `out` is replaced.  Equal texts have
    equal tokens; row order and repeated rows don't matter.
    """
    small_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))  # a vocabulary: of a size that doesn't depend on the data

    @F.arrow_udf("array<int>")
    def ids(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coded = codec(content, pattern)
        for x in texts:
            found, ends = coded.encode(t for k in range(0, len(x), SLICE) for t in x.slice(k, SLICE).to_pylist())
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(found))

    return docs.withColumn(out, ids(F.col(text)))


def decode(frame: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """frame with `out`, the bytes (binary) that its tokens stand for; null or no tokens give no bytes."""
    content = frame.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def joined(table: Bytes, x: pa.Array) -> pa.Array:
        data, ends = table.decode(np.asarray(x.flatten()))
        size = np.asarray(pc.fill_null(pc.list_value_length(x), 0), np.int64)
        lists = np.concatenate(([0], np.cumsum(size)))
        at = np.concatenate(([0], ends))[lists].astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])

    @F.arrow_udf("binary")
    def decoded(lists: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _token_table(content)
        for x in lists:
            yield pa.concat_arrays([joined(table, x.slice(k, SLICE)) for k in range(0, len(x), SLICE)] or [pa.array([], pa.binary())])

    return frame.withColumn(out, decoded(F.col(ids)))
