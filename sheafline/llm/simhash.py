"""SimHash near-duplicates by multi-index hashing (operator 7).

Fingerprints of 64 bits that differ in at most three bits agree, in one of
their two 32-bit segments, in all bits but one at most.  Each segment has a
table; around each segment of a fingerprint the Hamming ball of radius one is
enumerated, looked up in the table, and complete distances are verified.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored
from .components import connected_components

SEED = 42
#: Shingles whose bits are counted together: bounds memory for very long texts.
BLOCK = 50_000


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes (uint64) of a text's word shingles in order, BLOCK at a time; none without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    joined = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    first, last = starts[: len(w) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(first), BLOCK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)], "<u8")


def bits_of(hashes: Iterable[np.ndarray]) -> int:
    """The bits that more than half of all hashes have; 0 without any."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def bit_majorities(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The fingerprint (uint64) of each run of hashes that begins at `first`."""
    size = np.diff(first, append=len(hashes))
    ones = np.zeros((len(first), 64), np.int64)
    at = 0
    while at < len(first):  # runs of about BLOCK hashes in all, or a longer one in pieces
        to = max(at + 1, int(np.searchsorted(first, first[at] + BLOCK, "right")) - 1) if first[-1] > first[at] + BLOCK else len(first)
        end = first[to] if to < len(first) else len(hashes)
        if end - first[at] <= 2 * BLOCK:
            bits = np.unpackbits(hashes[first[at] : end].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[at:to] = np.add.reduceat(bits, first[at:to] - first[at], axis=0, dtype=np.int64)
        else:
            for k in range(at, to):
                for s in range(first[k], first[k] + size[k], BLOCK):
                    piece = hashes[s : min(s + BLOCK, first[k] + size[k])]
                    ones[k] += np.unpackbits(piece.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        at = to
    return np.packbits(2 * ones > size[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprint_of(text: str | None, shingle: int) -> int:
    """The fingerprint as an unsigned integer; texts without words have 0."""
    return bits_of(shingle_hashes(text, shingle))


def fingerprint(text: Column, shingle: int) -> Column:
    """long with the 64 bits of the SimHash of a text's word shingles.

    A-Z are lower-cased, words are runs without ASCII blanks, repeated shingles
    count each time; a text of fewer words has one shingle, and one without
    words (or null) the fingerprint 0.
    """

    @F.arrow_udf("long")
    def bits(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            yield pa.array(np.array([fingerprint_of(t, shingle) for t in x.to_pylist()], np.uint64).view(np.int64))

    return bits(text)


#: The low 32 bits.
LOW = 0xFFFFFFFF


def _segments(fp: Column) -> Column:
    """The two segments, each with its table's number in a higher bit: array<long>."""
    return F.array(F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(LOW)).bitwiseOR(F.lit(1 << 32)))


def links(fingerprints: DataFrame, fp: str = "fp", radius: int = 3) -> DataFrame:
    """(a, b) of distinct fingerprints (long) with at most `radius` <= 3 differing bits, a < b; pairs may repeat.

    Of two segments that differ in one bit only the one without it probes.  So
    a fingerprint has two rows in the tables and 34 look-ups on average,
    whatever the number of fingerprints.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two segments with balls of radius one find up to three differing bits")
    own = fingerprints.select(F.col(fp).alias("f"))
    rows = own.select("f", F.explode(_segments(F.col("f"))).alias("s"))
    probes = rows.select(
        F.col("f").alias("p"),
        F.explode(F.expr("concat(array(s), transform(filter(sequence(0, 31), i -> (shiftright(s, i) & 1L) = 0L), i -> s | shiftleft(1L, i)))")).alias("s"),
    )
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("f"))) <= radius
    return probes.join(rows, "s").filter((F.col("p") != F.col("f")) & near).select(F.least("p", "f").alias("a"), F.greatest("p", "f").alias("b"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, radius: int = 3) -> DataFrame:
    """(id, fp long, component_id, n_links long) for every row of docs.

    component_id is the smallest id that can be reached over links between
    fingerprints of at most `radius` differing bits; equal fingerprints (those
    of texts without words too) are linked.  n_links is the number of other
    fingerprints that this one links to.  Rows with a null id get the component
    of their fingerprint, or null where no row of it has an id.  Rows may
    repeat; an empty table gives an empty result.  Extra columns are ignored.

    All work beyond the fingerprints is on classes of equal ones, so thousands
    of copies are one row there.
    """
    small_batches(docs.sparkSession)
    own = stored(docs.select(F.col(id).alias("id"), fingerprint(F.col(text), shingle).alias("fp")), "fingerprints")
    classes = stored(own.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    pairs = stored(links(classes, "fp", radius).distinct(), "fingerprint-links")
    # the classes' least ids are the nodes, so that a component's least node is its least id
    ids = classes.filter("least is not null")
    named = (
        pairs.join(ids.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a")
        .join(ids.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )
    found = connected_components(named)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    of_class = (
        classes.join(found.withColumnRenamed("node", "least"), "least", "left").join(degree, "fp", "left")
        .select("fp", F.coalesce("component", "least").alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )
    return own.join(of_class, "fp").select(F.col("id").alias(id), "fp", "component_id", "n_links")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
