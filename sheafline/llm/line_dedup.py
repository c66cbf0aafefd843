"""Near-duplicate lines by an exact set-similarity join (operator 6).

A line is the set of its words, ordered by rarity in the corpus.  Lines whose
Jaccard similarity reaches the threshold share a word among the first few (the
prefix), have similar sizes, and share it at places that leave room for enough
others; pairs that pass are verified on their words.  A line goes if such a
line stands before it, in a document with a smaller id or above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import BLANK_CHARS, join_checked, release, small_batches, stored, words
from .setjoin import MOST_SENT, all_met, first_met, later, postings
from .rarity import rarity, sets_of
from .wordsets import all_words

THRESHOLD = 0.8


def line_sets(docs: DataFrame, classes: Any, threshold: float, id: str, text: str) -> DataFrame:
    """(id, pos, n, h, g, bits, more, prefix) of every line with a word.

    Words are 8 bits of rarity and 56 of hash, h and g 128 bits of hash of the
    set.  bits is a bitmap of parities: a bit is whether an odd number of words
    falls on it, so two sets differ in at least as many words as their bitmaps
    in bits.  A prefix lacks the words that stand once in the corpus.  Sets too
    small to be similar to any but an equal one (of up to three words at 0.8)
    have no prefix: their class settles them.
    """
    signed = lambda x: pa.array(x.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(classes.value, np.uint8)
        for batch in batches:
            w = all_words(batch.column(1))
            first, n, h, g, bits, more, ends, prefix = sets_of(w, table, threshold)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), signed(prefix))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(w.row[first])), pa.array(w.pos[first], pa.int32()), pa.array(n, pa.int32()), signed(h), signed(g), signed(bits), signed(more), lists,
            ], ["id", "pos", "n", "h", "g", "bits", "more", "prefix"])

    schema = StructType().add("id", docs.schema[id].dataType).add("pos", IntegerType()).add("n", IntegerType())
    schema = schema.add("h", LongType()).add("g", LongType()).add("bits", LongType()).add("more", LongType()).add("prefix", ArrayType(LongType()))
    return docs.select(F.col(id).alias("id"), text).mapInArrow(run, schema)


def matched_classes(docs: DataFrame, classes: DataFrame, threshold: float, id: str, text: str) -> DataFrame:
    """(id, pos) of the first line of every class to which a similar class begins before it.

    Lines are first compared with a few early and a few drawn ones for each of
    their rarest words; this settles nearly all members of a large group in
    proportion to their number.  Then all pairs are sought that share a prefix word and of
    which the later line isn't settled.
    """
    at = ["id", "pos"]
    first = first_met(postings(classes, threshold, at), threshold, at)
    settled = _verified(docs, first, threshold, id, text)
    release(first)
    flagged = stored(join_checked(classes, settled, at, "left", MOST_SENT), "line-flagged")
    open_ = F.when(later(at), F.col("x_settled").isNull()).otherwise(F.col("y_settled").isNull())
    pairs = all_met(postings(flagged, threshold, at, "settled", before=True), threshold, at, "settled", open_)
    release(flagged)
    rest = _verified(docs, pairs, threshold, id, text)
    out = stored(settled.unionByName(rest).select("id", "pos").distinct(), "line-matched")
    release(settled, rest, pairs)
    return out


def _verified(docs: DataFrame, pairs: DataFrame, threshold: float, id: str, text: str) -> DataFrame:
    """(id, pos, settled) of the lines x of pairs (x_id, x_pos, y_id, y_pos) that are similar to y, by the words themselves."""
    kept = pairs if hasattr(pairs, "_stored_at") else stored(pairs.distinct(), "line-candidates")
    either = F.array(*[F.struct(F.col(f"{s}_id").alias("id"), F.col(f"{s}_pos").alias("pos")) for s in "xy"])
    wanted = kept.select(F.explode(either).alias("l")).select("l.id", "l.pos").distinct().groupBy("id").agg(F.collect_list("pos").alias("at"))
    wanted = stored(wanted.withColumnRenamed("id", "__id"), "line-wanted")
    # narrow rows: sent to all tasks if counted to be few, so that texts stay where they are
    few = 2 * kept.count() <= MOST_SENT
    chosen = docs.join(F.broadcast(wanted) if few else wanted, F.col(id) == F.col("__id"))
    lines = chosen.select(F.col("__id").alias("id"), F.split(text, "\n").alias("lines"), F.explode("at").alias("pos"))
    sets = stored(lines.select("id", "pos", F.array_distinct(words(F.get("lines", F.col("pos")))).alias("w")), "line-words")
    of = lambda s: sets.select(*[F.col(c).alias(f"{s}_{c}") for c in ("id", "pos", "w")])
    both = kept.join(of("x"), ["x_id", "x_pos"]).join(of("y"), ["y_id", "y_pos"])
    shared = F.size(F.array_intersect("x_w", "y_w"))
    jaccard = shared / (F.size("x_w") + F.size("y_w") - shared)
    similar = both.filter(jaccard >= threshold - 1e-12).select(F.col("x_id").alias("id"), F.col("x_pos").alias("pos")).distinct()
    out = stored(similar.withColumn("settled", F.lit(True)), "line-similar")
    release(wanted, sets, *([] if kept is pairs else [kept]))
    return out


def kept_lines(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos) of every line with a word before which no similar one stands; pos counts from 0.

    Lines of equal sets of words are one class, of which only the first can stay.
    """
    small_batches(docs.sparkSession)
    table = docs.sparkSession.sparkContext.broadcast(rarity(docs, text))  # of a fixed size
    lines = line_sets(docs, table, threshold, id, text)
    first = F.min(F.struct("id", "pos", "n", "bits", "more", "prefix")).alias("first")
    classes = stored(lines.groupBy("h", "g").agg(first).select("first.*"), "line-classes")
    table.destroy()
    release()
    matched = matched_classes(docs, classes, threshold, id, text)
    out = stored(classes.select("id", "pos").join(matched, ["id", "pos"], "left_anti").distinct(), "line-kept")
    release(classes, matched)
    return out


def without_matches(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the text less its matched lines, `n_lines` and `n_removed` (long).

    Lines are what stands between \\n; those without words stay, and the order
    of the rest is kept.  A document without removed
    lines keeps its very text; null stays null with no lines.  Rows with a null
    id are not compared and stay as they are.  Rows that repeat an id are
    one place: what goes in one goes in all, the first line as well as none of
    them is later.  An empty table stays empty; other columns pass through,
    but n_lines and n_removed are replaced.
    """
    clear = docs.drop("n_lines", "n_removed")
    kept = kept_lines(clear.filter(F.col(id).isNotNull()), threshold, id, text)
    kept = kept.groupBy(F.col("id").alias("__id")).agg(F.collect_list("pos").alias("__kept"))
    found = clear.join(kept, F.col(id) == F.col("__id"), "left").withColumns({
        "__lines": F.split(F.col(text), "\n"), "__kept": F.coalesce("__kept", F.array().cast("array<int>")),
    })
    at = F.col("__lines")  # split once, not for each line
    blank = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: F.btrim(F.get(at, i), F.lit(BLANK_CHARS)) == "")
    # rows that repeat an id can have fewer lines than its places
    placed = found.withColumn("__at", F.filter(F.sort_array(F.array_union(blank, "__kept")), lambda i: i < F.size(at)))
    gone = F.when(F.col(id).isNull() | F.col(text).isNull(), F.lit(0)).otherwise(F.size(at) - F.size("__at"))
    left = F.array_join(F.transform("__at", lambda i: F.get(at, i)), "\n")
    return placed.withColumns({
        "n_lines": F.coalesce(F.size(at), F.lit(0)).cast("long"),
        "n_removed": gone.cast("long"),
        text: F.when(gone == 0, F.col(text)).otherwise(left),
    }).drop("__id", "__kept", "__at", "__lines")
