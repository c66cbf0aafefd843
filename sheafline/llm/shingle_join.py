"""Near-duplicate texts by exact Jaccard similarity of their word shingles.

SimHash links find copies that differ in few bits; a text of similarity 0.8
differs in about ten, with a spread that no feasible ball covers.  So they
only name pairs worth asking first, and an exact prefix join over the shingles
finds every other pair.  All links are verified on the shingles' 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, release, small_batches, stored
from .components import connected_components
from .rarity import rarity, sets_of
from .setjoin import MOST_SENT, linked
from .simhash import bit_majorities, links
from .wordsets import all_words, shingled

THRESHOLD = 0.8


def shingles(text: Column, shingle: int) -> Column:
    """array<long> of the different shingles' hashes, ascending."""

    @F.arrow_udf("array<long>")
    def sets(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in texts:
            w = shingled(all_words(x, lower=True), shingle)
            by = np.lexsort((w.hash, w.row))
            h, row = w.hash[by], w.row[by]
            keep = np.ones(len(h), bool)
            keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            ends = np.searchsorted(row[keep], np.arange(len(x) + 1))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h[keep].view(np.int64)))

    return sets(text)


def set_rows(text: Column, shingle: int, threshold: float, classes: Any) -> Column:
    """struct(fp, n, h, g, bits, more, prefix): SimHash and the set of a text's shingles, see sets_of(); all zero without words."""

    @F.arrow_udf("struct<fp:long,n:int,h:long,g:long,bits:long,more:long,prefix:array<long>>")
    def rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = np.frombuffer(classes.value, np.uint8)
        for x in texts:
            w = shingled(all_words(x, lower=True), shingle)
            first, n, h, g, bits, more, ends, prefix = sets_of(w, table, threshold)
            row = w.row[first]
            columns = []
            for values in (bit_majorities(w.hash, first), n, h, g, bits, more):
                of = np.zeros(len(x), np.int64)
                of[row] = values.view(np.int64)
                columns.append(pa.array(of))
            length = np.zeros(len(x) + 1, np.int64)
            length[row + 1] = np.diff(ends, prepend=0)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(length), pa.int32()), pa.array(prefix.view(np.int64)))
            columns[1] = columns[1].cast(pa.int32())
            yield pa.StructArray.from_arrays([*columns, lists], ["fp", "n", "h", "g", "bits", "more", "prefix"])

    return rows(text)


def similar_texts(docs: DataFrame, pairs: DataFrame, threshold: float, shingle: int, id: str, text: str) -> DataFrame:
    """The pairs (x_id, y_id) of ids whose texts reach the threshold."""
    kept = pairs if hasattr(pairs, "_stored_at") else stored(pairs.distinct(), "text-candidates")
    wanted = stored(kept.select(F.explode(F.array("x_id", "y_id")).alias("id")).distinct(), "text-wanted")
    of_wanted = join_checked(docs.select(F.col(id).alias("id"), F.col(text).alias("text")), wanted, ["id"], rows=MOST_SENT)
    sets = stored(of_wanted.select("id", shingles(F.col("text"), shingle).alias("items")), "text-sets")
    side = lambda s: sets.select(F.col("id").alias(f"{s}_id"), F.col("items").alias(f"{s}_items"))
    shared = F.size(F.array_intersect("x_items", "y_items"))
    likeness = shared / (F.size("x_items") + F.size("y_items") - shared)
    both = kept.join(side("x"), "x_id").join(side("y"), "y_id")
    out = stored(both.filter(likeness >= threshold - 1e-12).select("x_id", "y_id").distinct(), "text-similar")
    release(wanted, sets, *([] if kept is pairs else [kept]))
    return out


def near_texts(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = 5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, component_id) of every row of docs with an id, over links of texts with Jaccard >= threshold.

    component_id is the smallest id that can be reached.  Texts of equal
    shingles are linked, those without words too.  A-Z are lower-cased, words
    are runs without ASCII blanks, and a text of fewer words than a shingle is
    one.  No pair is missed that isn't in one component anyway: a text is
    compared with texts of near fingerprints (three differing bits) and with
    the first ones that have its rarest shingles, and then all pairs are sought
    that share a prefix shingle and aren't connected.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.filter(F.col(id).isNotNull())
    table = spark.sparkContext.broadcast(rarity(known, text, shingle))  # of a fixed size
    own = stored(known.select(F.col(id).alias("id"), set_rows(F.col(text), shingle, threshold, table).alias("s")).select("id", "s.*"), "text-rows")
    table.destroy()
    first = F.min(F.struct("id", "fp", "bits", "more", "prefix")).alias("x")
    classes = stored(own.groupBy("h", "g", "n").agg(first).select("h", "g", "n", "x.*"), "text-classes")
    rows = stored(own.select("id", "h", "g", "n"), "text-keys")
    release(own)

    prints = stored(classes.groupBy("fp").agg(F.min("id").alias("least")), "text-prints")
    pair = lambda a, b: [F.greatest(a, b).alias("x_id"), F.least(a, b).alias("y_id")]
    same = classes.join(prints, "fp").filter(F.col("id") != F.col("least")).select(*pair("id", "least"))
    of = lambda s: prints.select(F.col("fp").alias(s), F.col("least").alias(f"{s}_id"))
    close = links(prints, "fp", 3).distinct().join(of("a"), "a").join(of("b"), "b").select(*pair("a_id", "b_id"))
    similar = lambda pairs: similar_texts(known, pairs, threshold, shingle, id, text)
    found = linked(classes.select("id", "n", "bits", "more", "prefix"), similar, threshold, same.unionByName(close))

    parts = connected_components(found, "text-components")
    of_class = classes.select("h", "g", "n", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("h", "g", "n", F.coalesce("component", "id").alias("component_id"))
    out = stored(rows.join(of_class, ["h", "g", "n"]).select(F.col("id").alias(id), "component_id"), "text-groups")
    release(classes, rows, prints, found, parts)
    return out
