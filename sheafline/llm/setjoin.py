"""Parts of exact Jaccard joins with prefix, positional, length and bitmap filters.

A set is a row with the columns `at` that name it, n (its size), bits and more
(a bitmap of the parities of its items, see parity()) and prefix: those of its
first items that can be shared, in an order by rarity that is one for all sets.
What can't be shared comes first in that order and needn't be in the prefix.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import join_checked, release, stored
from .components import connected_components

#: Of the sets with an item, so many are met first.
LEADERS = 4
#: Of a set's prefix items, so many of the rarest ones lead to others that are met first.
RAREST = 4
#: Narrow rows that are broadcast at most.
MOST_SENT = 1_000_000
#: Postings of an item that needn't be paired with each other are set apart beyond so many.
HOT = 256
#: Items are joined in so many blocks, one after another, so that only a part of all postings is shuffled at a time.
BLOCKS = 4
#: The same, where sets meet a few others for their rarest items.
BLOCKS_FIRST = 2


def prefix_length(n: Column, threshold: float) -> Column:
    return n - F.ceil(n * threshold - 1e-9) + 1


def needed(a: Column, b: Column, threshold: float) -> Column:
    """Items that sets of so many have to share."""
    return F.ceil((a + b) * (threshold / (1 + threshold)) - 1e-9)


def parity(items: str, bit: int) -> Column:
    """64 bits: whether an odd number of items (long) with `bit` (0 or 64) falls on each.

    Two sets differ in at least as many items as in these bits.
    """
    return F.expr(f"aggregate({items}, 0L, (a, x) -> a ^ if((x & 64L) = {bit}L, shiftleft(1L, cast(x & 63L as int)), 0L))")


def postings(sets: DataFrame, threshold: float, at: list[str], *others: str, before: bool = False) -> DataFrame:
    """(t, *at, p, bits, more, k, *others) for each item t of a prefix: p packs n and i, its place in the ordered set; k is its place in the prefix.

    With `before` also b, the item that stands before t in the prefix; null is none.
    """
    unshared = prefix_length(F.col("n"), threshold) - F.size("prefix")  # they stand first
    own = [*at, "n", "bits", "more", unshared.alias("u"), *others]
    if before:
        size = F.size("prefix")
        ahead = F.concat(F.array(F.lit(None).cast("long")), F.slice("prefix", 1, F.greatest(size - 1, F.lit(0))))
        both = F.when(size > 0, F.arrays_zip(F.col("prefix").alias("t"), ahead.alias("b")))
        flat = sets.select(*own, F.posexplode(both).alias("k", "__i")).withColumns({"t": F.col("__i.t"), "b": F.col("__i.b")})
    else:
        flat = sets.select(*own, F.posexplode("prefix").alias("k", "t"))
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR((F.col("u") + F.col("k")).cast("long"))
    return flat.select("t", *at, packed.alias("p"), "bits", "more", "k", *others, *["b"] * before)


def n_of(p: str) -> Column:
    return F.shiftright(p, 32)


def i_of(p: str) -> Column:
    return F.col(p).bitwiseAND(F.lit(0xFFFFFFFF))


def room(threshold: float) -> Column:
    """Length, positional and bitmap filters of x and y (p, bits, more)."""
    n, m = n_of("x_p"), n_of("y_p")
    share = needed(n, m, threshold)
    apart = [F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in ("bits", "more")]
    return (
        (F.least(n, m) >= threshold * F.greatest(n, m) - 1e-9) & (F.least(n - i_of("x_p"), m - i_of("y_p")) >= share)
        & (apart[0] + apart[1] <= n + m - 2 * share)
    )


def side(frame: DataFrame, name: str, at: list[str], *others: str) -> DataFrame:
    return frame.select("t", *[F.col(c).alias(f"{name}_{c}") for c in (*at, "p", "bits", "more", *others)])


def later(at: list[str]) -> Column:
    return F.struct(*[f"x_{c}" for c in at]) > F.struct(*[f"y_{c}" for c in at])


def places(at: list[str]) -> list[str]:
    return [f"{s}_{c}" for s in "xy" for c in at]


def united(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_met(posted: DataFrame, threshold: float, at: list[str]) -> DataFrame:
    """Pairs (x after y) of a set and a few others that have one of its RAREST items, LEADERS for each item at most.

    For each item its sets are dealt into LEADERS classes.  Of half of them the
    earliest set is met, of the others one that is drawn: members of a large
    group differ, and each item gives them others to be similar to.
    """
    asked = posted.filter(F.col("k") < RAREST).withColumn("draw", F.xxhash64("t", *at))
    kind = F.pmod("draw", F.lit(LEADERS))
    by = F.col(at[0])
    if posted.schema[at[0]].dataType == LongType():
        by = F.when(kind < LEADERS // 2, by).otherwise(F.col("draw"))
    parts = []
    for block in range(BLOCKS_FIRST):
        here = asked.filter(F.pmod(F.col("t"), F.lit(BLOCKS_FIRST)) == block)
        # nothing but numbers is kept while rows are read
        leaders = here.withColumn("by", by).groupBy("t", kind.alias("class")).agg(*[F.min_by(c, "by").alias(f"y_{c}") for c in (*at, "p", "bits", "more")])
        met = side(here, "x", at).join(leaders, "t")
        parts.append(stored(met.filter(later(at) & room(threshold)).select(*places(at)).distinct(), "set-first"))
        release()
    whole = stored(united(parts).distinct(), "set-first")
    release(*parts)
    return whole


def drawn_met(posted: DataFrame, threshold: float, open_: Column | None = None) -> DataFrame:
    """Pairs (x after y) of a set and one that is drawn for each of its items in posted among the sets that have it."""
    others = [] if open_ is None else ["part"]
    one = posted.withColumn("draw", F.xxhash64("t", "id")).groupBy("t").agg(*[F.min_by(c, "draw").alias(f"y_{c}") for c in ("id", "p", "bits", "more", *others)])
    met = side(posted, "x", ["id"], *others).join(one, "t").filter((F.col("x_id") != F.col("y_id")) & room(threshold))
    return later_first(met if open_ is None else met.filter(open_), ["id"])


def larger_first(at: list[str]) -> Column:
    """x is the larger set, or the later one of equal ones."""
    n, m = n_of("x_p"), n_of("y_p")
    return (m < n) | ((m == n) & later(at))


def later_first(pairs: DataFrame, at: list[str]) -> DataFrame:
    both = [F.struct(*[F.col(f"{s}_{c}").alias(c) for c in at]) for s in "xy"]
    return pairs.select(F.greatest(*both).alias("x"), F.least(*both).alias("y")).select(*[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in at])


def all_met(posted: DataFrame, threshold: float, at: list[str], group: str, open_: Column) -> DataFrame:
    """All pairs (x after y) that share a prefix item, have room for enough others, and are open_ (of x_<group>, y_<group>).

    posted has `group`: rows of one group needn't be paired with each other,
    null is no group.  Where an item has many rows of one group they are set
    apart and only meet the item's other rows.  posted has `b` too: two sets
    that share a run of items meet at its first one only.
    """
    sizes = posted.filter(F.col(group).isNotNull()).groupBy("t", group).agg(F.count("*").alias("c")).filter(F.col("c") > HOT)
    hot = stored(sizes.select("t", group, F.lit(True).alias("apart")), "set-hot")
    mixed_hot = hot.groupBy("t").agg(F.count("*").alias("c")).filter("c > 1").select("t")
    if hot.isEmpty():
        flagged = posted.withColumn("apart", F.lit(False))
    else:
        flagged = join_checked(posted, hot, ["t", group], "left", MOST_SENT).withColumn("apart", F.coalesce("apart", F.lit(False)))
    n = n_of("p")
    # a smaller or equal set of a pair shares a word within an even shorter prefix
    index = flagged.filter(i_of("p") < n - F.ceil(n * (2 * threshold / (1 + threshold)) - 1e-9) + 1)
    # what stands before a shared item is in the prefix and the index too, and leaves more room
    begins = F.coalesce(F.col("x_b") != F.col("y_b"), F.lit(True))
    keep = larger_first(at) & open_ & room(threshold) & begins
    parts = []
    for block in range(BLOCKS):
        here = F.pmod(F.col("t"), F.lit(BLOCKS)) == block
        large, small = side(flagged.filter(here), "x", at, group, "apart", "b"), side(index.filter(here), "y", at, group, "apart", "b")
        met = large.filter("not x_apart").join(small, "t").filter(keep)
        parts.append(stored(later_first(met, at).distinct(), "set-pairs"))
        release()
    if not hot.isEmpty():
        large, small = side(flagged.filter("apart"), "x", at, group, "b"), side(index, "y", at, group, "apart", "b")
        others = join_checked(small.filter("not y_apart").drop("y_apart"), hot.select("t").distinct(), ["t"], "left_semi", MOST_SENT)
        parts.append(stored(later_first(large.join(others, "t").filter(keep), at).distinct(), "set-pairs"))
        alike = join_checked(small.filter("y_apart").drop("y_apart"), mixed_hot, ["t"], "left_semi", MOST_SENT)
        parts.append(stored(later_first(large.join(alike, "t").filter(keep), at).distinct(), "set-pairs"))
    whole = stored(united(parts).distinct(), "set-pairs")
    release(hot, *parts)
    return whole


def linked(sets: DataFrame, similar: Callable[[DataFrame], DataFrame], threshold: float, known: DataFrame | None = None, rarest: int = 4) -> DataFrame:
    """Links (a, b) that connect all sets(id, n, bits, more, prefix) which chains of similar sets connect.

    `similar` keeps those pairs (x_id, y_id) that reach the threshold; `known`
    are pairs worth asking first.  Each set is asked about a few that are drawn
    for its rarest items, and what isn't connected to them about one drawn for
    every prefix item: this connects nearly all members of a large group in
    proportion to their number.  Then all pairs are asked that share a prefix
    item and aren't connected yet; of their links one for two components is kept.
    """
    at = ["id"]
    ends = lambda pairs: pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b"))
    apart = F.coalesce("x_part", "x_id") != F.coalesce("y_part", "y_id")

    def placed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        parts = connected_components(links, "set-parts")
        part_of = parts.select(F.col("node").alias("id"), F.col("component").alias("part"))
        return parts, join_checked(sets, part_of, at, "left", MOST_SENT)

    asked = drawn_met(postings(sets, threshold, at).filter(F.col("k") < rarest), threshold)
    near = similar(asked if known is None else asked.unionByName(known))
    parts, rows = placed(ends(near))
    also = similar(drawn_met(postings(rows, threshold, at, "part"), threshold, apart))
    release(parts)
    parts, rows = placed(ends(near.unionByName(also)))
    pairs = all_met(postings(rows, threshold, at, "part", before=True), threshold, at, "part", apart)
    more = similar(pairs)
    of = lambda s: parts.select(F.col("node").alias(f"{s}_id"), F.col("component").alias(f"{s}_part"))
    named = more.join(of("x"), "x_id", "left").join(of("y"), "y_id", "left")
    both = [F.coalesce("x_part", "x_id"), F.coalesce("y_part", "y_id")]
    between = named.select(F.greatest(*both).alias("a"), F.least(*both).alias("b"))
    inside = parts.select(F.col("node").alias("a"), F.col("component").alias("b"))  # what connects them is as good as their links
    out = stored(inside.unionByName(between).filter("a <> b").distinct(), "set-links")
    release(near, also, more, parts, pairs)
    return out
