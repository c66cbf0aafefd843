"""Document fingerprints by SpotSigs (operator 4).

A signature is a common word (the anchor) with the chain of the next two
content words, other common words skipped.  The fingerprint of a text is the
set of its signatures.  Sets are compared by Jaccard similarity, in partitions
by their length and only where lengths allow the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_checked, release, session_value, stored
from .components import connected_components
from .setjoin import MOST_SENT, linked, parity, prefix_length

# Common words that anchor signatures, by language.
ANCHORS = tuple(
    (
        # English
        "a an and are as at be by for from had has have he in is it not of on or she that the there they this to was were which will with "
        # German
        "das dem den der des die du ein eine einem einen einer er es für im in ist mit nicht sich sie und von war wir zu zum zur "
        # French
        "au aux avec ce ces dans de des du elle en est et il je la le les lui ne nous on par pas pour que qui sa se son sur un une "
        # Spanish
        "al como con de del el ella en es esta este fue la las lo los no para por que se su sus un una y"
    ).split()
)
CHAIN = 2
SPARSE = 16
#: Likeness of near-duplicates.
THRESHOLD = 0.8
#: Rows of a bucket of neighbouring documents, about, and into how many ranges ids are cut, twice if need be.
BUCKET_ROWS = 4096
RANGES = 256
#: Hash buckets in which signatures are counted, for their order by rarity.
COUNT_BUCKETS = 1 << 18
#: The class of a signature that stands in one text only.
UNSHARED = 5


def signatures(docs: DataFrame, text: str, out: str) -> DataFrame:
    """docs with `out`, array<int> of the sorted, distinct signatures (32-bit hashes) of a text.

    Words are lower-cased runs of letters and digits.  The beginning of a text
    is an anchor too, so any text with a content word has a signature; in a text
    with fewer anchors than one to SPARSE content words (a list, another
    language) every content word begins a chain.  Null and empty texts have none.
    """
    others = [c for c in docs.columns if c != out]
    listed = ", ".join(f"'{a}'" for a in dict.fromkeys(ANCHORS))
    split = docs.select(*others, F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("__w"))
    spots = split.select(
        *others,
        F.expr(f"filter(__w, x -> x not in ({listed}))").alias("__content"),
        # with the place: i words, of which the anchor's own number are anchors, stand before it
        F.expr(f"filter(transform(__w, (x, i) -> struct(x, i)), s -> s.x in ({listed}))").alias("__spots"),
    )
    chains = F.expr(
        "concat(array(struct('' as x, 0 as at)), transform(__spots, (s, j) -> struct(s.x as x, s.i - j as at)), "
        f"if(size(__spots) * {SPARSE} < size(__content) and size(__content) > 1, transform(sequence(1, size(__content) - 1), i -> struct('' as x, i as at)), array()))"
    )
    hashed = F.expr(
        "transform(filter(__chains, c -> c.at < size(__content)), c -> cast(shiftright(xxhash64(c.x, get(__content, c.at), get(__content, c.at + 1)), 32) as int))"
    )
    return spots.select(*others, "__content", chains.alias("__chains")).select(*others, F.sort_array(F.array_distinct(hashed)).alias(out))


def fingerprint(signatures: Column) -> Column:
    """The signatures as one string, 8 hexadecimal digits each, ascending as signed numbers."""
    return F.array_join(F.transform(signatures, lambda s: F.substring(F.hex(s.cast("long") + (1 << 32)), -8, 8)), "")


def likeness(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard similarity of two arrays of signatures; two texts without any are alike.

    Below at_least it may be given as 0: where lengths alone rule it out, sets aren't compared.
    """
    n, m = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when(F.least(n, m) < at_least * F.greatest(n, m), F.lit(0.0)).otherwise(shared / (n + m - shared))


def with_bucket(rows: DataFrame, docs: DataFrame, id: str, out: str) -> DataFrame:
    """rows with a number (int) that ascends with ids (long), of buckets of about BUCKET_ROWS rows of docs however ids are spread; null is in the first.

    Quantiles of ids are taken once over all and, in large tables, once more
    within each range.
    """
    n = docs.count()
    ranges = min(RANGES, -(-n // BUCKET_ROWS))
    if ranges < 2:
        return rows.withColumn(out, F.lit(0))
    cuts = F.percentile_approx(id, [k / ranges for k in range(1, ranges)], F.lit(100 * RANGES))
    below = lambda bounds: F.when(F.col(id).isNull(), F.lit(0)).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col(id))))
    with session_value(docs.agg(cuts)) as bounds:
        if n <= RANGES * BUCKET_ROWS:
            return rows.withColumn(out, below(bounds))
        within = docs.withColumn("__b", below(bounds)).groupBy("__b").agg(cuts.alias("c"))
        each = within.agg(F.map_from_entries(F.collect_list(F.struct("__b", "c"))).alias("m"))  # RANGES + 1 rows
        none = F.array().cast("array<long>")
        with session_value(each.select(F.transform(F.sequence(F.lit(0), F.lit(ranges)), lambda k: F.coalesce(F.try_element_at("m", k), none)))) as inner:
            fine = rows.withColumn(out, below(bounds))
            return fine.withColumn(out, F.col(out) * (RANGES + 1) + below(F.get(inner, F.col(out))))


def with_next(docs: DataFrame, id: str, carried: list[str], near: DataFrame | None = None) -> DataFrame:
    """docs with `next_<c>` of each carried column: that of the next document by ascending id, after the last of the first.

    Ids (long) are cut into ranges of about as many rows; each range also gets
    the first row after it, so that neighbours meet in one task and rows are
    dealt out once.  Null ids are below all others; rows that repeat an id
    follow each other by `carried`.  near(id, ...) are narrow rows, one for an
    id, whose columns are added along the way.
    """
    spark = docs.sparkSession
    added = [c for c in near.columns if c != id] if near is not None else []
    rows = docs.withColumn("__row", F.lit(True))
    if near is not None:
        rows = rows.unionByName(near.withColumn("__row", F.lit(False)), allowMissingColumns=True)
    keyed = with_bucket(rows, docs.select(id), id, "__bucket")
    least = F.min(F.when(F.col("__row"), F.struct(F.col(id).isNotNull().alias("known"), F.col(id).alias("id"))))
    firsts = keyed.filter("__row").groupBy("__bucket").agg(least.alias("first")).orderBy("__bucket").collect()  # a row for each bucket
    before = [firsts[k - 1]["__bucket"] for k in range(len(firsts))]  # the first one's stands after the last bucket
    ghosts = spark.createDataFrame([(r.first.id, b, True) for r, b in zip(firsts, before, strict=True)], "__first long, __before int, __row boolean")
    marked = keyed.join(F.broadcast(ghosts.withColumnRenamed("__row", "__g")), F.col(id).eqNullSafe(F.col("__first")) & F.col("__row") & F.col("__g"), "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("__before").alias("b"), F.lit(1).alias("ghost"))
    dealt = marked.withColumn("__at", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    along = Window.partitionBy("__at.b").orderBy("__at.ghost", F.col(id).asc_nulls_first(), "__row", *carried)
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if added:
        found = F.last(F.when(~F.col("__row"), F.struct(id, *added)), ignorenulls=True).over(so_far)
        dealt = dealt.withColumn("__near", found).filter("__row")
        dealt = dealt.withColumns({c: F.when(F.col(f"__near.{id}") == F.col(id), F.col(f"__near.{c}")) for c in added})
    moved = dealt.withColumns({f"next_{c}": F.lead(c).over(along) for c in carried})
    return moved.filter("__at.ghost = 0").drop("__row", "__near", "__bucket", "__first", "__before", "__g", "__at")


def edited(text: Column, following: Column) -> Column:
    """A text whose last half is replaced by the beginning of the next one."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars long, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id, component_id).

    Null texts are empty.  near_edited and near_next are the likenesses of a
    text's fingerprint to those of its edited text and of the next document;
    class_id and component_id are those of near_duplicates() at 0.8, null for
    rows without an id.  A table of one row is its own next; an empty table
    gives an empty result; rows may repeat, and of different texts with one id
    the lower class and component count.  Ids are longs, spread in any way.
    """
    whole = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    near = near_duplicates(whole, THRESHOLD, "id", "text").groupBy("id").agg(F.min("class_id").alias("class_id"), F.min("component_id").alias("component_id"))
    marked = with_next(whole, "id", ["text"], near)  # only texts are dealt out: signatures are made where they meet
    own = signatures(signatures(marked, "text", "own"), "next_text", "next_own")
    changed = own.withColumn("edited", edited(F.col("text"), F.col("next_text"))).select(
        "id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", "edited", "class_id", "component_id"
    )
    both = signatures(changed, "edited", "other")
    return both.select(
        F.col("id").alias(id), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"),
        "class_id", "component_id",
    )


def rarity(items: DataFrame) -> DataFrame:
    """One row with array<tinyint>: for each hash bucket of signatures about 1 + 4 * log2(1 + its texts).

    items(items) are the sets.  The order by (class, signature) is one order for all sets whatever the counts.
    """
    said = items.select(F.explode("items").alias("s")).select(_bucket(F.col("s")).alias("k"), F.lit(1).cast("long").alias("n"))
    every = items.sparkSession.range(COUNT_BUCKETS).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("n"))
    counts = said.unionAll(every).groupBy("k").agg(F.sum("n").alias("n"))
    of = (F.least(F.lit(120), F.floor(4 * F.log2(F.col("n") + 1))) + 1).cast("tinyint")
    parts = counts.groupBy(F.shiftright("k", 10).alias("part")).agg(F.array_sort(F.collect_list(F.struct("k", of.alias("c"))))["c"].alias("cs"))
    return parts.agg(F.flatten(F.array_sort(F.collect_list(F.struct("part", "cs")))["cs"]).alias("classes"))


def _bucket(signature: Column) -> Column:
    return signature.bitwiseAND(F.lit(COUNT_BUCKETS - 1)).cast("int")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class_id, component_id) for every row with an id (long).

    class_id is the least id with the same fingerprint; component_id is the
    least id that chains of texts lead to whose signatures have a Jaccard
    similarity of the threshold or more.  Texts without signatures are one
    class without links.  Signatures are ordered by rarity; sets meet where
    they share one of the first (the prefix), are compared only where lengths
    and places allow the threshold, and verified whole.  Of a pair that other
    links connect already no link is made.
    """
    known = docs.select(F.col(id).alias("id"), F.col(text).alias("t")).filter("id is not null")
    own = stored(signatures(known, "t", "items").select("id", "items", F.xxhash64("items").alias("h"), F.xxhash64(F.lit(1), "items").alias("g")), "spot-sets")
    keyed = own.select("id", "h", "g", F.size("items").alias("n"))
    classes = stored(keyed.groupBy("h", "g", "n").agg(F.min("id").alias("class_id")), "spot-classes")
    firsts = classes.filter("n > 0").select(F.col("class_id").alias("id"), "h", "g")
    n = F.size("items")
    length = F.when(n * (1 - threshold) >= threshold - 1e-9, prefix_length(n, threshold)).otherwise(F.lit(0)).cast("int")
    with session_value(rarity(own)) as table:
        first = F.sort_array(F.transform("items", lambda s: F.shiftleft(F.coalesce(F.get(table, _bucket(s)), F.lit(0)).cast("long"), 32).bitwiseOR(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))))
        ordered = own.join(firsts, ["id", "h", "g"], "left_semi").select("id", n.alias("n"), parity("transform(items, x -> cast(x as bigint))", 0).alias("bits"), parity("transform(items, x -> cast(x as bigint))", 64).alias("more"), F.slice(first, F.lit(1), length).alias("p"))
        short = ordered.select("id", "n", "bits", "more", F.filter("p", lambda x: x >= F.lit((UNSHARED + 1) << 32)).alias("prefix"))
        lists = stored(short.dropDuplicates(["id"]), "spot-prefixes")
    links = linked(lists, lambda pairs: _similar(own.select("id", "items"), pairs, threshold), threshold)
    found = connected_components(links, "spot-components")
    of_class = classes.join(found.withColumnRenamed("node", "class_id"), "class_id", "left").select("h", "g", "n", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = stored(keyed.join(of_class, ["h", "g", "n"]).select(F.col("id").alias(id), "class_id", "component_id"), "spot-near")
    release(own, classes, lists, links, found)
    return out


def _similar(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Those pairs (x_id, y_id) whose sets(id, items) reach the threshold."""
    kept = pairs if hasattr(pairs, "_stored_at") else stored(pairs.distinct(), "spot-candidates")
    wanted = stored(kept.select(F.explode(F.array("x_id", "y_id")).alias("id")).distinct(), "spot-wanted")
    chosen = join_checked(sets, wanted, ["id"], "left_semi", MOST_SENT)
    of = lambda s: chosen.select(F.col("id").alias(f"{s}_id"), F.col("items").alias(f"{s}_items"))
    both = kept.join(of("x"), "x_id").join(of("y"), "y_id")
    near = likeness(F.col("x_items"), F.col("y_items"), threshold) >= threshold - 1e-12
    out = stored(both.filter(near).select("x_id", "y_id").distinct(), "spot-similar")
    release(wanted, *([] if kept is pairs else [kept]))
    return out
