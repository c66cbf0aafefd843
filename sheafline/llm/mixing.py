"""Mixing sources to target weights by entropy balancing (operator 10).

Of all rates between 0 and `most` with the wanted number of tokens from each
source, those closest to 1 in relative entropy are exponential in a document's
size: min(most, exp(theta * size / mean)).  theta solves the convex dual; as a
document has one source, its Hessian is diagonal, and every Newton iteration is
one distributed aggregation over (source, size) counts.  Rates are rounded into
whole copies from the longest document to the shortest, each making up for what
those before it took too much or too little.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, n_words, ranked, small, stored

#: Weights of sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: What the mix takes, as a share of all tokens.
SHARE = 1.5
#: A document's tokens are taken so many times at most.
MOST = 2
#: Documents of a source, on average, whose rates are rounded one after another.
CHUNK = 1024
TOLERANCE = 1e-6
ITERATIONS = 60


def _exact(x: Column) -> Column:
    """For sums that don't depend on the order of rows."""
    return x.cast("decimal(38,9)")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources(source, source_size) with `rank` and `target`.

    Weights follow the sources' code point order, null last.  No target is above `most`
    times its source's size; the excess goes to the others by weight, so all
    others have the same target for a unit of weight.
    """
    named = ranked(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    own = stored(named.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most), "mix-sources")
    total = own.agg(F.sum("source_size")).first()[0] or 0
    unit = None
    while True:
        full = F.col("cap") <= (F.lit(unit) * F.col("weight") if unit is not None else F.lit(-1))
        caps, rest = own.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not rest:
            unit = unit or 0.0
            break
        after = (share * total - float(caps or 0)) / rest
        if unit is not None and after <= unit:
            break
        unit = after
    return own.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(float(unit)) * F.col("weight"))).drop("weight", "cap")


def tilts(counts: DataFrame, wanted: DataFrame, most: float = MOST) -> DataFrame:
    """wanted(rank, source_size, n, target) with `theta`, the solution of the dual.

    counts(rank, size, n) has the documents of each source by size.  The Newton
    steps of all sources run side by side; a step out of the bracket that is
    known so far is replaced by its middle.
    """
    top = F.log(F.lit(float(most)))
    state = stored(
        wanted.select(
            "rank", "target", (F.col("source_size") / F.col("n")).alias("mean"),
            F.lit(0.0).alias("theta"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
            # nothing to solve: nothing to take, or all that can be taken
            ((F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * most)).alias("done"),
        ),
        "mix-newton-0",
    )
    for k in range(1, ITERATIONS):
        if state.filter("not done").isEmpty():
            break
        tilt = F.col("theta") * F.col("size") / F.col("mean")
        rate = F.exp(F.least(tilt, top))
        sums = (
            join_checked(counts, state.filter("not done").select("rank", "theta", "mean"), ["rank"])
            .groupBy("rank").agg(
                F.sum(_exact(F.col("n") * F.col("size") * rate)).cast("double").alias("got"),
                F.sum(_exact(F.when(tilt < top, F.col("n") * F.col("size") * rate * F.col("size") / F.col("mean")))).cast("double").alias("slope"),
            )
        )
        step = state.join(sums, "rank", "left")
        over = F.col("got") - F.col("target")
        step = step.withColumn("low", F.when(over < 0, F.col("theta")).otherwise(F.col("low"))).withColumn("high", F.when(over > 0, F.col("theta")).otherwise(F.col("high")))
        newton = F.col("theta") - over / F.when(F.col("slope") > 0, F.col("slope"))
        # far from the solution a bracket end is a power of ten away: halve in logarithms
        middle = F.when(F.col("low") >= 0, F.sqrt((F.col("low") + 1e-3) * F.col("high"))).when(F.col("high") <= 0, -F.sqrt((1e-3 - F.col("high")) * -F.col("low"))).otherwise((F.col("low") + F.col("high")) / 2)
        state = stored(
            step.select(
                "rank", "target", "mean",
                F.when(F.col("done") | (F.abs(over) <= TOLERANCE * F.col("target")), F.col("theta"))
                .when((newton > F.col("low")) & (newton < F.col("high")), newton).otherwise(middle).alias("theta"),
                "low", "high",
                (F.col("done") | (F.abs(over) <= TOLERANCE * F.col("target"))).alias("done"),
            ),
            f"mix-newton-{k}",
        )
    solved = state.select("rank", "theta", "mean")
    full = F.col("target") >= F.col("source_size") * most
    return wanted.join(solved, "rank").withColumn("theta", F.when(full, F.lit(None).cast("double")).otherwise(F.col("theta")))


def plan_mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST,
) -> DataFrame:
    """(id, source, size long, source_size long, target double, rate double, copies int) for every row of docs.

    size is the number of words (null: 0).  A chunk's copies miss its part of
    the target by about half its shortest document.
    Documents without words have the rate 1 and take nothing.  Null is a
    source like others, the last in order; null ids are ids like others.
    Rows that repeat get the same copies each.  The same rows in any order
    give the same plan.  An empty table gives an empty plan; other columns are
    ignored.

    Hot sources are dealt out in chunks by a hash of the id.
    """
    own = stored(docs.select(F.col(id).alias("id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size")), "mix-sizes")
    by_source = stored(own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "mix-by-source")
    wanted = stored(targets(by_source, weights, share, most), "mix-targets")
    key = wanted.select(F.col("source").alias("__s"), "rank")
    same = F.col("source").eqNullSafe(F.col("__s"))
    counts = own.groupBy("source", "size").agg(F.count("*").alias("n"))
    counts = stored(counts.join(F.broadcast(key) if _few(key) else key, same).select("rank", "size", "n"), "mix-counts")
    solved = stored(tilts(counts, wanted, most), "mix-tilts").select(
        F.col("source").alias("__s"), "rank", "source_size", "target", "theta", "mean", F.ceil(F.col("n") / CHUNK).alias("__chunks")
    )

    distinct = own.groupBy("id", "source", "size").agg(F.count("*").alias("times"))
    tilt = F.least(F.col("theta") * F.col("size") / F.col("mean"), F.log(F.lit(float(most))))
    rated = distinct.join(F.broadcast(solved) if _few(solved) else solved, same).withColumn(
        "rate", F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("theta").isNull(), F.lit(float(most))).otherwise(F.exp(tilt))
    ).withColumn("__chunk", F.pmod(F.xxhash64("id"), F.col("__chunks")))
    item = F.struct((-F.col("size")).alias("descending"), "id", "rate", F.col("times").cast("int").alias("times"))
    chunks = rated.groupBy("rank", "source", "source_size", "target", "__chunk").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # `due` is what the documents before were to give and didn't; each takes the copies that bring it nearest to nothing
    tokens = "(-x.descending * x.times)"
    wanted_copies = f"cast(if(x.descending = 0, 1, greatest(0, least(ceil(x.rate), floor((due + x.rate * {tokens}) / {tokens} + 0.5D)))) as int)"
    step = wanted_copies.replace("due", "acc.due")
    folded = F.expr(
        "aggregate(items, named_struct('due', 0D, 'out', cast(array() as array<int>)), (acc, x) -> named_struct("
        f"'due', acc.due + (x.rate - {step}) * {tokens}, 'out', concat(acc.out, array({step})))).out"
    )
    rounded = chunks.select("rank", "source", "source_size", "target", F.explode(F.arrays_zip("items", folded.alias("copies"))).alias("x"))
    return rounded.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("x.items.times")))).select(
        F.col("x.items.id").alias(id), F.col("source").alias(source), (-F.col("x.items.descending")).alias("size"), "source_size", "target",
        F.col("x.items.rate").alias("rate"), F.col("x.copies").alias("copies"),
    )


def _few(df: DataFrame) -> bool:
    return small(df, 100_000)


def mixed(docs: DataFrame, plan: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs, each row as often as the plan has copies; where an id repeats in the plan its largest number counts for all."""
    copies = plan.groupBy(F.col(id).alias("__id")).agg(F.max("copies").alias("__copies")).filter("__copies > 0")
    return (
        docs.join(copies, F.col(id).eqNullSafe(F.col("__id")))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).drop("__id", "__copies", "__copy")
    )
