"""Three-way merge of text regions: a baseline, the current file and an edited copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def plan(regions: DataFrame, edits: DataFrame, files: DataFrame) -> DataFrame:
    """regions(id, file, source, baseline, format) with `word`, `start`, `length` and `status`.

    edits(id, word, format, moved) has what came back for each region, files(file,
    contents) the current texts.  A region keeps its place if its source stands
    exactly once in the current file.  Statuses: unchanged, ready, and the
    conflicts structural_change, formatting_change, local_overlap (the source
    is gone), ambiguous_location and overlapping_regions.
    """
    e = edits.select("id", "word", F.col("format").alias("__format"), F.coalesce("moved", F.lit(False)).alias("__moved"))
    both = regions.join(e, "id").join(files, "file")
    once = F.when(F.col("source") != "", (F.length("contents") - F.length(F.replace("contents", "source", F.lit("")))) / F.length("source")).otherwise(F.lit(2))
    placed = both.withColumns({"__times": once, "start": F.when(once == 1, F.instr(F.col("contents"), F.col("source")) - 1), "length": F.length("source")})
    changed = F.col("word") != F.col("baseline")
    status = (
        F.when(F.col("__moved"), "structural_change")
        .when(F.col("format").isNotNull() & (F.col("format") != "") & ~F.col("format").eqNullSafe(F.col("__format")), "formatting_change")
        .when(~changed, "unchanged").when(F.col("__times") == 0, "local_overlap").when(F.col("__times") > 1, "ambiguous_location").otherwise("ready")
    )
    marked = placed.withColumn("status", status)
    # of the edits of a file, by place, neighbours that overlap are conflicts both
    ready = F.when(F.col("status") == "ready", F.col("start"))
    over = Window.partitionBy("file", ready.isNull()).orderBy(ready, F.col("length"))
    clash = (F.lag(F.col("start") + F.col("length")).over(over) > F.col("start")) | (F.lead("start").over(over) < F.col("start") + F.col("length"))
    out = marked.withColumn("status", F.when((F.col("status") == "ready") & F.coalesce(clash, F.lit(False)), "overlapping_regions").otherwise(F.col("status")))
    return out.select("id", "file", "source", "baseline", "word", "start", "length", "status")


def apply(planned: DataFrame, files: DataFrame) -> DataFrame:
    """(file, contents) of every file that changes; a file with a conflict among its edits stays as it is."""
    conflict = F.bool_or(F.col("status") == "overlapping_regions")
    edit = F.when(F.col("status") == "ready", F.struct("start", "length", "word"))
    of_file = planned.groupBy("file").agg(conflict.alias("__conflict"), F.array_sort(F.collect_list(edit)).alias("__edits")).filter(~F.col("__conflict") & (F.size("__edits") > 0))
    put = F.aggregate(
        "__edits", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda s, e: F.struct(
            F.concat(s["out"], F.substring(F.col("contents"), s["at"] + 1, e["start"] - s["at"]), e["word"]).alias("out"), (e["start"] + e["length"]).cast("int").alias("at")
        ),
    )
    made = files.join(of_file, "file").withColumn("__p", put)
    after = F.concat("__p.out", F.substring(F.col("contents"), F.col("__p.at") + 1, F.length("contents")))
    return made.select("file", after.alias("__new"), "contents").filter(F.col("__new") != F.col("contents")).select("file", F.col("__new").alias("contents"))
