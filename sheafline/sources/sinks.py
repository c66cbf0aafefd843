"""Results as JSON, YAML, text files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import encoded


def serialised(df: DataFrame, kind: str = "json", pretty: bool = False) -> DataFrame:
    """One text for each row."""
    row = F.struct(*[F.col(c) for c in df.columns])
    if kind == "json":
        return df.select(F.to_json(row, {"pretty": "true"} if pretty else {}).alias("value"))
    return df.select(encoded(row, kind, pretty).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_text(df: DataFrame, path: str, text: str = "value") -> None:
    df.select(F.col(text).cast("string").alias("value")).write.text(path)


def write_bundle(df: DataFrame, path: str, name: str = "name", text: str = "value") -> None:
    """A folder of text for each name, written by as many tasks as there are."""
    df.select(name, F.col(text).cast("string").alias("value")).write.partitionBy(name).text(path)


def dependencies(df: DataFrame) -> DataFrame:
    """The files that a frame is read from."""
    return df.select(F.input_file_name().alias("path")).distinct()


def make_rule(paths: DataFrame, output: str, path: str = "path") -> DataFrame:
    """The files as one rule of a make file."""
    listed = F.array_join(F.array_sort(F.collect_list(F.replace(F.col(path), F.lit(" "), F.lit("\\ ")))), " ")
    return paths.agg(F.concat(F.lit(output + ": "), listed).alias("value"))


def loss_report(losses: DataFrame) -> DataFrame:
    """(severity, n, details as JSON) of losses(severity, what, detail)."""
    item = F.struct("what", "detail")
    return losses.groupBy("severity").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list(item))).alias("details"))


def fidelity(facts: DataFrame, key: list[str]) -> DataFrame:
    """Equal facts once, with how often they occurred."""
    return facts.groupBy(*key).agg(F.count("*").alias("occurrences"))
