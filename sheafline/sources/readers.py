"""Whole files as values: text, bytes, CSV, JSON, YAML, TOML, CBOR and XML.

Files are read by Spark's binary reader, so any store will do; parsers run on
the executors in Arrow batches.  Trees are VARIANT columns.
"""

from __future__ import annotations

import datetime
import json
import math
import tomllib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cbor as _cbor

LONG = 1 << 63
#: Files beyond this are refused.
MOST_BYTES = 128 << 20


def files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """(path, length, content); with most_bytes larger files are an error."""
    out = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if most_bytes is None:
        return out
    return out.withColumn("content", F.when(F.col("length") > most_bytes, F.raise_error("file is too large")).otherwise(F.col("content")))


def read(spark: SparkSession, path: str, encoding: str | None = "utf8") -> DataFrame:
    """(path, value): text, or bytes without an encoding; invalid UTF-8 is an error."""
    f = files(spark, path)
    if encoding is None:
        return f.select("path", F.col("content").alias("value"))
    text = F.col("content").cast("string")
    return f.select("path", F.call_function("validate_utf8", text).alias("value"))


def csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = False) -> DataFrame:
    """Rows of strings, never of other types; a row of another width is an error.

    Without a header columns are _c0, _c1, ...
    """
    if len(delimiter) != 1 or not delimiter.isascii():
        raise ValueError("fields are separated by one ASCII character")
    reader = spark.read.option("sep", delimiter).option("header", header).option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", True)
    found = reader.csv(path)
    schema = ", ".join(f"`{c}` string" for c in found.columns)
    # short rows are padded in other modes
    return reader.option("mode", "FAILFAST").option("enforceSchema", True).schema(schema).csv(path)


def _plain(v: object, big: str) -> object:
    """What JSON can say of a value; integers beyond 64 bits are floats or an error."""
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        if -LONG <= v < LONG:
            return v
        if big == "error":
            raise ValueError("integer is too large")
        return float(v)
    if isinstance(v, float):
        return v if math.isfinite(v) else repr(v)
    if isinstance(v, dict):
        return {k if isinstance(k, str) else json.dumps(_plain(k, big)): _plain(x, big) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [_plain(x, big) for x in v]
    if isinstance(v, bytes):
        return list(v)
    if isinstance(v, datetime.datetime | datetime.date | datetime.time):
        return v.isoformat()
    return str(v)


def _json(b: bytes) -> object:
    if b.startswith(b"\xef\xbb\xbf"):
        raise ValueError("a byte order mark stands before the JSON")
    return json.loads(b)


def _yaml(b: bytes) -> object:
    import yaml

    return yaml.safe_load(b)


def _xml_node(e: ElementTree.Element) -> dict[str, object]:
    namespace, tag = e.tag[1:].split("}", 1) if e.tag.startswith("{") else (None, e.tag)
    children: list[object] = [e.text] if e.text else []
    for c in e:
        children.append(_xml_node(c))
        if c.tail:
            children.append(c.tail)
    return {"namespace": namespace, "tag": tag, "attrs": {k.split("}", 1)[-1]: v for k, v in e.attrib.items()}, "children": children}


def _xml(b: bytes) -> object:
    return [_xml_node(ElementTree.fromstring(b))]


PARSERS: dict[str, tuple[Callable[[bytes], object], str]] = {
    "json": (_json, "float"), "yaml": (_yaml, "float"), "toml": (lambda b: tomllib.loads(b.decode()), "error"), "cbor": (_cbor.decode, "float"), "xml": (_xml, "float"),
}


def decoded(content: Column, kind: str) -> Column:
    """Bytes or text of a kind as VARIANT."""
    parse, big = PARSERS[kind]

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if v is None else json.dumps(_plain(parse(v), big)) for v in b.to_pylist()], pa.string())

    return F.parse_json(run(content.cast("binary")))


def tree(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, value VARIANT) of JSON, YAML, TOML, CBOR or XML files."""
    return files(spark, path).select("path", decoded(F.col("content"), kind).alias("value"))


def encoded(value: Column, kind: str, pretty: bool = False) -> Column:
    """VARIANT (or what to_json takes) as JSON, YAML, TOML or CBOR."""
    text = F.to_json(value)

    def write(v: object) -> object:
        if kind == "json":
            return json.dumps(v, indent=2 if pretty else None, ensure_ascii=False, separators=None if pretty else (",", ":"))
        if kind == "yaml":
            import yaml

            return yaml.safe_dump(v, sort_keys=False, allow_unicode=True)
        if kind == "toml":
            return _toml(v)
        return _cbor.encode(v)

    kind_of, arrow = ("binary", pa.binary()) if kind == "cbor" else ("string", pa.string())

    @F.arrow_udf(kind_of)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else write(json.loads(v)) for v in values.to_pylist()], arrow)

    return run(text)


def _toml(v: object, path: tuple[str, ...] = ()) -> str:
    if not isinstance(v, dict):
        raise TypeError("TOML files are tables")
    tables = {k: x for k, x in v.items() if isinstance(x, dict) or (isinstance(x, list) and x and all(isinstance(y, dict) for y in x))}
    lines = [f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items() if k not in tables and x is not None]
    for k, x in tables.items():
        name = ".".join(map(_toml_key, (*path, k)))
        for part in x if isinstance(x, list) else [x]:
            lines += [f"[[{name}]]" if isinstance(x, list) else f"[{name}]", _toml(part, (*path, k))]
    return "\n".join(lines) + ("\n" if not path else "")


def _toml_key(k: str) -> str:
    return json.dumps(k, ensure_ascii=False).replace("\x7f", "\\u007f")


def _toml_value(v: object) -> str:
    """A value within a line; there is no null, and tables in arrays with other values are inline."""
    if v is None:
        raise TypeError("TOML has no null")
    if isinstance(v, list):
        return f"[{', '.join(map(_toml_value, v))}]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{_toml_key(k)} = {_toml_value(x)}" for k, x in v.items() if x is not None) + "}"
    return _toml_key(v) if isinstance(v, str) else json.dumps(v)


# BibLaTeX entries: @kind{key, field = {value}, ...}
ENTRY = "struct<key: string, kind: string, fields: map<string, string>>"


def bib_entries(text: str) -> list[dict[str, object]]:
    """The entries of a BibLaTeX file; values are braced, quoted or bare."""
    import regex

    out = []
    for m in regex.finditer(r"@(\w+)\s*\{\s*([^,\s]+)\s*,((?:[^{}]|(\{(?:[^{}]|(?4))*\}))*)\}", text):
        fields = regex.findall(r"(\w[\w-]*)\s*=\s*(?:\{((?:[^{}]|(\{(?:[^{}]|(?3))*\}))*)\}|\"([^\"]*)\"|([^\s,{}\"]+))", m[3])
        out.append({"key": m[2], "kind": m[1].lower(), "fields": [(f[0].lower(), f[1] or f[3] or f[4]) for f in fields]})
    return out


def bibliography(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, kind, fields) of BibLaTeX files; a key in two entries is an error."""

    @F.arrow_udf(f"array<{ENTRY}>")
    def run(values: pa.Array) -> pa.Array:
        kind = pa.struct({"key": pa.string(), "kind": pa.string(), "fields": pa.map_(pa.string(), pa.string())})
        return pa.array([bib_entries(v) for v in values.to_pylist()], pa.list_(kind))

    rows = read(spark, path).select("path", F.explode(run(F.col("value"))).alias("e")).select("path", "e.*")
    repeated = rows.groupBy("key").agg(F.count("*").alias("__n"))
    return rows.join(repeated, "key").withColumn("key", F.when(F.col("__n") > 1, F.raise_error("duplicate bibliography key")).otherwise(F.col("key"))).drop("__n")
