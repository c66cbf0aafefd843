"""Paragraphs and cells of Office packages as element rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import MOST_BYTES, files

# Limits of a package, and namespaces.
MOST_PART = 64 << 20
MOST_EXPANDED = 256 << 20
MOST_ENTRIES = 8192
MOST_DEPTH = 256
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"

ROW = "struct<part: string, ord: bigint, elem: string, level: int, style: string, text: string>"
_ARROW_ROW = pa.struct({"part": pa.string(), "ord": pa.int64(), "elem": pa.string(), "level": pa.int32(), "style": pa.string(), "text": pa.string()})


def parts(content: bytes) -> dict[str, bytes]:
    """The parts of a package within its limits."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        entries = z.infolist()
        if len(entries) > MOST_ENTRIES:
            raise ValueError("package has too many entries")
        if any(e.file_size > MOST_PART for e in entries) or sum(e.file_size for e in entries) > MOST_EXPANDED:
            raise ValueError("package is too large")
        return {e.filename: z.read(e) for e in entries if not e.is_dir()}


def _parsed(data: bytes) -> ElementTree.Element:
    depth = 0
    for event, _ in (parser := ElementTree.iterparse(io.BytesIO(data), events=("start", "end"))):
        depth += 1 if event == "start" else -1
        if depth > MOST_DEPTH:
            raise ValueError("XML is nested too deeply")
    return parser.root


def package_rows(content: bytes) -> list[dict[str, object]]:
    """Paragraphs and table cells of a document, or paragraphs of slides, in order."""
    rows: list[dict[str, object]] = []
    found = parts(content)
    if "word/document.xml" in found:
        for p in _parsed(found["word/document.xml"]).iter(f"{W}p"):
            style = p.find(f"{W}pPr/{W}pStyle")
            name = style.get(f"{W}val") if style is not None else None
            level = int(name[-1]) if name and name.lower().startswith("heading") and name[-1].isdigit() else None
            text = "".join(t.text or "" for t in p.iter(f"{W}t"))
            rows.append({"part": "word/document.xml", "ord": len(rows), "elem": "heading" if level else "par", "level": level, "style": name, "text": text})
    slides = [n for n in found if n.startswith("ppt/slides/slide") and n.endswith(".xml")]
    for n in sorted(slides, key=lambda n: (len(n), n)):
        for p in _parsed(found[n]).iter(f"{A}p"):
            text = "".join(t.text or "" for t in p.iter(f"{A}t"))
            rows.append({"part": n, "ord": len(rows), "elem": "par", "level": None, "style": None, "text": text})
    return rows


def office(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, ord, elem, level, style, text) of DOCX and PPTX files."""

    @F.arrow_udf(f"array<{ROW}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([package_rows(v) for v in b.to_pylist()], pa.list_(_ARROW_ROW))

    return files(spark, path, MOST_BYTES).select("path", F.explode(run(F.col("content"))).alias("r")).select("path", "r.*")
