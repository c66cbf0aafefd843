"""Text whose lengths and offsets are UTF-8 bytes and whose elements are grapheme clusters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import col, guarded

MATCH = "struct<start: bigint, end: bigint, text: string, captures: array<string>>"


def _each(kind: str, f: Callable[[str], object], arrow: pa.DataType) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else f(v) for v in values.to_pylist()], arrow)

    return run


def quoted(literal: str) -> str:
    """A literal as a Java pattern."""
    return re.sub(r"([\\.\[\]{}()*+?^$|\-])", r"\\\1", literal)


def regex_pattern(pattern: str) -> str:
    """A pattern, if it has no look-around or back-references."""
    if re.search(r"\(\?<?[=!]|(?<!\\)\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    re.compile(pattern)
    return pattern


def length(s: Column) -> Column:
    """UTF-8 bytes."""
    return F.octet_length(s).cast("bigint")


def clusters(s: Column) -> Column:
    return _each("array<string>", lambda v: regex.findall(r"\X", v), pa.list_(pa.string()))(s)


def first(s: Column, default: str | None = None) -> Column:
    out = F.get(clusters(s), F.lit(0))
    return F.coalesce(out, F.lit(default)) if default is not None else guarded(out, s == "", "string is empty")


def last(s: Column, default: str | None = None) -> Column:
    out = F.try_element_at(clusters(s), F.lit(-1))
    return F.coalesce(out, F.lit(default)) if default is not None else guarded(out, s == "", "string is empty")


def byte_slice(s: Column, start: Column | int, end: Column | int | None = None) -> Column:
    """The bytes from start to before end; negative places count from the end; an error inside a character."""
    n = F.octet_length(s)
    place = lambda x: F.when(col(x) < 0, n + col(x)).otherwise(col(x)).cast("int")
    a, b = place(start), place(end) if end is not None else n
    cut = F.substring(s.cast("binary"), a + 1, F.greatest(b - a, F.lit(0)))
    out = F.call_function("try_validate_utf8", cut.cast("string"))
    return guarded(guarded(out, out.isNull() & s.isNotNull(), "string index is not a character boundary"), (a < 0) | (b > n), "string index out of bounds")


def at(s: Column, index: Column | int, default: str | None = None) -> Column:
    """The grapheme cluster at a byte offset."""
    i = F.when(col(index) < 0, F.octet_length(s) + col(index)).otherwise(col(index)).cast("int")
    tail = F.substring(s.cast("binary"), i + 1, F.octet_length(s)).cast("string")
    found = F.when((i >= 0) & (i < F.octet_length(s)), F.get(clusters(tail), F.lit(0)))
    return F.coalesce(found, F.lit(default)) if default is not None else guarded(found, found.isNull() & s.isNotNull(), "string index out of bounds")


def codepoints(s: Column) -> Column:
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(s, F.lit("(?s)."), 0))


def to_unicode(c: Column) -> Column:
    return F.ascii(c)


def from_unicode(cp: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(cp.cast("bigint")), 8, "0")), "UTF-32")


def normalize(s: Column, form: str = "nfc") -> Column:
    return _each("string", lambda v: unicodedata.normalize(form.upper(), v), pa.string())(s)


def lower(s: Column) -> Column:
    return F.lower(s)


def upper(s: Column) -> Column:
    return F.upper(s)


def contains(s: Column, pattern: str, is_regex: bool = False) -> Column:
    return s.rlike(regex_pattern(pattern)) if is_regex else s.contains(pattern)


def starts_with(s: Column, pattern: str, is_regex: bool = False) -> Column:
    return s.rlike(f"^(?:{regex_pattern(pattern)})") if is_regex else s.startswith(pattern)


def ends_with(s: Column, pattern: str, is_regex: bool = False) -> Column:
    return s.rlike(f"(?:{regex_pattern(pattern)})$") if is_regex else s.endswith(pattern)


def _java(pattern: str, is_regex: bool) -> str:
    return regex_pattern(pattern) if is_regex else quoted(pattern)


def find(s: Column, pattern: str, is_regex: bool = False) -> Column:
    """The first matched text, or none."""
    p = _java(pattern, is_regex)
    return F.when(s.rlike(p), F.regexp_extract(s, p, 0))


def position(s: Column, pattern: str, is_regex: bool = False) -> Column:
    """The byte offset of the first match, or none."""
    p = _java(pattern, is_regex)
    i = F.regexp_instr(s, F.lit(p)) if is_regex else F.instr(s, pattern)
    return F.when(i > 0, F.octet_length(F.substring(s, F.lit(1), i - 1)).cast("bigint"))


def _matches(pattern: str, is_regex: bool) -> Callable[[str], list[dict[str, object]]]:
    compiled = regex.compile(pattern if is_regex else regex.escape(pattern))

    def run(v: str) -> list[dict[str, object]]:
        off = lambda k: len(v[:k].encode())
        return [{"start": off(m.start()), "end": off(m.end()), "text": m[0], "captures": list(m.groups())} for m in compiled.finditer(v)]

    return run


_ARROW_MATCH = pa.struct({"start": pa.int64(), "end": pa.int64(), "text": pa.string(), "captures": pa.list_(pa.string())})


def matches(s: Column, pattern: str, is_regex: bool = False) -> Column:
    """All matches as {start, end, text, captures}, offsets in bytes."""
    return _each(f"array<{MATCH}>", _matches(pattern, is_regex), pa.list_(_ARROW_MATCH))(s)


def match(s: Column, pattern: str, is_regex: bool = False) -> Column:
    """The first match, or none."""
    return F.get(matches(s, pattern, is_regex), F.lit(0))


def replace(s: Column, pattern: str, replacement: str | Callable[[dict[str, object]], str], is_regex: bool = False, count: int | None = None) -> Column:
    """Matches replaced by a text or by what a function makes of each match; at most count of them.

    Texts without count stay in the JVM.  An empty pattern matches at every
    character boundary.
    """
    if isinstance(replacement, str) and count is None:
        if not is_regex and pattern:
            return F.replace(s, F.lit(pattern), F.lit(replacement))
        return F.regexp_replace(s, _java(pattern, is_regex), replacement.replace("\\", "\\\\").replace("$", "\\$"))
    found = _matches(pattern, is_regex)

    def run(v: str) -> str:
        b, out, at_ = v.encode(), [], 0
        for m in found(v)[:count]:
            out += [b[at_ : m["start"]], (replacement if isinstance(replacement, str) else replacement(m)).encode()]
            at_ = m["end"]
        return b"".join([*out, b[at_:]]).decode()

    return _each("string", run, pa.string())(s)


def trim(s: Column, pattern: str | None = None, is_regex: bool = False, at: str = "both", repeat: bool = True) -> Column:
    """White space, or a pattern, off the start, the end or both, once or repeatedly."""
    p = r"[\p{IsWhite_Space}]" if pattern is None else _java(pattern, is_regex)
    p = f"(?:{p})+" if repeat or pattern is None else f"(?:{p})"
    out = s
    if at in ("start", "both"):
        out = F.regexp_replace(out, f"^{p}", "")
    if at in ("end", "both"):
        out = F.regexp_replace(out, f"{p}$", "")
    return out


def split(s: Column, pattern: str | None = None, is_regex: bool = False) -> Column:
    """At white space, without empty pieces, or at every match of a pattern, with them."""
    if pattern is None:
        return F.filter(F.split(s, r"[\p{IsWhite_Space}]+"), lambda x: x != "")
    if pattern == "":
        return F.concat(F.array(F.lit("")), codepoints(s), F.array(F.lit("")))
    return F.split(s, _java(pattern, is_regex), -1)


def rev(s: Column) -> Column:
    """Grapheme clusters in reverse."""
    return F.array_join(F.reverse(clusters(s)), "")


def repeat(s: Column, n: Column | int) -> Column:
    return guarded(F.repeat(s, col(n).cast("int")), col(n) < 0, "cannot repeat a string this often")


def lorem(n: int) -> Column:
    """n words of blind text."""
    # The classic blind text.
    words = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magnam aliquam quaerat voluptatem.".split()
    return F.lit(" ".join(words[k % len(words)] for k in range(n)))
