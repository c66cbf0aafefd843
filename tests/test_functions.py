import math

import pytest
from pyspark.sql import functions as F

from sheafline.functions import binary, calc, datetimes, guards, numbering, numbers, strings
from sheafline.operators import arrays, dicts

L = F.lit


def longs(*xs):
    return F.array(*[L(x).cast("bigint") for x in xs]) if xs else F.array().cast("array<bigint>")


@pytest.mark.parametrize(("f", "a", "b", "want"), [
    (calc.rem, 5, -3, 2), (calc.div_euclid, 7, 3, 2), (calc.div_euclid, 7, -3, -2), (calc.div_euclid, -7, 3, -3), (calc.div_euclid, -7, -3, 3),
    (calc.rem_euclid, 7, -3, 1), (calc.rem_euclid, -7, 3, 2), (calc.rem_euclid, -7, -3, 2), (calc.quo, 5, -3, -2), (calc.quo, -5, 3, -2), (calc.quo, -5, -3, 1), (calc.quo, -4, 5, -1),
    (calc.gcd, 84, -36, 12), (calc.lcm, 4, 6, 12), (calc.perm, 5, 2, 20), (calc.perm, 2, 5, 0), (calc.binom, 10, 3, 120),
])
def test_integers(val, f, a, b, want):
    assert val(f(L(a).cast("bigint"), L(b).cast("bigint"))) == want


def test_calc(val):
    assert val(calc.round_(L(math.e), 2)) == 2.72 and val(calc.round_(L(-2.5), 0)) == -3.0
    assert val(calc.pow_(L(2), 10)) == 1024 and val(calc.fact(L(5))) == 120
    assert val(calc.erf(L(0.5))) == pytest.approx(math.erf(0.5))
    assert val(calc.norm(F.array(L(3.0), L(-4.0)))) == pytest.approx(5) and val(calc.norm(F.array(L(3.0), L(-4.0)), math.inf)) == 4
    assert val(calc.root(L(-27.0), 3)) == pytest.approx(-3)


@pytest.mark.parametrize("bad", [
    lambda: calc.pow_(L(0), 0), lambda: calc.sqrt(L(-1.0)), lambda: calc.ln(L(0.0)), lambda: calc.asin(L(2.0)), lambda: calc.clamp(L(1), 3, 2), lambda: calc.rem(L(1), L(0)),
    lambda: arrays.first(longs()), lambda: arrays.at(longs(1), 5), lambda: arrays.sum_(longs(), L(0).cast("bigint")), lambda: strings.first(L("")),
    lambda: guards.strict(L(None).cast("boolean")), lambda: guards.divide(L(1), L(0)), lambda: strings.byte_slice(L("ä"), 1), lambda: dicts.at(F.create_map(L("a"), L(1)), "b"),
    lambda: numbers.bit_lshift(L(1 << 62), 3), lambda: binary.label(""), lambda: guards.assert_eq(L(1), L(2)), lambda: arrays.zip_(longs(1, 2), longs(1), exact=True),
])
def test_errors(val, bad):
    with pytest.raises(Exception):  # noqa: B017
        val(bad())


def test_arrays(val):
    a = longs(7, 3, 2, 5, 1)
    assert val(arrays.filter_(a, lambda x: x < 5)) == [3, 2, 1]
    assert val(arrays.fold(longs(1, 2, 3, 4), L(0).cast("bigint"), lambda s, x: s + x)) == 10
    assert val(arrays.sum_(longs(), L(0).cast("bigint"), default=0)) == 0
    assert val(arrays.windows(longs(1, 2, 3, 4, 5), 3)) == [[1, 2, 3], [2, 3, 4], [3, 4, 5]] and val(arrays.windows(longs(1), 3)) == []
    assert val(arrays.sorted_(longs(2, 1, 3, -10, -5, 8, 6, -7, 2), lambda x: x * x)) == [1, 2, 2, 3, -5, 6, -7, 8, -10]
    assert [tuple(r) for r in val(arrays.zip_(longs(1, 2, 3, 4), longs(5, 6)))] == [(1, 5), (2, 6)]
    assert [tuple(r) for r in val(arrays.enumerate_(F.array(L("a"), L("b"), L("c")), -7))] == [(-7, "a"), (-6, "b"), (-5, "c")]
    words = F.array(L("Hello"), L("World"), L("Hi"), L("There"))
    assert val(arrays.dedup(words, F.length)) == ["Hello", "Hi"]
    assert val(arrays.reduce_(longs(), lambda x, y: x + y)) is None
    assert val(arrays.insert(longs(1, 2, 3), -1, L(9).cast("bigint"))) == [1, 2, 9, 3]
    assert val(arrays.chunks(longs(1, 2, 3), 2)) == [[1, 2], [3]] and val(arrays.chunks(longs(1, 2, 3), 2, exact=True)) == [[1, 2]] and val(arrays.chunks(longs(), 2)) == []
    assert val(arrays.split(longs(1, 0, 2, 0), L(0).cast("bigint"), "bigint")) == [[1], [2], []]
    assert val(arrays.range_(5, 2)) == [] and val(arrays.range_(5, 2, -1)) == [5, 4, 3] and val(arrays.range_(2, 4, inclusive=True)) == [2, 3, 4]
    assert val(arrays.join(F.array(L("a"), L("b"), L("c")), ", ", last=" and ")) == "a, b and c"
    pairs = F.array(*[F.struct(L(k).alias("key"), L(v).alias("value")) for k, v in (("a", 1), ("b", 2), ("c", 3), ("b", 4))])
    assert list(val(arrays.to_dict(pairs)).items()) == [("a", 1), ("b", 4), ("c", 3)]
    assert val(arrays.sorted_by(F.array(L("I"), L("the"), L("hi"), L("text")), lambda x, y: F.length(x) >= F.length(y))) == ["text", "the", "hi", "I"]


def test_dicts(val):
    m = F.create_map(L("a"), L(0), L("b"), L(1), L("c"), L(2))
    assert val(dicts.filter_(m, lambda v: v % 2 == 0)) == {"a": 0, "c": 2}
    assert list(val(dicts.merge(F.create_map(L("a"), L(1), L("b"), L(2)), F.create_map(L("c"), L(3), L("a"), L(4)))).items()) == [("a", 4), ("b", 2), ("c", 3)]
    assert list(val(dicts.remove(m, "b"))[0]) == ["a", "c"] and val(dicts.rest_of(m, ["a"])) == {"b": 1, "c": 2}
    assert val(dicts.equal(m, F.create_map(L("c"), L(2), L("b"), L(1), L("a"), L(0))))


def test_strings(val):
    family = "".join(map(chr, (0x1F469, 0x200D, 0x1F469, 0x200D, 0x1F467, 0x200D, 0x1F466)))
    assert val(strings.length(L(family))) == 25 and val(strings.clusters(L(family))) == [family] and val(strings.rev(L("a" + family))) == family + "a"
    assert val(strings.position(L("Hello World"), "World")) == 6
    m = val(strings.match(L("The time of my life."), "[mit]+e", True))
    assert (m.start, m.end, m.text) == (4, 8, "time")
    assert val(strings.replace(L("ABC"), "", "-")) == "-A-B-C-" and val(strings.replace(L("aaa"), "a", "b", count=2)) == "bba"
    assert val(strings.replace(L("a1b2"), "[0-9]", lambda x: str(int(x["text"]) * 2), True)) == "a2b4"
    assert val(strings.trim(L("  x "))) == "x" and val(strings.trim(L("aabaa"), "a", at="start", repeat=False)) == "abaa"
    assert val(strings.split(L(" a  b "))) == ["a", "b"] and val(strings.split(L("a,,b"), ",")) == ["a", "", "b"]
    assert val(strings.from_unicode(L(955))) == chr(955) and val(strings.to_unicode(L(chr(955)))) == 955
    assert val(strings.normalize(L("e" + chr(0x301)), "nfc")) == chr(0xE9) and val(strings.at(L("a" + chr(0xE9)), 1)) == chr(0xE9)
    assert val(strings.codepoints(L("a\nb"))) == ["a", "\n", "b"] and val(strings.find(L("abc"), "x")) is None
    with pytest.raises(ValueError):
        strings.contains(L("a"), "(?=a)", True)


def test_numbers_and_bytes(val):
    assert val(numbers.to_int(L("-ff"), 16)) == -255 and val(numbers.to_str(L(-255), 16)) == chr(0x2212) + "ff"
    for endian in ("little", "big"):
        assert val(numbers.int_from_bytes(numbers.int_to_bytes(L(-5), endian, 3), endian)) == -5
        assert val(numbers.float_from_bytes(numbers.float_to_bytes(L(1.5), endian, 4), endian)) == 1.5
    assert val(numbers.int_from_bytes(numbers.int_to_bytes(L(200), "big", 1), "big", signed=False)) == 200
    assert val(numbers.bit_rshift(L(-8), 1)) == -4 and val(numbers.bit_rshift(L(-1), 63, logical=True)) == 1
    assert val(binary.array_of_bytes(binary.bytes_of_array(F.array(L(1), L(255))))) == [1, 255] and bytes(val(binary.slice_(binary.to_bytes(L("abcd")), 1, -1))) == b"bc"
    assert val(binary.version_padded(binary.version(L("1.2")), 3) < binary.version_padded(binary.version(L("1.10.1")), 3))


def test_datetimes(val):
    d = datetimes.date(2024, 2, 29)
    assert val(datetimes.weekday(d)) == 4 and val(datetimes.ordinal(d)) == 60
    assert val(datetimes.display(d, "[day padding:none]. [month repr:short] [year repr:last_two]")) == "29. Feb 24"
    assert val(datetimes.hours(datetimes.duration(minutes=90))) == 1.5
    with pytest.raises(ValueError):
        datetimes.java_pattern("[century]")


@pytest.mark.parametrize(("pattern", "numbers_", "want"), [
    ("1.", [1, 2, 3], "1.2.3."), ("1.a)", [2, 27], "2.aa)"), ("I-", [4], "IV-"), ("(i)", [9], "(ix)"), ("*", [6], chr(0x2016)), ("*", [7], "**"), ("A", [0], "0"), ("1.1", [1, 2, 3], "1.2.3"),
])
def test_numbering(val, pattern, numbers_, want):
    assert val(numbering.numbering(longs(*numbers_), pattern)) == want
