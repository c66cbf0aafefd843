"""Numbers formatted by patterns such as "1.a)" or "I."."""

from __future__ import annotations

import re
import string

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))
SYMBOLS = ("*", chr(0x2020), chr(0x2021), chr(0xA7), chr(0xB6), chr(0x2016))
#: The letters of systems that count like a, b, ..., z, aa, by the symbol that stands for them.
LETTERS = {
    "あ": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん",
    "い": "いろはにほへとちりぬるをわかよたれそつねならむうゐのおくやまけふこえてあさきゆめみしゑひもせす",
    "ア": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワヲン",
    "イ": "イロハニホヘトチリヌルヲワカヨタレソツネナラムウヰノオクヤマケフコエテアサキユメミシヱヒモセス",
    "가": "가나다라마바사아자차카타파하",
    "ㄱ": "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎ",
}
#: The zero of systems with ten digits, by their one.
ZEROS = {chr(zero + 1): zero for zero in (0x30, 0x660, 0x6F0, 0x966, 0x9E6)}
KINDS = "aAiI*" + "".join((*ZEROS, *LETTERS))


def formatted(kind: str, n: int) -> str:
    """One number; systems without a zero fall back to digits."""
    if n < 0:
        raise ValueError("numbers must be at least zero")
    if kind in ZEROS:
        return "".join(chr(ZEROS[kind] + int(d)) for d in str(n))
    if kind in "iI":
        out, rest = "" if n else "N", n
        for value, sign in ROMAN:
            out += sign * (rest // value)
            rest %= value
        return out.lower() if kind == "i" else out
    if n == 0:
        return "0"
    if kind == "*":
        return SYMBOLS[(n - 1) % len(SYMBOLS)] * ((n - 1) // len(SYMBOLS) + 1)
    letters, out = LETTERS.get(kind, string.ascii_uppercase if kind == "A" else string.ascii_lowercase), ""
    while n:
        n, k = divmod(n - 1, len(letters))
        out = letters[k] + out
    return out


def pieces(pattern: str) -> tuple[list[tuple[str, str]], str]:
    """(prefix, kind) of each counting symbol, and what follows the last one."""
    found = [(m[1], m[2]) for m in re.finditer(rf"([^{re.escape(KINDS)}]*)([{re.escape(KINDS)}])", pattern)]
    if not found:
        raise ValueError("invalid numbering pattern")
    return found, re.sub(rf".*[{re.escape(KINDS)}]", "", pattern, flags=re.DOTALL)


def apply_pattern(pattern: str, numbers: list[int]) -> str:
    """Each symbol takes a number; the last repeats for the rest, set off by its prefix or else by the suffix."""
    parts, suffix = pieces(pattern)
    prefix, kind = parts[-1]
    rest = [(prefix or suffix) + formatted(kind, n) for n in numbers[len(parts) :]]
    return "".join([p + formatted(k, n) for (p, k), n in zip(parts, numbers, strict=False)] + rest) + suffix


def numbering(numbers: Column, pattern: str) -> Column:
    """An array of numbers as text."""

    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else apply_pattern(pattern, v) for v in values.to_pylist()], pa.string())

    return run(numbers.cast("array<bigint>"))
