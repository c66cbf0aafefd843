"""Cutting a text where no token of a blank-prefixed pattern can cross.

The byte-level split pattern only joins blanks to what follows them.  So a text
may be cut wherever a non-blank is followed by a blank, and equal pieces have
equal tokens whatever surrounds them.
"""

from __future__ import annotations

import re

# The code points with the Unicode property White_Space.
WHITE_SPACE = "".join(map(chr, (*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))

#: Blanks with the non-blanks after them, or the blanks that end the text.
PIECE = re.compile(f"[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+")

pieces = PIECE.findall


class TwoGenerations:
    """A memo of at most 2 * `most` entries that keeps what was used of late."""

    def __init__(self, most: int) -> None:
        self.most, self.new, self.old = most, {}, {}

    def missing(self, keys: list) -> list:
        """Which keys have no value (each once); those of the old generation become new."""
        out = set(keys).difference(self.new)
        if self.old:
            for k in list(out):
                if (v := self.old.get(k)) is not None:
                    self.new[k] = v
                    out.discard(k)
        return list(out)

    def put(self, keys: list, values: list) -> None:
        """After this, `new` has all keys that were asked for since the last call of turn()."""
        self.new.update(zip(keys, values, strict=True))

    def turn(self) -> None:
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
