"""Words of texts, a batch at a time, and results remembered by word."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from typing import Generic, TypeVar

import numpy as np
import pyarrow as pa

T = TypeVar("T")
#: Texts of these characters only (ASCII without separators 28-31, and Latin letters with marks), where all
#: regular expression engines agree on letters, digits and white space and lower case is letter by letter.
LATIN = re.compile(r"[\t-\r -~¡-įĲ-ɏ]*")
LONGEST_REMEMBERED = 64


class Remembered(dict, Generic[T]):
    """Results of `make` for short strings, in two generations of at most `most` entries: frequent ones stay."""

    def __init__(self, make: Callable[[str], T], most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key: str) -> T:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_REMEMBERED:
            if len(self) >= self.most:
                self.older = self.copy()
                self.clear()
            self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


def latin_pattern(pattern: str) -> re.Pattern[str]:
    """`pattern` for LATIN texts: LETTER and NUMBER stand for the Unicode classes, inside brackets."""
    groups = {"L": "", "N": ""}
    for c in map(chr, range(0x250)):
        if (kind := unicodedata.category(c)[0]) in groups:
            groups[kind] += c
    return re.compile(pattern.replace("LETTER", groups["L"]).replace("NUMBER", groups["N"]))


def coded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct strings of the lists, the place among them of each string in turn, and each list's bounds in these."""
    code = lists.flatten().dictionary_encode()
    return code.dictionary.to_pylist(), code.indices.to_numpy(), lists.offsets.to_numpy()
