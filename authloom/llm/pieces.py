"""Splitting texts into the pieces that byte-pair merges work on, on arrays of code points.

The two public tokenizers split by a regular expression over letters, numbers, white space and other
characters. Its effect is stated here as rules on neighbouring characters, so that a slice of many
texts is split at once; ``tests/llm`` holds the rules against the regular expressions themselves.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

from authloom.llm.words import span_hashes

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

# Characters with the Unicode property White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Letters and numbers that Unicode 16 added, which the tokenizers know and this Python may not.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)]
NEW_NUMBERS = [
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA)]
# Lower-case forms that Unicode 16 and 17 added.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB,
             0xA7DC: 0x19B, **{0x10D50 + k: 0x10D70 + k for k in range(22)}, **{0x16EA0 + k: 0x16EBB + k for k in range(25)}}
# Endings that are pieces of their own after an apostrophe.
SHORT_ENDINGS, LONG_ENDINGS = "stmd", ("re", "ve", "ll")


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for lo, hi in ranges:
            out[lo:hi + 1] = kind
    out[WHITE_SPACE] = SPACE
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _contractions(cp: np.ndarray, kind: np.ndarray, first: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of apostrophes that begin a contraction, and the lengths of these.

    ``first``: texts begin there; ``free``: an apostrophe there would begin a piece.
    """
    at = np.flatnonzero((cp == 0x27) & free)
    if not len(at):
        return at, at
    end = len(cp)

    def char(k):
        inside = at + k < end
        c = np.zeros(len(at), dtype=np.uint32)
        c[inside] = cp[at[inside] + k]
        return c

    def same(k):  # no text begins between the apostrophe and position k
        inside = at + k < end
        ok = np.zeros(len(at), dtype=bool)
        ok[inside] = ~first[at[inside] + k]
        return ok

    a, b, one = char(1), char(2), same(1)
    two = one & same(2)
    short = one & np.isin(a, [ord(c) for c in SHORT_ENDINGS])
    long = np.zeros(len(at), dtype=bool)
    for x, y in LONG_ENDINGS:
        long |= two & (a == ord(x)) & (b == ord(y))
    hit = short | long
    return at[hit], np.where(short, 2, 3)[hit]


def split_spaced(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of pieces that carry one leading blank; white space is kept as pieces.

    ``rows``: the n + 1 offsets of the texts in ``cp``.
    """
    size = len(cp)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    kind = classes()[cp]
    first = np.zeros(size + 1, dtype=bool)
    first[rows] = True
    begin = first[:size].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    run_end = np.zeros(size, dtype=bool)  # last white space before other characters of the same text
    run_end[:-1] = space[:-1] & ~space[1:] & ~first[1:size]
    begin |= run_end  # the rest of a run of white space is one piece, its last character another
    blank_before = np.zeros(size, dtype=bool)
    blank_before[1:] = run_end[:-1] & (cp[:-1] == 0x20)
    begin &= ~blank_before
    at, n = _contractions(cp, kind, first, begin)
    begin[at + 1] = False
    after = at + n
    begin[after[after < size]] = True
    starts = np.flatnonzero(begin)
    return starts, np.append(starts[1:], size)


def split_plain(cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of pieces without white space; every number character is a piece."""
    size = len(cp)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    kind = classes()[cp]
    first = np.zeros(size + 1, dtype=bool)
    first[rows] = True
    begin = first[:size] | (kind == NUMBER)
    begin[1:] |= kind[1:] != kind[:-1]
    at, n = _contractions(cp, kind, first, begin)
    begin[at + 1] = False
    after = at + n
    begin[after[after < size]] = True
    starts = np.flatnonzero(begin)
    ends = np.append(starts[1:], size)
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


def piece_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of every piece: pieces are the same if both and so 128 bits agree."""
    first, second = span_hashes(cp, starts, ends, (0, 1))
    return first, second


class PieceTable:
    """Ids of the pieces seen so far, by hash; reset beyond ``most`` pieces, so its memory is bounded.

    Sorted arrays: some 50 bytes a piece, and whole slices are looked up at once. A piece whose first
    hash another piece has is told by the second one and is not remembered.
    """

    def __init__(self, most: int = 800_000) -> None:
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)   # sorted
        self.checks = np.zeros(0, dtype=np.uint64)   # second hashes of these
        self.numbers = np.zeros(0, dtype=np.int32)   # of the pieces with these hashes
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int32)
        self.flat = np.zeros(0, dtype=np.int32)

    def __len__(self) -> int:
        return len(self.lengths)

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Number of each piece, -1 where it isn't known, -2 where another piece has its first hash."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = np.where(self.checks[at] == checks, self.numbers[at], np.int32(-2))
        return np.where(self.hashes[at] == hashes, found, np.int32(-1))

    def add(self, hashes: list[tuple[int, int]], lengths: np.ndarray, flat: np.ndarray) -> None:
        """New pieces, numbered on from the last one; those beyond ``hashes`` go without."""
        numbers = np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        ends = np.cumsum(lengths)
        self.starts = np.concatenate((self.starts, len(self.flat) + ends - lengths))
        self.lengths = np.concatenate((self.lengths, lengths.astype(np.int32)))
        self.flat = np.concatenate((self.flat, flat))
        both = np.array(hashes, dtype=np.uint64).reshape(-1, 2)
        joined = np.concatenate((self.hashes, both[:, 0]))
        order = np.argsort(joined, kind="stable")
        self.hashes, self.checks = joined[order], np.concatenate((self.checks, both[:, 1]))[order]
        self.numbers = np.concatenate((self.numbers, numbers))[order]

    def ids(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the numbered pieces one after the other, and how many each has."""
        n = self.lengths[which]
        ends = np.cumsum(n)
        at = np.repeat(self.starts[which] - (ends - n), n)
        return self.flat[at + np.arange(len(at))], n
