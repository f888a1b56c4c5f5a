"""Words, shingles and hashes of whole texts, computed on the bytes of an Arrow column.

A word is a run of bytes other than blank and 0x09-0x0D, with A-Z lower-cased. Every function works
on slices of a bounded number of bytes (one document at least), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, SHINGLE + 1)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser with two multiplications)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, salts: tuple[int, ...] = (0,)) -> list[np.ndarray]:
    """For each salt, a 64-bit hash of every span (none empty) of an array of bytes or code points.

    Eight bytes at a time are spread twice, once with their place, and summed up with the length; no sum
    of powers is involved, under which words that differ in a regular way would be alike.
    """
    if not len(starts):
        return [np.zeros(0, dtype=np.uint64) for _ in salts]
    width = symbols.itemsize
    per = 8 // width
    padded = np.zeros(len(symbols) + per, dtype=symbols.dtype)
    padded[:-per] = symbols
    lanes = np.ndarray(len(symbols), dtype=np.uint64, buffer=padded, strides=(width,))
    length = ends - starts
    mask = np.array([(1 << (8 * width * k)) - 1 for k in range(per + 1)], dtype=np.uint64)
    # first lanes of all spans, then the further ones of the longer spans
    lane = lanes[starts] & mask[np.minimum(length, per)]
    long = np.flatnonzero(length > per)
    if len(long):
        count = -(-length[long] // per) - 1
        begin = np.cumsum(count) - count
        place = np.arange(int(count.sum())) - np.repeat(begin, count) + 1
        more = lanes[np.repeat(starts[long], count) + per * place] & mask[np.minimum(np.repeat(length[long], count) - per * place, per)]
        shift = (place + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    out = []
    for salt in salts:
        first = np.uint64((0x9E3779B97F4A7C15 + salt * 0xC2B2AE3D27D4EB4F) % (1 << 64))
        value = mix(mix(lane + first) + np.uint64(0xD6E8FEB86659FD93))
        if len(long):
            value[long] += np.add.reduceat(mix(mix(more + first) + shift), begin)
        out.append(mix(value + length.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]], off - off[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or of one row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


PART_BYTES = 1 << 22
BLANKS = [bytes([b]) for b in (0x20, *range(0x09, 0x0E))]


def parts(text: bytes, most: int = PART_BYTES) -> Iterator[bytes]:
    """A text in parts of about ``most`` bytes that end before a blank, so that no list of words grows with it.

    A word longer than that stays whole.
    """
    lo = 0
    while len(text) - lo > most:
        hi = max(text.rfind(b, lo + 1, lo + most) for b in BLANKS)
        if hi < 0:
            hi = min((k for k in (text.find(b, lo + most) for b in BLANKS) if k >= 0), default=len(text))
        yield text[lo:hi]
        lo = hi
    yield text[lo:]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of every word, and the n + 1 word offsets of the rows.

    ``offsets`` start at 0 and end at ``len(data)``.
    """
    size = len(data)
    if not size:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none, np.zeros(len(offsets), dtype=np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(size + 1, dtype=bool)  # True where a row begins
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:size]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:size]
    first, last = np.flatnonzero(starts), np.flatnonzero(ends)
    (value,) = span_hashes(_LOWER[data], first, last + 1)
    return value, first, last + 1, np.searchsorted(first, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles in order, and the n + 1 offsets of the rows.

    A row of one to four words has its whole sequence as its only shingle.
    """
    count = np.diff(rows)
    made = np.where(count >= SHINGLE, count - SHINGLE + 1, (count > 0).astype(np.int64))
    out_rows = np.concatenate(([0], np.cumsum(made)))
    out = np.zeros(int(out_rows[-1]), dtype=np.uint64)
    long = np.flatnonzero(count >= SHINGLE)
    if len(long):
        total = int(made[long].sum())
        # position of every shingle's first word, row after row
        begin = np.repeat(rows[long] - np.concatenate(([0], np.cumsum(made[long])[:-1])), made[long]) + np.arange(total)
        value = words[begin] * _STEP[0]
        for k in range(1, SHINGLE):
            value += mix(words[begin + k] + _STEP[k]) * _STEP[k]
        to = np.repeat(out_rows[long] - np.concatenate(([0], np.cumsum(made[long])[:-1])), made[long]) + np.arange(total)
        out[to] = mix(value)
    for n in range(1, SHINGLE):
        short = np.flatnonzero(count == n)
        if len(short):
            value = np.full(len(short), n, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)
            for k in range(n):
                value += mix(words[rows[short] + k] + _STEP[k]) * _STEP[k]
            out[out_rows[short]] = mix(value)
    return out, out_rows


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of every row."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        words, _, _, rows = word_hashes(part, offsets[lo:hi + 1] - offsets[lo])
        values, at = shingle_hashes(words, rows)
        for k in range(hi - lo):
            yield np.unique(values[at[k]:at[k + 1]])
