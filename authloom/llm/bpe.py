"""BPE encoding by a pair occurrence index, and decoding.

All distinct new pieces of a block of texts are laid out as linked symbols. The index maps every
mergeable pair, by its rank, to all its positions. Active ranks are taken in ascending order from a
heap; all positions of a rank are merged at once, and the lists of the pairs left and right of them
are updated. As merges never cross pieces, this gives each piece the merges it would get alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm import pieces
from authloom.llm.store import bounded_batches

BLOCK_BYTES = 6 << 20
SLICE_CHARS = 1 << 19


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class PairIndex:
    """Merges of one vocabulary, applied to many pieces at once."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = "") -> None:
        symbols = byte_symbols()
        self.inner = np.array([vocab.get(s, -1) for s in symbols], dtype=np.int64)
        self.last = np.array([vocab.get(s + suffix, -1) for s in symbols], dtype=np.int64)
        self.size = max(vocab.values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.left, self.right = left, right
        keys = left * self.size + right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it doesn't merge."""
        if not len(self.keys):
            return np.full(len(left), -1, dtype=np.int64)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids one after the other."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        n, ends = len(data), np.cumsum(lengths)
        symbol = self.inner[data]
        final = ends[lengths > 0] - 1
        symbol[final] = self.last[data[final]]
        after = np.arange(1, n + 1)
        after[final] = -1
        before = np.arange(-1, n - 1)
        before[(ends - lengths)[lengths > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Put the pairs that begin at these positions into the lists of their ranks."""
            rank = self.ranks(symbol[at], symbol[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            for r, some in zip(rank[np.concatenate(([0], cut))].tolist(), np.split(at, cut), strict=True):
                if r in index:
                    index[r].append(some)
                else:
                    index[r] = [some]
                    heapq.heappush(heap, r)

        enter(np.flatnonzero(after >= 0))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            at = at[symbol[at] == a]
            at = at[after[at] >= 0]
            at = at[symbol[after[at]] == b]
            if a == b and len(at) > 1:  # of overlapping pairs every other one, from the left
                linked = np.concatenate(([False], after[at[:-1]] == at[1:]))
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - head) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            onward = after[gone]
            symbol[at] = self.result[r]
            symbol[gone] = -1
            after[at] = onward
            some = onward >= 0
            before[onward[some]] = at[some]
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate((left, at[some]))
            if len(touched):
                enter(np.unique(touched))
        alive = symbol >= 0
        counts = np.add.reduceat(alive, (ends - lengths)[lengths > 0]) if n else np.zeros(0, dtype=np.int64)
        out = np.zeros(len(words), dtype=np.int64)
        out[lengths > 0] = counts
        return out, symbol[alive].astype(np.int32)


class PieceCoder:
    """Encodes texts piece by piece, remembering the ids of pieces; special tokens are cut out first."""

    def __init__(self, special: dict[str, int]) -> None:
        self.special = special
        self.parts = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.table = pieces.PieceTable()

    def normal(self, text: str) -> str:
        return text

    def split(self, cp: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and all ids one after the other."""
        raise NotImplementedError

    def segments(self, texts: list[str]) -> tuple[list[str], list[tuple[int, int | None]]]:
        """Texts cut at special tokens: ordinary segments, and (text number, special id or None) of each."""
        out, owner = [], []
        for k, text in enumerate(texts):
            cut = [text] if self.parts is None else self.parts.split(text)
            for part in cut:
                out.append("" if part in self.special else self.normal(part))
                owner.append((k, self.special.get(part)))
        return out, owner

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        self.table.trim()
        segs, owner = self.segments(texts)
        words, numbers, counts, fresh = [], {}, [], []  # numbers: second hash and place in fresh, by first hash
        strays, odd = {}, []  # pieces whose first hash another one has: place in odd, by text
        # 1. find the pieces of bounded slices, and the ones not seen before
        lo = 0
        while lo < len(segs):
            hi, size = lo, 0
            while hi < len(segs) and (hi == lo or size + len(segs[hi]) <= SLICE_CHARS):
                size += len(segs[hi])
                hi += 1
            rows = np.concatenate(([0], np.cumsum([len(s) for s in segs[lo:hi]]))).astype(np.int64)
            joined = "".join(segs[lo:hi])
            cp = pieces.code_points(joined)
            starts, ends = self.split(cp, rows)
            first, second = pieces.piece_hashes(cp, starts, ends)
            value, where, inverse = np.unique(first, return_index=True, return_inverse=True)
            known = self.table.find(value, second[where]).astype(np.int64)
            for k in np.flatnonzero(known == -1).tolist():
                h, check = int(value[k]), int(second[where[k]])
                mine = numbers.setdefault(h, (check, len(fresh)))
                if mine[1] == len(fresh):
                    fresh.append(joined[starts[where[k]]:ends[where[k]]])
                known[k] = len(self.table) + mine[1] if mine[0] == check else -2
            found = known[inverse]
            found[second != second[where][inverse]] = -2
            for k in np.flatnonzero(found == -2).tolist():
                text = joined[starts[k]:ends[k]]
                if strays.setdefault(text, len(odd)) == len(odd):
                    odd.append(text)
                found[k] = -3 - strays[text]
            words.append(found)
            counts.append(np.diff(np.searchsorted(starts, rows)))
            lo = hi
        # 2. merge the new ones together
        first_odd = len(self.table) + len(fresh)
        if fresh or odd:
            self.table.add([(h, check) for h, (check, _) in numbers.items()], *self.merge(fresh + odd))
        for found in words if odd else []:
            found[found < -2] = first_odd - 3 - found[found < -2]
        # 3. look all up
        out: list[list[np.ndarray]] = [[] for _ in texts]
        seg = 0
        for which, count in zip(words, counts, strict=True):
            flat, n = self.table.ids(which)
            word_end = np.concatenate(([0], np.cumsum(n)))
            cut = word_end[np.concatenate(([0], np.cumsum(count)))]
            for k in range(len(count)):
                text, special = owner[seg]
                out[text].append(np.array([special], dtype=np.int32) if special is not None else flat[cut[k]:cut[k + 1]])
                seg += 1
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


class WordBpe(PieceCoder):
    """A vocabulary with word ends: lower-cased pieces without white space, merged by a pair index."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        model = spec["model"]
        self.index = PairIndex(model["vocab"], model["merges"], model.get("end_of_word_suffix") or "")
        self.tokens = np.full(max([*model["vocab"].values(), *self.special.values()]) + 1, "", dtype=object)
        for token, k in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[k] = token

    def normal(self, text: str) -> str:
        """Composed and lower-cased, character by character."""
        if not text.isascii():
            # a final sigma is no special case for a lower-casing that sees single characters
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").translate(pieces.NEW_LOWER)
        return text.lower()

    def split(self, cp, rows):
        return pieces.split_plain(cp, rows)

    def merge(self, words):
        return self.index.encode([w.encode("utf-8", "surrogatepass") for w in words])

    def decode(self, ids: np.ndarray) -> str:
        """The tokens' own texts, joined by blanks: this vocabulary file names no decoder."""
        return " ".join(self.tokens[ids].tolist())


@cache
def word_bpe(path: str) -> WordBpe:
    """One encoder per Python worker."""
    return WordBpe(path)


def blocks(batches: Iterator[pa.RecordBatch], text_at: int, most: int = BLOCK_BYTES) -> Iterator[list[pa.RecordBatch]]:
    """Consecutive batches with about ``most`` bytes of text together."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text_at).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                     with_ids: bool = True) -> DataFrame:
    """``id, n_tokens, ids_sha256, decoded_sha256`` and, if wanted, ``ids`` and ``decoded``.

    One row per row of ``docs``; null texts count as empty and have no ids, and null or repeated ids
    are carried along. Other columns are ignored; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def run(batches):
        coder = word_bpe(path)
        for group in blocks(batches, 1):
            texts = [t or "" for b in group for t in b.column(1).to_pylist()]
            ids = iter(coder.encode(texts))
            for batch in group:
                own = [next(ids) for _ in range(batch.num_rows)]
                decoded = [coder.decode(x) for x in own]
                little = [x.astype("<u4").tobytes() for x in own]
                columns = [
                    batch.column(0), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in little], pa.string()),
                    pa.array([hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in decoded], pa.string())]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([x.tolist() for x in own], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)
