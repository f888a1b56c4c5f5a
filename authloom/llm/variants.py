"""Spelling variants: words one edit apart, by composing finite-state machines.

The accepted pairs of (vocabulary acceptor) o (one-edit transducer) o (vocabulary acceptor) are the pairs
of words that differ by one inserted, deleted or replaced character. The composition runs apart for each
initial state, the acceptor's state after a prefix that both words share, and with the reversed acceptor,
its state after a shared suffix:

1. Let m be the length of the longer word. The edit is at a place from 0 to m - 1, thus in the first or
   the second half; the halves give the keys (m, places, characters before them, characters after them).
   A word is the longer one (m = its length) or the shorter one, so it stands under four keys.
2. A key with more than ``most`` words is split in halves of its places again, down to single places,
   where a key holds at most one word per character and one without it. No group grows with the data.
3. A task builds the minimised acceptor of what the words of a key have at the key's places, and follows
   the composition: both sides in one state before the edit; after it two states, whose languages are
   intersected, or one, whose whole language counts. What follows an edit depends on states alone and is
   found once for all prefixes that lead to them.

A pair counts at the place of its first difference, which lies under exactly one key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store, small_batches
from authloom.llm.words import parts

RUN_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
HELD = 200_000   # words that a task adds up before it emits them
MOST = 20_000    # words of one key
KEY = ["m", "lo", "hi", "head", "tail"]


def _words(least_length: int, drop_every: int):
    """``word, n``: lower-cased letter runs of texts, with a character dropped from a hashed share of them.

    Latin-1 has one byte for each letter of the pattern, and other characters become ``?``, so bytes are
    code points here.
    """

    def run(batches):
        held: dict[bytes, int] = {}

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in held], pa.string()),
                 pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))], ["word", "n"])

        for rows in batches:
            for doc, text in zip(rows.column(0), rows.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start, get = crc32(((doc.as_py() or "") + ":").encode()), held.get
                counter: Counter[bytes] = Counter()
                for part in parts(text.encode("latin-1", "replace").translate(RUN_LETTERS)):
                    counter.update(part.split())
                for word, n in counter.items():
                    if len(word) < least_length:
                        continue
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % drop_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    held[word] = get(word, 0) + n
            if len(held) > HELD:
                yield batch()
                held.clear()
        yield batch()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
               least_count: int = 5, drop_every: int = 199) -> DataFrame:
    """``word, n`` of the words with at least that many characters and occurrences.

    A run is altered where ``drop_every`` divides the CRC of "id:run"; a null id counts as ''.
    """
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string"))
    return (rows.mapInArrow(_words(least_length, drop_every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


class Acceptor:
    """Minimised acyclic acceptor of sorted distinct strings: arcs and finality of every state, 0 is not special."""

    def __init__(self, strings: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[{}, False]]  # arcs and finality of the states along the last string
        last = ""

        def close(depth: int) -> None:
            """Replace the states below ``depth`` by equal known ones."""
            while len(path) > depth + 1:
                arcs, final = path.pop()
                path[-1][0][last[len(path) - 1]] = state(arcs, final)

        def state(arcs: dict[str, int], final: bool) -> int:
            key = (final, *arcs.items())
            at = known.get(key)
            if at is None:
                at = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(final)
            return at

        for s in strings:
            same = 0
            for a, b in zip(s, last, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            path.extend([{}, False] for _ in range(len(s) - same))
            path[-1][1] = True
            last = s
        close(0)
        self.root = state(*path[0])


class Composition:
    """Accepted pairs of acceptor o one edit o acceptor."""

    def __init__(self, acceptor: Acceptor) -> None:
        self.arcs, self.final, self.root = acceptor.arcs, acceptor.final, acceptor.root
        self.languages: dict[int, list[str]] = {}
        self.shared: dict[tuple[int, int], list[str]] = {}

    def language(self, q: int) -> list[str]:
        """What leads from a state to acceptance."""
        return self._memo(self.languages, q, lambda q: self.arcs[q].items(), lambda q: self.final[q])

    def both(self, q: int, r: int) -> list[str]:
        """What leads from both of two states to acceptance."""
        if q == r:
            return self.language(q)
        key = (q, r) if q < r else (r, q)
        if key in self.shared:
            return self.shared[key]
        x, y = self.arcs[key[0]], self.arcs[key[1]]
        if not (x.keys() & y.keys()):
            out = self.shared[key] = [""] if self.final[q] and self.final[r] else []
            return out

        def arcs(k):
            x, y = self.arcs[k[0]], self.arcs[k[1]]
            return [(c, (x[c], y[c]) if x[c] < y[c] else (y[c], x[c])) for c in x if c in y]

        return self._memo(self.shared, key, arcs, lambda k: self.final[k[0]] and self.final[k[1]])

    @staticmethod
    def _memo(known, start, arcs, final):
        """Strings from a node to acceptance, depth first without recursion."""
        stack = [start]
        while stack:
            node = stack[-1]
            if node in known:
                stack.pop()
                continue
            out = arcs(node)
            missing = [to for _, to in out if to not in known]
            if missing:
                stack.extend(missing)
                continue
            known[node] = ([""] if final(node) else []) + [c + s for c, to in out for s in known[to]]
            stack.pop()
        return known[start]

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of strings from a state that differ at their first character."""
        out = []
        arcs = list(self.arcs[q].items())
        for k, (a, p) in enumerate(arcs):
            for b, r in arcs[k + 1:]:
                out += [(a + s, b + s) for s in self.both(p, r)]
            out += [(a + s, s) for s in self.both(p, q) if s[:1] != a]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair once; of strings of unequal length the longer one first."""
        found: dict[int, list[tuple[str, str]]] = {}
        stack = [(self.root, "")]
        while stack:
            q, prefix = stack.pop()
            if q not in found:
                found[q] = self.edits(q)
            for x, y in found[q]:
                yield prefix + x, prefix + y
            stack.extend((to, prefix + c) for c, to in self.arcs[q].items())


def near_in_key(lo: int, m: int, hi: int, words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of one key's words (sorted) whose first difference is at one of its places.

    The first word of a pair has ``m`` characters. Where the shorter one ends with the key's places and
    the next character is the one it lacks, the words go on alike, and another key has the pair.
    """
    head, tail = words[0][:lo], words[0][len(words[0]) - (m - hi):]
    longest = hi - lo
    for x, y in Composition(Acceptor([w[lo:len(w) - (m - hi)] for w in words])).pairs():
        if len(x) < longest:  # two shorter words meet under another key
            continue
        if len(y) == longest or not tail or x[-1] != tail[0] or x[:-1] != y:
            yield head + x + tail, head + y + tail


def _groups(batches) -> Iterator[tuple[int, int, int, dict[str, int]]]:
    """``lo, m, hi`` and the words with their counts of each key; rows arrive sorted by key and word."""
    last, words = None, {}
    for batch in batches:
        m, lo, hi, head, tail, word, n = (c.to_pylist() for c in batch.columns)
        for k in zip(m, lo, hi, head, tail, word, n, strict=True):
            if k[:5] != last:
                if len(words) > 1:
                    yield last[1], last[0], last[2], words
                last, words = k[:5], {}
            words[k[5]] = k[6]
    if len(words) > 1:
        yield last[1], last[0], last[2], words


def _pairs(batches):
    a, b = [], []
    for lo, m, hi, words in _groups(batches):
        for x, y in near_in_key(lo, m, hi, list(words)):
            a.append(x)
            b.append(y)
        if len(a) > 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])
            a, b = [], []
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def _best(batches):
    """``word, n_near, best_n, best``: near words of a key counted, with the most frequent one."""
    names, out = ["word", "n_near", "best_n", "best"], []

    def batch():
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    for lo, m, hi, words in _groups(batches):
        here: dict[str, list] = {}
        for pair in near_in_key(lo, m, hi, list(words)):
            for x, y in (pair, pair[::-1]):
                one, n = here.setdefault(x, [0, 0, ""]), words[y]
                one[0] += 1
                if n > one[1] or (n == one[1] and y < one[2]):
                    one[1:] = n, y
        out += [(w, *one) for w, one in here.items()]
        if len(out) > 20_000:
            yield batch()
            out = []
    yield batch()


def keyed(words: DataFrame, store: Store, most: int = MOST) -> DataFrame:
    """``KEY, word, n``: words under their keys, keys of more than ``most`` words split, sorted in partitions."""

    def under(df: DataFrame, places) -> DataFrame:
        some = df.select("word", "n", F.inline(places)).where("lo < hi")
        return some.select("m", "lo", "hi", F.expr("substring(word, 1, lo)").alias("head"),
                           F.expr("right(word, m - hi)").alias("tail"), "word", "n")

    halves = "named_struct('m', {m}, 'lo', {lo}, 'hi', ({lo} + {hi}) div 2), named_struct('m', {m}, 'lo', ({lo} + {hi}) div 2, 'hi', {hi})"
    length = "cast(char_length(word) as long)"
    rows = store.save(under(words, F.expr("array(" + ", ".join(
        halves.format(m=m, lo="0L", hi=m) for m in (length, f"{length} + 1")) + ")")), "keys-0")
    out, step = None, 0
    while True:
        large = store.save(rows.where("hi - lo > 1").groupBy(*KEY).agg(F.count(F.lit(1)).alias("size"))
                           .where(F.col("size") > most).drop("size"), f"large-{step}", rows=rows.count() // most)
        whole = rows.join(large, KEY, "left_anti")
        out = whole if out is None else out.unionByName(whole)
        if large.isEmpty():
            return out.repartition(*KEY).sortWithinPartitions(*KEY, "word").select(*KEY, "word", "n")
        step += 1
        parts = rows.join(large, KEY, "left_semi")
        rows = store.save(under(parts.select("word", "n", F.expr(
            f"array({halves.format(m='m', lo='lo', hi='hi')})").alias("places")).select("word", "n", "places"),
            F.col("places")), f"keys-{step}")


@small_batches(5000)
def near_pairs(words: DataFrame, most: int = MOST) -> DataFrame:
    """``a, b``: every pair of words one edit apart, once; ``a`` is not the shorter one.

    ``words`` has ``word, n``, each word once; null words are left out, '' is one edit from any single
    character. An empty table gives an empty result.
    """
    store = Store(words.sparkSession, "variant-pairs")
    return store.save(keyed(words.where("word IS NOT NULL").select("word", "n"), store, most)
                      .mapInArrow(_pairs, "a string, b string"), "pairs")


def roots(forms: DataFrame, store: Store) -> DataFrame:
    """``word, root``: the end of the chain ``word -> form`` of every word, its path doubled in each round."""
    n = forms.count()
    now = store.save(forms.select("word", F.col("form").alias("root")), "roots-0", rows=n)
    step = 0
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step += 1
        now = store.save(now.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots-{step}",
            rows=n)
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


@small_batches(1000)
def variant_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6,
                  least_count: int = 5, drop_every: int = 199, ratio: int = 5, most: int = MOST) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: every word of the vocabulary with the spelling it varies.

    A word's form is its near word of largest count (ties: the smallest), if that is at least ``ratio``
    times its own; the root is where the forms end. Null texts have no words, a null id counts as '',
    repeated rows count each; other columns are ignored; an empty table gives an empty result.
    """
    store = Store(docs.sparkSession, "variants")
    words = store.save(vocabulary(docs, id_col, text_col, least_length, least_count, drop_every), "words")
    near = keyed(words, store, most).mapInArrow(_best, "word string, n_near long, best_n long, best string")
    near = near.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    is_form = F.expr(f"-b.less >= {int(ratio)} * n")
    seen = store.save(words.join(near, "word", "left").select(
        "word", F.when(is_form, F.col("b.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(is_form, -F.col("b.less")).alias("form_n")), "seen")
    ends = roots(seen.where("form IS NOT NULL").select("word", "form"), store)
    return seen.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
