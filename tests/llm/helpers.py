"""Small tables and plain programs that the operators are held against."""

from __future__ import annotations

import random
import re

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark, texts, extra: bool = False, sources=None):
    """A documents table of (id, text) pairs, with columns of clashing names if wanted."""
    rows = [(i, t, "en", sources[k] if sources else f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]
    if not extra:
        return spark.createDataFrame(rows, DOCUMENTS)
    names = "id long, n long, kept string, keep string, digest string, copy string, row string, t string, score string, part string"
    return spark.createDataFrame(
        [(*r, 1, 2, "a", "b", "c", "d", "e", "f", "g", "h") for r in rows], f"{DOCUMENTS}, {names}")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4))


class Groups:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self, items) -> None:
        self.up = {x: x for x in items}

    def root(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def link(self, a, b) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def near_groups(texts, percent: int) -> dict:
    """The smallest linked id of every id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in texts if i is not None}
    groups = Groups(sets)
    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y:
                common = len(x & y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    groups.link(a, b)
    return {i: groups.root(i) for i in ids}
