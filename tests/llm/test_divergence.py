import random
import re
from collections import Counter

import pytest

from authloom.llm import divergence
from tests.llm.helpers import LOWER

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", term string, n long, p long, part string, rank string, total string, first string"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def plain(rows, least=3, top=200):
    """The audit in exact integers, group by group and term by term."""
    docs = [(r[2] or "", r[3] or "", TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    frequency, count = Counter(), Counter()
    for lang, source, terms in docs:
        frequency.update((lang, t) for t in set(terms))
        count.update((lang, source, t) for t in terms)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (l, t), n in frequency.items() if l == lang and n >= least)
        sources = sorted({d[1] for d in docs if d[0] == lang})
        n = {s: [count[lang, s, t] for t in kept] for s in sources}
        whole = [sum(n[s][k] for s in sources) for k in range(len(kept))]
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        far = lambda p, q: (p - q) ** 2 // q
        p, q = {s: share(n[s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(-sum(map(far, p[s], p[o])), o.encode(), o) for o in sources if o != s]
            terms = [(-far(a, b), t.encode(), t) for a, b, t, c in zip(p[s], q, kept, n[s], strict=True) if c and a > b]
            for part, some in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -value, k) for k, (value, _, item) in enumerate(some, 1)]
    return Counter(out)


def corpus(seed, n, sources):
    rng = random.Random(seed)
    words = ["the", "The", "été", "ÉTÉ", "x1y", "naïve", "日本", "end.", "a-b", "_", "\x7f", "ß"] + [
        "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        rows.append((k, rng.choice([None, text, text, text, ""]), rng.choice(["en", "fr", None, ""]),
                     rng.choice(sources), len(text)))
    return rows


EDGES = [(None, "alone here", "only", "s", 1), (1, None, "none", None, 0), (1, None, "none", "", 0), (1, "", "none", "t", 0),
         (2, "long " * 100_000, "de", "a", 1), (2, "long " * 3, "de", "b", 1), (2, "long " * 3, "de", "b", 1)]


def got(df):
    return Counter(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in df.collect())


@pytest.mark.parametrize("sources", [["a", "b", None, ""], [f"s{k}" for k in range(23)]])
def test_equals_plain_program(spark, sources):
    rows = corpus(len(sources), 150, sources) + EDGES
    assert got(divergence.audit(spark.createDataFrame(rows, SCHEMA))) == plain(rows)
    wide = spark.createDataFrame([(*r, "a", 1, 2, "b", "c", "d", "e") for r in rows], SCHEMA + EXTRA)
    assert got(divergence.audit(wide, top=3, least_docs=1)) == plain(rows, 1, 3)


def test_tiles_of_blocks_and_parts(spark):
    """Many blocks of few sources and many parts of the terms give the same sums."""
    rows = corpus(5, 200, [f"s{k}" for k in range(17)])
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = divergence.term_counts(docs)
    groups = divergence.groups_of(docs, counts)
    sums = divergence.pair_sums(counts, groups, block=3, part_rows=20)
    want = {k[:4] + (k[4],) for k in plain(rows) if k[2] == "pair"}
    assert {(r["lang"], r["source"], "pair", r["item"], r["value"]) for r in sums.collect()} == want


def test_counts_beyond_a_long(spark):
    """A share is exact where a billion times the count is no long any more."""
    n = 3 * 10**12
    row = spark.range(1).select(divergence.share(divergence.F.lit(n), divergence.F.lit(n + 7), divergence.F.lit(5)).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 1) // (n + 12)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
