import os
import random
import re
import zlib
from collections import Counter

import pytest

from authloom.llm import variants
from authloom.llm.queries import op11_spelling_variants
from authloom.llm.store import Store
from tests.llm.helpers import LOWER, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def near(u, v):
    """One inserted, deleted or replaced code point."""
    if len(u) < len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    return len(u) == len(v) + 1 and any(u[:k] + u[k + 1:] == v for k in range(len(u)))


def plain(texts, length=6, count=5, every=199, ratio=5):
    """Vocabulary, near words of all pairs, forms and roots."""
    words = Counter()
    for i, text in texts:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            words[run] += 1
    words = {w: n for w, n in words.items() if n >= count and len(w) >= length}
    form, n_near = {}, {}
    for u in words:
        others = [v for v in words if near(u, v)]
        n_near[u] = len(others)
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[u] = best if best and words[best] >= ratio * words[u] else None
    out = Counter()
    for u, n in words.items():
        root = u
        while form[root]:
            root = form[root]
        out[u, form[u], root, n, n_near[u], words[form[u]] if form[u] else None] += 1
    return out


def got(df):
    return Counter(tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect())


def corpus(seed, n, letters="abÀÿ", length=(5, 9)):
    rng = random.Random(seed)
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(*length))) for _ in range(300)]
    weight = [1 / (k + 1) for k in range(len(words))]
    return [(k, rng.choice([" ", "\n", "9", "日"]).join(rng.choices(words, weight, k=rng.randint(0, 120)))) for k in range(n)]


EDGES = [(None, "Strasse " * 9 + "STRASSE"), (7, None), (8, ""), (9, "x" * 50_000 + " " + "x" * 49_999), (9, ("y" * 3000 + " ") * 6),
         (10, ("y" * 2999 + " ") * 40), (11, "été" * 3), (12, "aaaaaa " * 6), (13, "aaaaa aaaaaaa " * 30), (13, "aaaaaaaa " * 200)]


@pytest.mark.parametrize("most", [3, 50, variants.MOST])
def test_equals_plain_program(spark, most):
    texts = corpus(most, 120) + EDGES
    want = plain(texts)
    assert got(variants.variant_forms(documents(spark, texts, extra=True), most=most)) == want
    assert sum(k[4] for k in want) > 5 and any(k[1] for k in want)


def test_chains_lead_to_their_end(spark):
    texts = [(0, "abcdef " * 5), (1, "abcdeg " * 25), (2, "abcdhg " * 125), (3, "abcihg " * 625), (4, "abjihg " * 3125)]
    rows = got(variants.variant_forms(documents(spark, texts), drop_every=1 << 40))
    assert {(r[0], r[1], r[2]) for r in rows} == {
        ("abcdef", "abcdeg", "abjihg"), ("abcdeg", "abcdhg", "abjihg"), ("abcdhg", "abcihg", "abjihg"),
        ("abcihg", "abjihg", "abjihg"), ("abjihg", None, "abjihg")}
    assert rows == plain(texts, every=1 << 40)


def test_ties_take_the_smallest(spark):
    texts = [(0, "zbcdef bbcdef " * 50 + "abcdef " * 5)]
    assert ("abcdef", "bbcdef", "bbcdef", 5, 2, 50) in got(variants.variant_forms(documents(spark, texts), drop_every=1 << 40))


@pytest.mark.parametrize("most", [1, 8, 1000])
def test_all_pairs_once(spark, most):
    """Dense short words: all pairs of full comparison, each once, however the keys are split."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("aab") for _ in range(rng.randint(0, 7))) for _ in range(200)})
    df = spark.createDataFrame([(w, 1) for w in words] + [(None, 1)], "word string, n long")
    pairs = Counter(frozenset(r) for r in variants.near_pairs(df, most=most).collect())
    assert pairs == Counter(frozenset((u, v)) for k, u in enumerate(words) for v in words[:k] if near(u, v))


def test_a_hot_key_is_split(spark):
    """Words of one prefix: no key keeps more words than allowed, but for single places."""
    words = [f"prefix{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}suffix" for a in range(12) for b in range(12) for c in range(12)]
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    keys = variants.keyed(df, Store(spark, "hot"), most=100)
    assert keys.groupBy(*variants.KEY).count().agg({"count": "max"}).first()[0] <= 100
    assert variants.near_pairs(df, most=100).count() == 3 * 144 * 66


def test_acceptor_is_minimal():
    """Equal endings share their states."""
    a = variants.Acceptor(sorted(["tap", "taps", "top", "tops"]))
    assert len(a.arcs) == 5
    assert sorted(variants.Composition(a).language(a.root)) == ["tap", "taps", "top", "tops"]
    assert sorted(map(sorted, variants.Composition(a).pairs())) == [["tap", "taps"], ["tap", "top"], ["taps", "tops"], ["top", "tops"]]


def test_empty(spark):
    assert variants.variant_forms(documents(spark, [(1, "x")]).limit(0)).count() == 0
    assert variants.variant_forms(documents(spark, [(1, None), (2, "")])).count() == 0


def test_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("needs the given tables")
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(op11_spelling_variants(spark, sf)) == plain(texts)
