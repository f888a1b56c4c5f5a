import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from authloom.llm import grid_join, minhash
from authloom.llm.components import components, joined
from authloom.llm.store import Store
from authloom.llm.words import shingle_sets, word_hashes
from tests.llm.helpers import WORD, documents, near_groups, shingles, words


def star(rng, n, size, edits):
    """A text and variants that each have their own few words exchanged."""
    base = words(rng, size)
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(size)] = words(rng, 1)[0]
        out.append(" ".join(w))
    return out


def check(spark, texts, percent=85, extra=False, **more):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts, extra), percent=percent, **more).collect()}
    want = near_groups(texts, percent)
    for i, t in texts:
        if i is not None:
            assert got[i]["component_id"] == want[i], (i, t)
            assert got[i]["kept"] == (want[i] == i)
            assert got[i]["n_shingles"] == len(shingles(t))


def test_pairs_chains_and_stars(spark):
    rng = random.Random(1)
    texts = [t for n, size, edits in ((1, 60, 1), (6, 200, 2), (40, 150, 1), (30, 120, 3)) for t in star(rng, n, size, edits)]
    texts += [" ".join(words(rng, rng.randint(1, 80))) for _ in range(60)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)))
    check(spark, list(enumerate(texts)), percent=80)


def test_a_region_of_many_blocks(spark):
    rng = random.Random(2)
    texts = star(rng, 150, 150, 1) + star(rng, 100, 140, 1)
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), block=16)


def test_linked_pairs_on_one_template(spark):
    """Documents of one template that are just not alike, and pairs among them that just are."""
    rng = random.Random(11)
    template, texts = words(rng, 300), []
    for _ in range(150):
        own = words(rng, 8)
        for tail in (words(rng, 22), words(rng, 22)):
            texts.append(" ".join(template + own + tail))
    rng.shuffle(texts)
    texts = list(enumerate(texts))
    groups = near_groups(texts, 85)
    assert len(set(groups.values())) == 150
    check(spark, texts, block=16)


def morse(n, swap=False):
    """The Thue-Morse word of n letters, or its complement."""
    return "".join("ab"[(k.bit_count() + swap) % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_regular_words_are_told_apart(spark, n):
    """Words whose sums of powers are equal for every base."""
    common = [f"w{k}" for k in range(4)]
    texts = [(1, " ".join([*common, morse(n)])), (2, " ".join([*common, morse(n, True)])), (3, morse(n)), (4, morse(n, True))]
    check(spark, texts)


@pytest.mark.parametrize(("percent", "tile"), [(80, 3), (85, 1000), (50, 7)])
def test_allowed_pairs_hold_all_links(spark, percent, tile):
    """No pair at the threshold is missing, and few others are there."""
    rng = random.Random(percent)
    base, sets = [rng.getrandbits(63) for _ in range(120)], []
    for _ in range(90):
        n = rng.randint(1, 120)
        sets.append(np.unique(np.array(rng.sample(base, n) + [rng.getrandbits(63) for _ in range(rng.randint(0, n // 4))], dtype=np.uint64)))
    for _ in range(60):
        own = base[:100] + [rng.getrandbits(63) for _ in range(rng.randint(0, 22))]
        sets.append(np.unique(np.array(own[rng.randint(0, 12):], dtype=np.uint64)))
    df = spark.createDataFrame([(k, k // 2, bytearray(v.tobytes())) for k, v in enumerate(sets)], "id long, comp long, items binary")
    got = {tuple(r) for r in minhash.allowed_pairs(df.drop("comp"), df.drop("items"), percent, Store(spark, "allowed"), tile).collect()}
    want = set()
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            common = len(np.intersect1d(x, y))
            if a // 2 != b // 2 and 100 * common >= percent * (len(x) + len(y) - common):
                want.add((a, b))
    assert want and want <= got and len(got) < len(sets) ** 2 / 3


def test_a_large_template_without_links(spark):
    """Documents of one template with more own text than the threshold allows do not meet at all."""
    rng = np.random.default_rng(8)
    common = rng.integers(0, 2**63, 300).astype(np.uint64)
    rows = [(k, k, bytearray(np.unique(np.concatenate((common, rng.integers(0, 2**63, 45).astype(np.uint64)))).tobytes())) for k in range(3000)]
    df = spark.createDataFrame(rows, "id long, comp long, items binary")
    assert minhash.allowed_pairs(df.drop("comp"), df.drop("items"), 85, Store(spark, "template")).count() == 0


def test_odd_rows(spark):
    long = " ".join(words(random.Random(3), 30_000))
    texts = [(5, "A b C d e f"), (3, "a B c d e f"), (9, None), (8, ""), (7, " \t\r\n"), (6, "one two"), (4, "One  TWO"),
             (2, "x"), (1, "x y"), (None, "a b c d e f"), (11, long), (12, long + " end")]
    check(spark, texts, extra=True)
    rows = {r["doc_id"]: r for r in minhash.near_duplicates(documents(spark, texts)).collect()}
    assert rows[None]["component_id"] is None and rows[None]["kept"]
    assert [rows[i]["n_shingles"] for i in (9, 8, 7)] == [0, 0, 0] and rows[9]["component_id"] == 9
    assert minhash.near_duplicates(documents(spark, texts).where("doc_id < 0")).count() == 0


def test_repeated_rows_and_what_is_dropped(spark):
    texts = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (3, "other words than these are here")]
    kept = minhash.drop_near_copies(documents(spark, texts, extra=True))
    assert kept.columns == documents(spark, texts, extra=True).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 1, 3]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\né \x00\x1f\x85", max_size=20), max_size=6))
def test_words_and_shingles_of_any_text(texts):
    import pyarrow as pa

    column = pa.array(texts, pa.string())
    sets = list(shingle_sets(column))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for a, x in zip(texts, sets, strict=True):
        for b, y in zip(texts, sets, strict=True):
            assert (shingles(a) == shingles(b)) == (x.tolist() == y.tolist())
    data = "".join(texts).encode()
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts]))).astype(np.int64)
    *_, rows = word_hashes(np.frombuffer(data, dtype=np.uint8), offsets)
    assert np.diff(rows).tolist() == [len(WORD.findall(t)) for t in texts]


@pytest.mark.parametrize(("seed", "tail"), [(1, 1 << 17), (2, 0), (3, 20)])
def test_components(spark, seed, tail):
    rng = random.Random(seed)
    links = pairs = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(300, 380)]
    from tests.llm.helpers import Groups

    groups = Groups({x for p in links for x in p})
    for a, b in links:
        groups.link(a, b)
    store = Store(spark, "t")
    links = spark.createDataFrame(links, "a long, b long")
    got = components(links, store, "c", tail).collect()
    assert len(got) == len({r["id"] for r in got})
    got = {r["id"]: r["component"] for r in got}
    loops = {x for x in groups.up if all(p == (x, x) for p in pairs if x in p)}
    want = {x: groups.root(x) for x in groups.up if x not in loops}
    assert got == want

    # the same from a part of the links, with the others joined afterwards
    some = links.where("pmod(xxhash64(a, b), 2) = 0")
    known = components(some, store, "some", tail)
    both = joined(known, store.save(links, "links"), store, "both").collect()
    assert {r["id"]: r["component"] for r in both} == want and len(both) == len(want)
    assert joined(known, some, store, "none") is known


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, w string, x string, n string, dim string")


def compare(spark, rows, cosine=0.95, **more):
    from tests.llm.helpers import Groups

    got = {r["vec_id"]: r for r in grid_join.near_embeddings(vectors(spark, rows), cosine, **more).collect()}
    groups, n = Groups([r[0] for r in rows]), dict.fromkeys([r[0] for r in rows], 0)
    ok = [(r[0], np.array(r[1], dtype=np.float32).astype(np.float64)) for r in rows
          if r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    for k, (a, x) in enumerate(ok):
        for b, y in ok[:k]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                groups.link(a, b)
                n[a] += 1
                n[b] += 1
    for r in rows:
        assert (got[r[0]]["n_links"], got[r[0]]["component_id"]) == (n[r[0]], groups.root(r[0])), r[0]
        assert got[r[0]]["kept"] == (groups.root(r[0]) == r[0])


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(int(i), [float(v) for v in centres[i % 12] + rng.normal(size=8) * 0.15], int(i) % 3, "", "", "", "") for i in range(400)]
    rows += [(1000 + i, rows[7][1], 0, "", "", "", "") for i in range(30)]          # copies
    rows += [(2000 + i, [2 * v for v in rows[7][1]], 0, "", "", "", "") for i in range(3)]  # the same direction
    compare(spark, rows)
    compare(spark, rows, block=64, leaf=16, partners=2)


@pytest.mark.parametrize("bits", [1, 4])
def test_near_blocks_of_one_leading_cell(spark, bits):
    """Many blocks whose vectors share the cell of the first axis: pairs are about the near ones, not all."""
    rng = np.random.default_rng(bits)
    centre = np.concatenate((np.full((1500, 1), 0.1), np.sort(rng.random((1500, 1)), axis=0), rng.random((1500, 4))), axis=1)
    low, high = centre - 0.002, centre + 0.002
    number = [(k // 300 << 32) + k % 300 + 1 for k in range(1500)]
    rows = [(n, 8, a.tolist(), b.tolist()) for n, a, b in zip(number, low, high, strict=True)]
    df = spark.createDataFrame(rows, "block long, dim int, low array<double>, high array<double>")
    got = [tuple(r) for r in grid_join.close_blocks(df, 0.1, bits).collect()]
    gap = np.maximum(np.maximum(low[:, None] - high[None], low[None] - high[:, None]), 0)
    x, y = np.nonzero((gap ** 2).sum(axis=2) <= 0.01)
    assert sorted(got) == sorted((number[i], number[j]) for i, j in zip(x, y, strict=True) if i <= j)
    assert len(got) < 10_000
    assert grid_join.close_blocks(df.limit(0), 0.1).count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [1.0, 0.0], [2.0, 0.0], [1.0], [1e-30, 0.0], [1.0, -0.0]]
    rows = [(i, x, None, "", "", "", "") for i, x in enumerate(odd)]
    compare(spark, rows)
    out = grid_join.near_embeddings(vectors(spark, [*rows, (None, [1.0, 0.0], 1, "", "", "", "")])).collect()
    assert [r["n_links"] for r in out if r["vec_id"] is None] == [0]
    assert grid_join.near_embeddings(vectors(spark, rows).where("vec_id < 0")).count() == 0
