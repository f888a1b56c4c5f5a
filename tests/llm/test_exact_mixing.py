import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from authloom.llm import exact_dedup, mixing
from tests.llm.helpers import LOWER, documents

TEXTS = [(4, "Same"), (9, "same"), (7, "SAME"), (1, None), (2, ""), (3, "Äb"), (5, "äb"), (6, "x" * 200_000),
         (8, "X" * 200_000), (None, "same"), (None, "alone"), (12, "t"), (12, "t")]


def norm(text):
    return (text or "").translate(LOWER)


def check(df, texts, keep=max):
    groups = {}
    for i, t in texts:
        groups.setdefault(norm(t), []).append(i)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect())
    want = Counter()
    for i, t in texts:
        members = groups[norm(t)]
        stays = keep((x for x in members if x is not None), default=None)
        want[i, stays, len(members), i == stays, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    assert got == want


def test_groups(spark):
    check(exact_dedup.exact_groups(documents(spark, TEXTS, extra=True)), TEXTS)
    check(exact_dedup.exact_groups(documents(spark, TEXTS), keep="min"), TEXTS, min)
    assert exact_dedup.exact_groups(documents(spark, TEXTS).limit(0)).count() == 0


def test_collisions_are_told_apart_by_bytes(spark):
    weak = lambda c: F.substring(F.md5(c), 1, 1)
    check(exact_dedup.exact_groups(documents(spark, TEXTS), digest=weak), TEXTS)
    check(exact_dedup.exact_groups(documents(spark, TEXTS), digest=lambda c: F.lit("0")), TEXTS)


def test_dropped_copies(spark):
    docs = documents(spark, TEXTS, extra=True)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(r[0] or -1 for r in rows) == [-1, 2, 3, 5, 8, 9, 12]
    assert {norm(t) for _, t in rows} == {norm(t) for _, t in TEXTS}


def poisson(u, rate):
    total, k = 0.0, 0
    while True:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        if total > u or total >= 1 - 1e-15:
            return k
        k += 1


def test_mixing(spark):
    texts = [(i, "ab" * (1 + i % 7)) for i in range(600)] + [(None, "no id"), (600, None), (1, "ab")]
    sources = ["big" if k % 3 else f"s{k % 5}" for k in range(602)] + [None]
    docs = documents(spark, texts, extra=True, sources=sources)
    out = mixing.mix(docs, weights={"big": 1, "s0": 3, "s1": 0, "s2": 2.5}, size=2.0)
    assert out.columns == [*[c for c in docs.columns if c != "copy"], "copy", "shuffle_key"]
    volume = Counter()
    for (_, t), s in zip(texts, sources, strict=True):
        volume[s] += len(t or "")
    weight = {"big": 1, "s0": 3, "s2": 2.5}
    want = Counter()
    for (i, t), s in zip(texts, sources, strict=True):
        rate = weight.get(s, 0) / sum(weight.values()) * sum(volume.values()) * 2 / volume[s] if volume[s] else 1.0
        key = str(i) if i is not None else "t" + hashlib.md5((t or "").encode()).hexdigest()
        u = int(hashlib.md5(f"{key}:17".encode()).hexdigest()[:13], 16) / 2**52
        for c in range(poisson(u, rate)):
            want[i, s, c + 1] += 1
    assert Counter((r["doc_id"], r["source"], r["copy"]) for r in out.collect()) == want


def test_mix_by_volume(spark):
    texts = [(i, "x" * 10) for i in range(4000)]
    sources = ["a"] * 3600 + ["b"] * 400
    out = mixing.mix(documents(spark, texts, sources=sources), alpha=0.5)
    n = Counter(r["source"] for r in out.collect())
    assert abs(n["a"] - 3000) < 250 and abs(n["b"] - 1000) < 150
    again = mixing.mix(documents(spark, texts, sources=sources).repartition(7), alpha=0.5)
    assert Counter(r["source"] for r in again.collect()) == n
    # sources without characters have rate 1
    blank = [r["doc_id"] for r in mixing.mix(documents(spark, [(k, None) for k in range(50)])).collect()]
    for k in range(50):
        assert blank.count(k) == poisson(int(hashlib.md5(f"{k}:17".encode()).hexdigest()[:13], 16) / 2**52, 1.0)
    assert mixing.mix(documents(spark, texts).limit(0)).count() == 0


def test_large_rates(spark):
    docs = documents(spark, [(1, "x")] + [(k, "y" * 100) for k in range(2, 52)], sources=["rare"] + ["rest"] * 50)
    out = mixing.mix(docs, weights={"rare": 1, "rest": 1})
    n = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    rate = 2500.5  # half of the characters from a text of one
    assert abs(n[1] - rate) < 5 * math.sqrt(rate)
    u = int(hashlib.md5(b"1:17").hexdigest()[:13], 16) / 2**52
    total, k = 0.0, 0
    while total <= u:
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        k += 1
    assert n[1] == k - 1
    assert mixing.mix(docs, weights={"rare": 1, "rest": 1}).agg(F.max("copy")).first()[0] == n[1]
