import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from authloom.llm import hmm
from tests.llm.helpers import LOWER, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [""]


def is_held_out(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def forward(model, codes):
    """Log10 of the sum over all paths, token by token in double precision, and the scaled vectors."""
    log, x, out = 0.0, None, []
    for c in codes:
        x = (model.first if x is None else x @ model.move) * model.lift[c]
        log += math.log10(x.sum())
        x = x / x.sum()
        out.append(x)
    return log, out


def expectation(model, texts):
    """Expected first states, moves and emissions, text by text."""
    k, n = len(model.first), len(model.lift)
    first, move, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((n, k))
    for codes in texts:
        _, ahead = forward(model, codes)
        back = np.ones(k)
        for t in range(len(codes) - 1, -1, -1):
            g = ahead[t] * back
            g /= g.sum()
            emitted[codes[t]] += g
            if t:
                late = model.lift[codes[t]] * back
                x = ahead[t - 1][:, None] * model.move * late
                move += x / x.sum()
                back = model.move @ late
                back /= back.sum()
            else:
                first += g
    return first, move, emitted


def random_model(rng, states, classes):
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return hmm.Model(norm(rng.random(states)), norm(rng.random((states, states)) ** 3 + 1e-3), rng.random((classes, states)) * 3 + 0.05)


@pytest.mark.parametrize(("states", "chunk", "group"), [(1, 4, 50), (3, 1, 7), (4, 7, 40), (8, 512, 1 << 18)])
def test_recursions_equal_a_plain_program(states, chunk, group):
    rng = np.random.default_rng(states)
    model = random_model(rng, states, 30)
    texts = [rng.integers(0, 30, n) for n in [1, 2, 3, 7, 8, 15, 1, 60, 200]]
    lengths = np.array([len(t) for t in texts])
    counts = (np.zeros(states), np.zeros((states, states)), np.zeros((30, states)))
    got = hmm.Recursion(model, chunk, group).run(np.concatenate(texts), lengths, counts)
    assert np.allclose(got, [forward(model, t)[0] for t in texts], rtol=1e-4, atol=1e-4)
    for a, b in zip(counts, expectation(model, texts), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-3)


def test_likelihood_sums_to_one():
    """Over all texts of a few words that end, the probabilities come to one."""
    rng = np.random.default_rng(3)
    prior = rng.random(4)
    prior /= prior.sum()
    model = random_model(rng, 3, 4)
    model.lift /= prior @ model.lift
    total = 0.0
    texts = [[]]
    for _ in range(7):
        ended = [t + [0] for t in texts]
        total += sum(10 ** forward(model, t)[0] * np.prod(prior[t]) for t in ended)
        texts = [t + [c] for t in texts for c in (1, 2, 3)]
    total += sum(10 ** forward(model, t)[0] * np.prod(prior[t]) for t in texts)  # what has not ended yet
    assert abs(total - 1) < 1e-9


def plain(texts, states, rounds, share, least):
    """Base and model scores by loops over one text at a time."""
    count = Counter(w for i, t in texts if not is_held_out(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    bound = max(least, math.ceil(share * n))
    own = sorted((w for w in count if count[w] >= bound or not w), key=lambda w: (-count[w], w.encode()))
    ending = lambda w: zlib.crc32(w.encode()[-3:]) % hmm.SUFFIXES
    mass = Counter()
    for w in count:
        if w not in own:
            mass[ending(w)] += count[w] + 1
    ends = sorted(mass)
    at = {w: k for k, w in enumerate(own)}
    of = lambda w: at[w] if w in at else len(own) + (ends.index(ending(w)) if ending(w) in mass else len(ends))
    prior = np.array([count[w] + 1 for w in own] + [mass[e] + 1 for e in ends] + [1], dtype=float) / (n + v + len(ends) + 1)
    assert abs(prior.sum() - 1) < 1e-9
    classes = hmm.Classes({}, np.zeros(0), np.zeros(0), prior, n, v, len(ends) + 1)
    model = hmm.first_model(classes, states)
    coded = [[of(w) for w in tokens(t)] for _, t in texts]
    for _ in range(rounds):
        first, move, emitted = expectation(model, [c for c, (i, _) in zip(coded, texts, strict=True) if not is_held_out(i)])
        share_of = (emitted.sum(axis=0) + 1) / (emitted.sum() + states)
        lift = (emitted / share_of + hmm.PRIOR) / (emitted.sum(axis=1, keepdims=True) + hmm.PRIOR)
        lift = (1 - hmm.FLOOR) * lift / (prior @ lift) + hmm.FLOOR
        model = hmm.Model((first + 1) / (first.sum() + states), (move + 1) / (move.sum(axis=1, keepdims=True) + states), lift)
    assert np.allclose(prior @ model.lift, 1)
    out = []
    for (i, t), codes in zip(texts, coded, strict=True):
        words = tokens(t)
        log = sum(math.log10(count[w] + 1) for w in words)
        out.append((i, is_held_out(i), len(words), sum(w in count for w in words), n,
                    log - len(words) * math.log10(n + v + 1),
                    log - len(words) * math.log10(n + v + len(ends) + 1) + forward(model, codes)[0]))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabularies = [["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(40)] for s in ("abcd", "dÄéç", "xyz.")]
    return [(k, rng.choice([" ", "\n", "\t\x0b"]).join(rng.choices(vocabularies[k % 3], k=rng.randint(0, 60)))) for k in range(n)]


EDGES = [(None, "Ab aB"), (500, None), (501, ""), (502, "  \n"), (503, "long word " * 3000), (504, "w" * 100_000), (505, "a\x1cb A\x1cB"),
         (506, "never-seen-éé other-new"), (506, "never-seen-éé other-new")]


def check(df, want):
    key = lambda r: (str(r[0]), r[2], r[3], r[5])
    got = sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=key)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5]
        assert a[5] == pytest.approx(b[5], rel=1e-9, abs=1e-9) and a[6] == pytest.approx(b[6], rel=1e-3, abs=2e-3)


@pytest.mark.parametrize(("states", "least"), [(1, 20), (3, 20), (2, 1)])
def test_equals_plain_program(spark, states, least):
    texts = corpus(states, 60) + EDGES
    df = hmm.score_documents(documents(spark, texts, extra=True), states=states, rounds=2, share=1e-3, least=least)
    check(df, plain(texts, states, 2, 1e-3, least))


def test_states_find_what_a_text_is_made_of(spark):
    """Held-out texts of three vocabularies are likelier than by single words."""
    rows = hmm.score_documents(documents(spark, corpus(9, 300))).where("held_out AND n_tokens > 20").collect()
    gain = sum(r["score"] - r["base_score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert len(rows) > 10 and gain > 0.25


def test_nothing_to_learn_from(spark):
    held = [i for i in range(100) if is_held_out(i)][:3]
    rows = hmm.score_documents(documents(spark, [(held[0], "a b"), (held[1], None), (held[2], "")])).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows} == {
        (held[0], 3, 0, 0, 0.0), (held[1], 1, 0, 0, 0.0), (held[2], 1, 0, 0, 0.0)}
    assert all(abs(r["score"]) < 1e-6 for r in rows)
    assert hmm.score_documents(documents(spark, corpus(1, 3)).limit(0)).count() == 0
