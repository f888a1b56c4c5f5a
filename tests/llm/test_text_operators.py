import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from authloom.llm import chat, pii, quality, token_counts
from authloom.llm.store import Store
from authloom.llm.words import parts
from tests.llm.helpers import documents, words

CONVERSATIONS = "conv_id long, turn long, role string, text string, pos string, conv string, part string"


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        c = int(c)
        total += (c * 2 - 9 if c > 4 else c * 2) if k % 2 else c
    return total % 10 == 0


def digits(text):
    return re.sub("[^0-9]", "", text)


RULES = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
}


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in RULES.items() for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans(spark):
    rng = random.Random(3)
    parts = ["4111111111111111", "4111 1111 1111 1111", "+1 (269) 555-3296", "+1", "1.2.3.4", "256.1.1.1", "001.02.3.4", "a@b.c",
             "a@b.c.d@e.f", "a.b+c@d-e.co.uk", "x@y", "é", "\U0001f389", " ", "-", ".", "@", "+", "(", "9" * 13, "a@b.com+x@y.z", "%"]
    texts = [(i, "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14)))) for i in range(800)]
    texts += [(800, "1 " * 20_000), (801, "a" * 50_000), (802, "a.b" * 9000 + "@" + "c.d" * 9000), (803, "1." * 20_000), (804, None),
              (805, ""), (None, "a@b.c"), (3, "x@y.zz")]
    rows = pii.find_personal_data(documents(spark, texts, extra=True)).collect()
    got = {(r["doc_id"], r["base_sha256"]) for r in rows}
    assert len(rows) == len(texts)
    assert got == {(i, hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in texts}
    for r in rows:
        spans = [s for s in r["spans"].split(",") if s]
        assert [sum(s.startswith(k) for s in spans) for k in pii.KINDS] == [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]]
    assert pii.find_personal_data(documents(spark, texts).limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    seeds = [(i, f"please tel: +1 ({200 + i}) 555-{1000 + i} now and mailto: u{i}@h{i}.example.com ok") for i in range(8)]
    hidden = [(100, "so tel: (321) 555-7654 then"), (101, "mailto: joe [at] mail [dot] org"), (102, "code (321) 555-7654 then"),
              (103, "words of joe [at] mail [dot] org")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, seeds + hidden)).collect()}
    assert rows[100] == "phone:8:22" and rows[101] == "email:8:31"
    # a word that mostly stands before other things is no pattern
    assert rows[102] == "" and rows[103] == ""
    few = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, seeds[:2] + hidden)).collect()}
    assert few[100] == ""


def test_contexts_of_any_white_space_and_glued_labels(spark):
    seeds = [(i, f"see tel:+1({200 + i})555-{1000 + i} or\nPhone:\t+1 ({200 + i}) 555-{2000 + i} {' ' * 80}Call:\r\n{' ' * 62}+1 ({200 + i}) 555-{3000 + i}")
             for i in range(8)]
    hidden = [(100, "so tel:(321) 555-7654 then"), (101, "Phone:\n(321) 555-7654"), (102, f"{'x' * 70} Call: {' ' * 60}(321) 555-7654"),
              (103, "xx:(321) 555-7654 then"), (104, "xx: stands alone"), (105, "\n\t(321) 555-7654")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, seeds + hidden)).collect()}
    assert [rows[k] for k, _ in hidden] == ["phone:7:21", "phone:7:21", "phone:137:151", "", "", ""]


def test_later_rounds_find_what_the_first_cannot(spark):
    """Seeds back the word after them, that finds numbers, these back the word before them, and that finds others."""
    seeds = [(i, f"reach +1(20{i})555-1000 please") for i in range(4)]
    second = [(10 + i, f"dial (32{i}) 555-7600\n please") for i in range(4)]
    third = [(20 + i, f"dial (43{i}) 555-7700 tomorrow") for i in range(4)]
    fourth = [(30, "ring (549) 555-7800 tomorrow"), (31, "ring (548) 555-7801 today")]
    texts = seeds + second + third + fourth
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, texts)).collect()}
    assert all(rows[i]["n_phone"] == 1 for i, _ in seeds + second + third) and rows[30]["n_phone"] == 1
    assert rows[31]["spans"] == ""  # only one number backs the word before it
    # without the second step the chain ends
    rows = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, seeds + third + fourth)).collect()}
    assert not any(rows[i]["n_phone"] for i, _ in third + fourth)


def test_precision_and_recall_on_labelled_contexts(spark):
    """Numbers of people behind labels and before units, numbers of things behind other words."""
    rng = random.Random(12)
    number = lambda: f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
    texts, want = [], set()
    for i in range(400):
        kind = i % 4
        label = rng.choice(["phone:", "mobile", "call", "fax/"])
        thing = rng.choice(["part", "order", "serial", "row"])
        filler = " ".join(words(rng, rng.randint(2, 9)))
        if kind == 0:
            texts.append((i, f"{filler} {label} +1{number()} {filler}"))
        elif kind == 1:
            texts.append((i, f"{filler} {label} {number()} {filler}"))
            want.add(i)
        else:
            texts.append((i, f"{filler} {thing} {number()} {filler} {thing} {filler}"))
    rows = {r["doc_id"]: r["n_phone"] for r in pii.find_personal_data(documents(spark, texts)).collect()}
    found = {i for i, _ in texts if i % 4 and rows[i]}
    assert len(found & want) >= 0.95 * len(want) and len(found - want) <= 0.02 * len(texts)


def test_a_label_is_counted_wherever_it_stands(spark):
    # the label stands before something else more often than before a number, once alone or not at all
    seeds = [(i, f"note id:+1({200 + i})555-{1000 + i}") for i in range(8)]
    other = [(20 + i, f"id:w{'abcdefghijklmnop'[i]}") for i in range(16)] + [(50, "id: alone")]
    rows = {r["doc_id"]: r["spans"] for r in pii.find_personal_data(documents(spark, [*seeds, *other, (100, "id:(321) 555-7654")])).collect()}
    assert rows[100] == ""


def test_words_occur_at_least_as_often_as_they_precede_spans(spark):
    texts = [(1, "tel321-555-7654 a:b+1(200)555-1000 \u00e9joe@h.org 'x@y.org' " + "q/" * 50 + "(321) 555-7654"), (2, None), (3, ""),
             (4, "tel321-555-7654\ttel " + "z" * 80 + " 1.2.3.4"), (5, '"phone":"+1(200)555-1000","phone":"none"')]
    docs = documents(spark, texts)
    found = pii.find_spans(docs, "text", "doc_id").cache()
    times = {r["word"]: r["times"] for r in pii.word_counts(docs, found, "text").collect()}
    met = {}
    for r in found.collect():
        for m in [*r["base"], *r["loose"]]:
            if m["word"] is not None:
                met.setdefault((m["kind"], m["word"]), []).append(m["start"])
    assert met and all(times[w] >= len(v) for (_, w), v in met.items())
    assert times["tel"] == 3 and times['"phone":"'] == 1


def expected_chats(rows):
    convs = {}
    for c, turn, role, text in {(c, -1 if t is None else t, r or "", x or "") for c, t, r, x, *_ in rows if c is not None}:
        convs.setdefault(c, []).append((turn, role, text))
    seqs = {c: tuple((r, x) for _, r, x in sorted(v)) for c, v in convs.items()}
    out = {}
    for c, s in seqs.items():
        same = [d for d in seqs if seqs[d] == s]
        if c == min(same) and not any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            out[c] = (len(s), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in s))
    return out


def test_snapshots_collapse(spark):
    rng = random.Random(7)
    rows, log = [], [[("user", w), ("assistant", w + "!"), ("user", w * 2)] for w in words(rng, 12)]
    for c in range(60):
        turns = log[rng.randrange(12)][:rng.randint(1, 3)]
        rows += [(c, 2 * k, r, t, "", "", "") for k, (r, t) in enumerate(turns)]
    rows += [(70, None, None, None, "", "", ""), (70, 1, "user", "hi", "", "", ""), (70, 1, "user", "hi", "", "", ""),
             (71, 1, "a", "tie", "", "", ""), (71, 1, "b", "tie", "", "", ""), (None, 0, "user", "lost", "", "", ""),
             (72, 0, "user", "x" * 100_000, "", "", "")]
    rows += [(80, k, "user", f"t{k}", "", "", "") for k in range(700)] + [(81, k, "user", f"t{k}", "", "", "") for k in range(600)]
    # turn numbers far apart
    rows += [(90, k * 10**12, "user", f"far {k}", "", "", "") for k in range(600)]
    rows += [(91, k * 10**12, "user", f"far {k}", "", "", "") for k in range(599)]
    rng.shuffle(rows)
    got = chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    texts, facts = {}, {}
    for r in sorted(got, key=lambda r: (r["conv_id"], r["part"])):
        texts[r["conv_id"]] = texts.get(r["conv_id"], "") + r["text"]
        facts[r["conv_id"]] = (r["n_turns"], r["n_same"])
    want = expected_chats(rows)
    assert {c: (*facts[c], texts[c]) for c in texts} == want
    assert sorted(r["part"] for r in got if r["conv_id"] == 80) == [0, 1, 2] and 81 not in texts and 91 not in texts
    assert chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS).limit(0)).count() == 0


CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, old_tokens long"


def totals(roll):
    return {tuple(r[:3]): (r["docs"], r["tokens"]) for r in roll.totals().collect()}


def test_rollups(spark):
    roll = token_counts.Rollup(spark)
    one = [("insert", 1, "a", "en", "v1", 10, None), ("insert", 2, "a", "en", "v1", 5, None), ("insert", 2, "a", "en", "v1", 5, None),
           ("insert", 3, None, None, "v1", None, None), ("insert", 4, "b", "de", "v2", 7, None)]
    roll.commit(1, spark.createDataFrame(one, CHANGES))
    assert totals(roll) == {("a", "en", "v1"): (2, 15), (None, None, "v1"): (1, 0), ("b", "de", "v2"): (1, 7)}
    two = [("revise", 1, "a", "en", "v1", 12, 10), ("delete", 4, "b", "de", "v2", 7, None)]
    for _ in range(3):  # delivered again
        roll.commit(2, spark.createDataFrame(two, CHANGES))
    assert totals(roll) == {("a", "en", "v1"): (2, 17), (None, None, "v1"): (1, 0)}
    roll.commit(3, spark.createDataFrame([], CHANGES))
    roll.commit(1, spark.createDataFrame(one[:1], CHANGES))  # a corrected batch replaces the first delivery
    assert totals(roll)["a", "en", "v1"] == (1, 12)
    with pytest.raises(Exception, match="unknown change"):
        roll.commit(4, spark.createDataFrame([("update", 1, "a", "en", "v1", 1, 1)], CHANGES))
    assert totals(roll)["a", "en", "v1"] == (1, 12)


def test_changes_without_document_and_named_changes(spark):
    """Changes without id are changes each; a named change counts once, however often it comes."""
    roll = token_counts.Rollup(spark)
    assert roll.totals().count() == 0 and roll.totals().columns == ["source", "lang", "tokenizer", "docs", "tokens"]
    row = ("insert", None, "a", "en", "v", 3, None)
    roll.commit(1, spark.createDataFrame([row, row, ("insert", 7, "a", "en", "v", 3, None)], CHANGES))
    assert totals(roll) == {("a", "en", "v"): (3, 9)}
    named = [(*row, 5), (*row, 5), (*row, 6), (*row, None), (*row, None)]
    extra = spark.createDataFrame([(*r, 1, "x") for r in named], CHANGES + ", change long, docs long, batch string")
    roll.commit(2, extra)
    assert totals(roll) == {("a", "en", "v"): (7, 21)}
    docs = documents(spark, [(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (2, None)], sources=["s"] * 5)
    rows = token_counts.counted(docs, {"w": r"\w+"}, {"tokens": F.col("text")})
    other = token_counts.Rollup(spark)
    kept = Store(spark, "named").save(rows.withColumn("old_tokens", F.lit(None).cast("long")), "counts")
    other.commit(1, kept.unionByName(kept).select(F.lit("insert").alias("op"), "*"))
    assert totals(other) == {("s", "en", "w"): (5, 6)}


def test_turns_that_a_separator_would_confuse(spark):
    rows = [(1, 0, "a", "b\u0001c", "", "", ""), (2, 0, "a\u0001b", "c", "", "", ""), (3, 0, "a:1", "b", "", "", ""),
            (4, 0, "a", ":1b", "", "", ""), (5, 0, "1", "2:x", "", "", ""), (6, 0, "12", ":x", "", "", "")]
    got = chat.format_chats(spark.createDataFrame(rows, CONVERSATIONS)).collect()
    assert sorted(r["conv_id"] for r in got) == [1, 2, 3, 4, 5, 6]


def test_one_far_turn_among_dense_ones(spark):
    """Blocks follow the turns, not their numbers: also with one far away, and with many that have none."""
    rows = spark.range(20_000).selectExpr("1L AS conv_id", "if(id < 5000, NULL, id) AS turn", "'user' AS role", "'t' || id AS text")
    rows = rows.unionByName(spark.createDataFrame([(1, 10**12, "user", "far"), (2, 1, "user", "x")], rows.schema))
    store = Store(spark, "far")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    turns = chat.numbered_turns(rows, store).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(r["pos"] for r in turns if r["conv"] == 1) == list(range(1, 20_002))
    assert [r["text"] for r in turns if r["conv"] == 1 and r["pos"] == 20_001] == ["far"]
    sizes = [r["count"] for r in store.load("ranges", spark.read.parquet(f"{store.path}/ranges")).groupBy("conv", "block").count().collect()]
    assert len(sizes) > 2 and max(sizes) < 12_000


def corpus(rng, n):
    out = []
    for i in range(n):
        w = words(rng, 30)
        good = i % 4 != 0
        out.append((i, " ".join(w).capitalize() + "." if good else " | ".join(x.upper() + "!!" for x in w), int(good)))
    return out


def test_quality(spark):
    rows = corpus(random.Random(5), 400)
    docs = documents(spark, [(i, t) for i, t, _ in rows] + [(None, rows[0][1]), (900, None), (901, ""), (902, "w " * 40_000), (3, rows[3][1])],
                     extra=True)
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows] + [(5, 0, 0), (None, 1, 1), (900, None, 0)],
                                   "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    out = quality.score(docs, model).collect()
    assert len(out) == 405 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in out)
    truth = {i: q for i, _, q in rows}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    import zlib

    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in out)
    # ids, sources and languages are no inputs
    moved = docs.selectExpr("doc_id + 5000 AS doc_id", "text", "'xx' AS lang", "'yy' AS source")
    again = {r["doc_id"] - 5000: r["score"] for r in quality.score(moved, model).collect() if r["doc_id"] is not None}
    assert all(again[r["doc_id"]] == r["score"] for r in out if r["doc_id"] is not None)


def test_quality_without_both_labels(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}
    good = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert all(r["predicted"] for r in quality.score(docs, quality.train(docs, good)).collect())
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, good)).count() == 0


def test_dual_coordinate_descent_finds_the_margin():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for k in range(200):
        label = 1 if k % 2 else -1
        rows.append(np.unique(np.concatenate((rng.integers(0, 1000, 20), [2000 + (label > 0)]))).astype(np.uint32))
        y.append(label)
    y = np.array(y)
    model = quality.fit(rows, y)
    assert all((model.margin(r) > 0) == (t > 0) for r, t in zip(rows, y, strict=True))


@pytest.mark.parametrize(("epochs", "near"), [(400, 1.002), (quality.EPOCHS, 1.03)])
def test_descent_equals_a_plain_solver(monkeypatch, epochs, near):
    """The dual problem on a dense matrix, by projected gradient steps: the same objective and margins.

    The epochs of the query are enough for three percent on a hard problem, and more come closer.
    """
    monkeypatch.setattr(quality, "EPOCHS", epochs)
    rng = np.random.default_rng(2)
    y = np.where(rng.random(80) < 0.4, -1.0, 1.0)
    rows = [np.unique(np.concatenate((rng.integers(0, 60, 12), rng.integers(60, 75, 3) if v > 0 else rng.integers(70, 85, 3)))) for v in y]
    weights, _, bias = quality.descend(rows, y)
    ratio = quality.log_count_ratios(rows, y)
    x = np.zeros((len(rows), 86))
    for k, active in enumerate(rows):
        x[k, active] = ratio[active]
        x[k] /= np.linalg.norm(x[k])
    x[:, 85] = 1  # the bias
    signed = x * y[:, None]
    q = signed @ signed.T
    alpha, step = np.zeros(len(rows)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, quality.COST)
    best = signed.T @ alpha
    loss = lambda w: 0.5 * w @ w + quality.COST * np.maximum(0, 1 - signed @ w).sum()
    own = np.zeros(86)
    known = ratio[:85] != 0
    own[:85][known] = weights[:85][known] / ratio[:85][known]
    own[85] = bias
    assert loss(best) <= 1.0001 * loss(own) and loss(own) <= near * loss(best)
    assert np.corrcoef(x @ own, x @ best)[0, 1] > 0.995


def test_parts_of_a_long_text():
    """Cut before blanks only, whatever their kind; nothing is lost."""
    rng = random.Random(8)
    for most in (5, 12, 40):
        text = b"".join(rng.choice([b" ", b"\n", b"\x0b", b"a", b"bc", b"def" * 9]) for _ in range(400))
        got = list(parts(text, most))
        assert b"".join(got) == text and [w for p in got for w in p.split()] == text.split()
        assert max(map(len, got)) <= max(most, 27 * 8)
    assert list(parts(b"", 3)) == [b""] and list(parts(b"x" * 10, 3)) == [b"x" * 10, b""]
