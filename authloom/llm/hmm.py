"""Hidden Markov language model: Baum-Welch counts per partition, exact likelihood by scaled forward recursion.

1. Words are counted over all training documents; the counts stay a table, however large.
2. A word with at least a stated share of all tokens (at most ``1 / OWN_SHARE`` words can have it) is an
   emission class of its own; other words share the class of their last bytes. A state emits classes,
   and a class its words in proportion to count + 1, one unknown word included. So the emission is

       P(word | state) = (count + 1) / (tokens + words + open classes) * lift(state, class),

   where the first factor needs the whole count table (one join of the rarer words) and the lift only
   a matrix of bounded size. Both are normalised: the probabilities of all words and the unknown ones
   of the open classes sum to one in every state.
3. Texts are written once as class numbers. A Baum-Welch round reads them where they lie: each task runs the
   scaled forward and backward recursions over its texts, adds up expected transitions and emissions, and
   returns one row per class; rows are summed per class, and only the summed matrix comes to the driver.
4. Long texts are cut in chunks. A chunk's product of transition and emission matrices carries the
   forward vector over it, so all chunks run at once, and the result is that of the whole text.

States begin as hashed disturbances of the word shares, the same in every run.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store, small_batches
from authloom.llm.words import mix, parts, slices, text_bytes

STATES = 8
ROUNDS = 5
OWN_SHARE = 2e-6   # of all training tokens: words with a class of their own
OWN_LEAST = 20     # and at least so many occurrences
SUFFIXES = 4096    # hashed word endings that other words share
SUFFIX_BYTES = 3
CHUNK = 2048       # tokens of a chunk
GROUP = 1 << 19    # tokens that are run at once
HELD = 500_000     # words that a task adds up before it emits them
STAY = 0.9         # first chance to stay in a state
RESCALE = 4        # steps after which vectors are scaled to one; lifts stay far from what floats hold till then
PRIOR = 10.0       # tokens of a class that are taken to be spread like all tokens
FLOOR = 0.01       # share of the mixture that every state emits alike
END = b""          # the end of a text; no word is empty


@dataclass
class Classes:
    """Which class a word has, and how much of the corpus each class is."""

    own: dict[bytes, int]     # class of the frequent words
    own_count: np.ndarray     # their counts, by class
    suffix: np.ndarray        # class of each hashed ending
    prior: np.ndarray         # share of each class
    tokens: int
    words: int
    open: int                 # classes that hold an unknown word


@dataclass
class Model:
    """First states, transitions, and how much more each class stands in a state than in all text."""

    first: np.ndarray
    move: np.ndarray
    lift: np.ndarray


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes know A-Z and the six blanks only


def _count(batches):
    """Words of texts and the ends of texts, added up in the task."""
    held: Counter[bytes] = Counter()

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.binary()), pa.array(np.fromiter(held.values(), dtype=np.int64, count=len(held)))],
            ["word", "n"])

    for rows in batches:
        data, offsets = text_bytes(rows.column(0))
        held[END] += rows.num_rows
        for lo, hi in slices(offsets):
            # a blank between texts: no word runs over
            for part in parts(b" ".join([data[offsets[k]:offsets[k + 1]].tobytes() for k in range(lo, hi)])):
                held.update(words_of(part))
            if len(held) > HELD:
                yield batch()
                held.clear()
    yield batch()


def classes_of(counts: DataFrame, share: float = OWN_SHARE, least: int = OWN_LEAST) -> Classes:
    """Classes of a count table ``word, n``; what is collected is bounded by the share and the endings."""
    total, words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    bound = max(least, int(np.ceil(share * total)))
    kept = counts.where((F.col("n") >= bound) | (F.length("word") == 0))
    own = sorted(zip(*(c.to_pylist() for c in kept.select("word", "n").toArrow().columns), strict=True), key=lambda x: (-x[1], x[0]))
    rare = counts.where((F.col("n") < bound) & (F.length("word") > 0))
    ending = F.expr(f"pmod(crc32(substring(word, greatest(octet_length(word) - {SUFFIX_BYTES - 1}, 1))), {SUFFIXES})")
    sums = rare.groupBy(ending.alias("k")).agg((F.sum("n") + F.count(F.lit(1))).alias("mass")).toArrow()
    at, mass = (np.asarray(sums.column(c).combine_chunks()).astype(np.int64) for c in ("k", "mass"))
    order = np.argsort(at)
    suffix = np.full(SUFFIXES, len(own) + len(at), dtype=np.int32)  # endings never met share the last class
    suffix[at[order]] = len(own) + np.arange(len(at))
    opened = len(at) + 1
    prior = np.concatenate((np.array([n + 1 for _, n in own], dtype=float), mass[order] + 1.0, [1.0])) / (total + words + opened)
    return Classes({w: k for k, (w, _) in enumerate(own)}, np.array([n for _, n in own], dtype=np.int64), suffix, prior / prior.sum(),
                   int(total), int(words), opened)


def _coded(classes):
    """Texts as class numbers, with what their frequent words add to the base score and the other words."""

    def run(batches):
        from pyspark import TaskContext

        known: Classes = classes.value
        get, suffix = known.own.get, known.suffix.tolist()
        log = np.log10(known.own_count + 1.0)
        row = TaskContext.get().partitionId() << 33
        for rows in batches:
            data, offsets = text_bytes(rows.column(2))
            n, own, own_log, codes, rare = [], [], [], [], []
            for k in range(rows.num_rows):
                coded, others, seen, seen_log = [], [], 0, 0.0
                for part in (*parts(data[offsets[k]:offsets[k + 1]].tobytes()), None):
                    words = [END] if part is None else words_of(part)
                    code = np.array([get(w, -1) for w in words], dtype=np.int32)
                    other = np.flatnonzero(code < 0)
                    frequent = code[code >= 0]
                    some = [words[i] for i in other.tolist()]
                    code[other] = [suffix[crc32(w[-SUFFIX_BYTES:]) % SUFFIXES] for w in some]
                    seen += len(frequent)
                    seen_log += float(log[frequent].sum())
                    coded.append(code)
                    others += some
                code = np.concatenate(coded)
                n.append(len(code))
                own.append(seen)
                own_log.append(seen_log)
                codes.append(code.astype("<u4").tobytes())
                rare.append(others)
            ids = np.arange(row, row + rows.num_rows)
            row += rows.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), rows.column(0), rows.column(1), pa.array(n, pa.int64()), pa.array(own, pa.int64()),
                 pa.array(own_log, pa.float64()), pa.array(codes, pa.binary()), pa.array(rare, pa.list_(pa.binary()))],
                ["row", "id", "held_out", "n_tokens", "own", "own_log", "codes", "rare"])

    return run


def first_model(classes: Classes, states: int) -> Model:
    """Sticky states whose class shares are disturbed by a hash."""
    n = len(classes.prior)
    key = np.arange(n, dtype=np.uint64)[:, None] * np.uint64(states) + np.arange(states, dtype=np.uint64)
    noise = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) >> np.uint64(40)
    lift = 0.2 + noise.astype(float) / (1 << 24)
    move = np.full((states, states), (1 - STAY) / max(states - 1, 1))
    np.fill_diagonal(move, STAY if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, lift / (classes.prior @ lift))


def chunks(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and length of every text's chunks in order, and the n + 1 chunk offsets of the texts."""
    count = -(-lengths // size)
    at = np.concatenate(([0], np.cumsum(count)))
    inner = np.arange(at[-1]) - np.repeat(at[:-1], count)
    begin = np.repeat(np.cumsum(lengths) - lengths, count) + inner * size
    return begin, np.minimum(size, np.repeat(lengths, count) - inner * size), at


def _groups(length: np.ndarray, which: np.ndarray, most: int):
    """Parts of ``which`` with at most ``most`` tokens (or one chunk), longest chunks first."""
    which = which[np.argsort(-length[which], kind="stable")]
    ends = np.cumsum(length[which])
    lo = 0
    while lo < len(which):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield which[lo:hi]
        lo = hi


def _steps(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks at work in each step, offsets of the steps, and the places of all tokens, step by step."""
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    off = np.concatenate(([0], np.cumsum(active)))
    rank = np.arange(off[-1]) - np.repeat(off[:-1], active)
    return active, off, begin[rank] + np.repeat(np.arange(length[0]), active)


class Recursion:
    """Scaled forward and backward recursions over many texts at once."""

    def __init__(self, model: Model, chunk: int = CHUNK, group: int = GROUP) -> None:
        self.first, self.move = model.first.astype(np.float32), model.move.astype(np.float32)
        self.lift, self.states = model.lift.astype(np.float32), len(model.first)
        self.chunk, self.group = chunk, group

    def _carry(self, codes, begin, length, at, backward):
        """Forward vector before, and backward vector after each chunk; only texts of several chunks need any."""
        k = self.states
        before = np.full((len(begin), k), 1 / k, dtype=np.float32)
        after = np.ones((len(begin), k), dtype=np.float32)
        several = np.flatnonzero(np.diff(at) > 1)
        if not len(several):
            return before, after
        first = np.zeros(len(begin), dtype=bool)
        first[at[:-1][np.diff(at) > 0]] = True
        which = np.concatenate([np.arange(at[d], at[d + 1]) for d in several])
        product = np.zeros((len(begin) if len(which) == len(begin) else len(which), k, k), dtype=np.float32)
        place = np.zeros(len(begin), dtype=np.int64)
        place[which] = np.arange(len(which))
        for part in _groups(length, which, self.group):
            active, off, where = _steps(begin[part], length[part])
            emit = self.lift[codes[where]]
            x = np.where(first[part][:, None, None], self.first, self.move) * emit[:active[0], None, :]
            for t in range(1, len(active)):
                m = active[t]
                y = (x[:m].reshape(-1, k) @ self.move).reshape(m, k, k)
                y *= emit[off[t]:off[t + 1], None, :]
                if t % RESCALE == 0:
                    y /= (y.reshape(m, k * k) @ np.ones(k * k, dtype=np.float32))[:, None, None]
                x[:m] = y
            product[place[part]] = x
        for d in several:
            lo, hi = int(at[d]), int(at[d + 1])
            for c in range(lo, hi - 1):
                v = before[c].astype(float) @ product[place[c]]
                before[c + 1] = v / v.sum()
            if backward:
                for c in range(hi - 1, lo, -1):
                    v = product[place[c]] @ after[c].astype(float)
                    after[c - 1] = v / v.sum()
        return before, after

    def run(self, codes: np.ndarray, lengths: np.ndarray, counts=None) -> np.ndarray:
        """Log10 of the lift of every text over the class shares; adds expected counts to ``counts`` if given.

        ``counts`` is (first, move, emitted); every text has a token.
        """
        begin, length, at = chunks(lengths, self.chunk)
        first = np.zeros(len(begin), dtype=bool)
        first[at[:-1]] = True
        before, after = self._carry(codes, begin, length, at, counts is not None)
        score = np.zeros(len(begin))
        ones = np.ones(self.states, dtype=np.float32)
        for part in _groups(length, np.arange(len(begin)), self.group):
            active, off, where = _steps(begin[part], length[part])
            some = codes[where]
            emit = self.lift[some]
            ahead = np.empty_like(emit)
            scale = np.ones(len(emit), dtype=np.float32)
            bounds = off.tolist()
            for t, m in enumerate(active.tolist()):
                here = ahead[bounds[t]:bounds[t + 1]]
                if t:
                    np.matmul(x[:m], self.move, out=here)
                else:
                    here[:] = np.where(first[part][:, None], self.first, before[part] @ self.move)
                here *= emit[bounds[t]:bounds[t + 1]]
                if t % RESCALE == 0:
                    s = here @ ones
                    here /= s[:, None]
                    scale[bounds[t]:bounds[t + 1]] = s
                x = here
            rank = np.arange(bounds[-1]) - np.repeat(off[:-1], active)
            last = ahead[off[length[part] - 1] + np.arange(len(part))] @ ones
            score[part] = np.bincount(rank, weights=np.log10(scale, dtype=np.float64), minlength=len(part)) + np.log10(last, dtype=np.float64)
            if counts is not None:
                self._expect(counts, first[part], before[part], after[part], off, rank, some, emit, ahead, scale)
        return np.add.reduceat(score, at[:-1]) if len(lengths) else score

    def _expect(self, counts, first, before, after, off, rank, some, emit, ahead, scale):
        """Backward recursion over one group, with expected counts."""
        firsts, moved, emitted = counts
        ones, turned = np.ones(self.states, dtype=np.float32), np.ascontiguousarray(self.move.T)
        back, late = np.empty_like(ahead), np.empty_like(ahead)
        bounds = off.tolist()
        now = after.copy()  # backward vectors of the chunks at work; a chunk's first is what comes after it
        for t in range(len(bounds) - 2, -1, -1):
            lo, hi = bounds[t], bounds[t + 1]
            back[lo:hi] = now[:hi - lo]
            np.multiply(emit[lo:hi], now[:hi - lo], out=late[lo:hi])
            if t:
                v = late[lo:hi] @ turned
                if t % RESCALE == 0:
                    v /= (v @ ones)[:, None]
                now[:hi - lo] = v
        back *= ahead
        total = back @ ones
        back /= total[:, None]  # chances of the states of every token
        late /= (scale * total)[:, None]
        if len(bounds) > 2:
            width = np.diff(off)
            before_it = np.arange(bounds[1], bounds[-1]) - np.repeat(width[:-1], width[1:])
            moves = ahead[before_it].T @ late[bounds[1]:]
        else:
            moves = np.zeros((self.states, self.states))
        some_before = ~first
        moves = moves + before[some_before].T @ late[:bounds[1]][some_before]
        moved += moves * self.move
        firsts += back[:bounds[1]][first].sum(axis=0)
        for k in range(self.states):
            emitted[:, k] += np.bincount(some, weights=back[:, k], minlength=len(emitted))


def _texts(batches, at: int, most: int = 2 * GROUP):
    """Batches with their texts' class numbers, so many batches at a time as hold about ``most`` tokens."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.column(at).nbytes // 4
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _flat(held, at: int) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(v.as_buffer(), dtype="<u4") for b in held for v in b.column(at)]
    return np.concatenate(parts).astype(np.int64), np.array([len(p) for p in parts], dtype=np.int64)


def _expected(model, classes: int):
    """Expected counts of a task's texts: a row per class, and rows -1 and -2 - k for first states and moves."""

    def run(batches):
        recursion = Recursion(model.value)
        k = recursion.states
        counts = (np.zeros(k), np.zeros((k, k)), np.zeros((classes, k)))
        for held in _texts(batches, 0):
            recursion.run(*_flat(held, 0), counts)
        met = np.flatnonzero(counts[2].any(axis=1))
        key = np.concatenate((met, [-1], -2 - np.arange(k)))
        rows = np.vstack((counts[2][met], counts[0], counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *[pa.array(rows[:, s]) for s in range(k)]],
                                         ["key", *[f"s{s}" for s in range(k)]])

    return run


def improved(rows: pa.Table, classes: Classes, states: int) -> Model:
    """The model of summed expected counts."""
    key = np.asarray(rows.column("key").combine_chunks()).astype(np.int64)
    value = np.stack([np.asarray(rows.column(f"s{s}").combine_chunks()) for s in range(states)], axis=1)
    table = np.zeros((len(classes.prior) + 1 + states, states))
    table[key] = value  # negative keys stand at the end
    emitted, move, first = table[:len(classes.prior)], table[-2:-2 - states:-1], table[-1]
    share = (emitted.sum(axis=0) + 1) / (emitted.sum() + states)
    lift = (emitted / share + PRIOR) / (emitted.sum(axis=1, keepdims=True) + PRIOR)
    lift = (1 - FLOOR) * lift / (classes.prior @ lift) + FLOOR
    return Model((first + 1) / (first.sum() + states), (move + 1) / (move.sum(axis=1, keepdims=True) + states), lift)


def train(coded: DataFrame, classes: Classes, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch rounds over the rows of ``coded`` that are not held out."""
    spark = coded.sparkSession
    model, n = first_model(classes, states), len(classes.prior)
    names = [f"s{s}" for s in range(states)]
    schema = "key int, " + ", ".join(f"{c} double" for c in names)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        rows = (coded.where("NOT held_out").select("codes").mapInArrow(_expected(shared, n), schema)
                .groupBy("key").agg(*[F.sum(c).alias(c) for c in names])).toArrow()
        shared.unpersist()
        model = improved(rows, classes, states)
    return model


def _scored(model):
    """Log10 lift of every text."""

    def run(batches):
        recursion = Recursion(model.value)
        for held in _texts(batches, 1):
            lift = recursion.run(*_flat(held, 1))
            at = 0
            for b in held:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lift[at:at + b.num_rows])], ["row", "lift"])
                at += b.num_rows

    return run


@small_batches(1000)
def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES,
                    rounds: int = ROUNDS, share: float = OWN_SHARE, least: int = OWN_LEAST) -> DataFrame:
    """``id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``.

    Rows whose crc32(id as text) mod 7 is 2 are held out; a null id counts as ''. Null and empty texts are
    their end alone. Repeated rows are texts of their own; other columns are ignored; an empty table gives
    an empty result. Without training rows every word is unknown.
    """
    spark = docs.sparkSession
    store = Store(spark, "hmm")
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 7 == 2
    rows = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    counts = store.save(rows.where("NOT held_out").select("text").mapInArrow(_count, "word binary, n long")
                        .groupBy("word").agg(F.sum("n").alias("n")).where("n > 0"), "counts")
    classes = classes_of(counts, share, least)
    kind = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(classes)
    coded = store.save(rows.mapInArrow(_coded(shared), f"""row long, id {kind}, held_out boolean, n_tokens long, own long,
                       own_log double, codes binary, rare array<binary>"""), "coded", compression="zstd")
    shared.unpersist()
    model = spark.sparkContext.broadcast(train(coded, classes, states, rounds))
    lifts = store.save(coded.select("row", "codes").mapInArrow(_scored(model), "row long, lift double"), "lifts")
    rare = (coded.select("row", F.explode("rare").alias("word")).join(counts, "word")
            .groupBy("row").agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("n") + 1)).alias("log")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    both = coded.select("row", "id", "held_out", "n_tokens", "own", "own_log").join(lifts, "row").join(rare, "row", "left")
    known = F.col("own_log") + zero("log")
    size = classes.tokens + classes.words
    return both.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("own") + zero("known")).alias("n_known"),
        F.lit(classes.tokens).cast("long").alias("train_tokens"),
        (known - F.col("n_tokens") * float(np.log10(size + 1))).alias("base_score"),
        (known - F.col("n_tokens") * float(np.log10(size + classes.open)) + F.col("lift")).alias("score"))
