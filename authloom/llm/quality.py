"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams (words, word pairs, and up to four consecutive word shapes) are hashed into a
fixed number of buckets, scaled by the log ratio of the classes' counts, and weighed by a linear
hinge-loss model that dual coordinate descent fits. A sigmoid fitted on the two halves' mutual
predictions turns margins into scores.

Features are made, and all texts scored, in parallel. Only the fit itself runs in one task, over at
most ``MAX_TRAIN`` labelled rows; the model has a fixed size and is broadcast.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store, bounded_batches, small_batches
from authloom.llm.words import mix, slices, text_bytes, word_hashes

BITS = 18
MAX_TRAIN = 16_384   # labelled rows that the fit sees at most, chosen by a hash of their id
COST = 1.0           # weight of the hinge loss
SMOOTH = 1.0         # added to every n-gram count
EPOCHS = 12
CUTOFF = 0.3         # least score of a document that is predicted good
FOLDS = 5            # rows whose hashed id is 0 modulo this are never learned from

_KIND = np.zeros(256, dtype=np.uint64)  # 0 sign, 1 lower, 2 upper, 3 digit, 4 other script
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 4
_LETTER = np.isin(_KIND, (1, 2))


def _shapes(data: np.ndarray, words: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kind of the first and last character, capitals, length class and repetition of every word."""
    upper = np.concatenate(([0], np.cumsum(_KIND[data] == 2)))
    letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
    n_upper, n_letters = upper[end] - upper[first], letters[end] - letters[first]
    last = data[end - 1].astype(np.uint64)
    tail = np.where(_KIND[data[end - 1]] == 0, last + np.uint64(8), _KIND[data[end - 1]])
    again = np.zeros(len(words), dtype=np.uint64)
    again[1:] += words[1:] == words[:-1]
    again[2:] += (words[2:] == words[:-2]).astype(np.uint64) * np.uint64(2)
    shouted = ((n_upper == n_letters) & (n_letters > 1)).astype(np.uint64)
    length = np.digitize(end - first, (2, 4, 9, 21)).astype(np.uint64)
    return (((_KIND[data[first]] * np.uint64(512) + tail) * np.uint64(4) + again) * np.uint64(2) + shouted) * np.uint64(8) + length


def features(column: pa.Array):
    """The sorted distinct buckets of every row's n-grams."""
    data, offsets = text_bytes(column)
    seen = np.zeros(1 << BITS, dtype=bool)
    shift = np.uint64(64 - BITS)
    for lo, hi in slices(offsets):
        part = data[offsets[lo]:offsets[hi]]
        words, first, end, rows = word_hashes(part, offsets[lo:hi + 1] - offsets[lo])
        grams = [(mix(words + np.uint64(1)) >> shift, 1)]
        if len(words):
            shape = _shapes(part, words, first, end)
            grams.append((mix(words[:-1] * np.uint64(3) + words[1:] + np.uint64(2)) >> shift, 2))
            run = np.zeros(len(words), dtype=np.uint64)
            for n in range(1, 5):
                m = len(words) - n + 1
                if m > 0:
                    run = mix(run[:m] * np.uint64(0x9E3779B97F4A7C15) + shape[n - 1:] + np.uint64(n))
                    grams.append((run >> shift, n))
        for k in range(hi - lo):
            a, b = rows[k], rows[k + 1]
            for value, n in grams:
                if b - a >= n:
                    seen[value[a:b - n + 1]] = True
            active = np.flatnonzero(seen).astype(np.uint32)
            seen[active] = False
            yield active


class Model:
    """Bucket weights, squared scales, bias and the sigmoid's two numbers."""

    def __init__(self, weight: np.ndarray, square: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weight, self.square, self.bias, self.slope, self.shift = weight, square, bias, slope, shift

    def margin(self, active: np.ndarray) -> float:
        length = float(self.square[active].sum())
        return float(self.weight[active].sum()) / np.sqrt(length) + self.bias if length > 0 else self.bias

    def score(self, active: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(active) + self.shift, -50, 50))))

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, weight=self.weight, square=self.square, rest=np.array([self.bias, self.slope, self.shift]))
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Model:
        z = np.load(io.BytesIO(data))
        return cls(z["weight"], z["square"], *z["rest"].tolist())


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per bucket, the log of its smoothed share among good rows over that among bad rows."""
    counts = [np.full(1 << BITS, SMOOTH), np.full(1 << BITS, SMOOTH)]
    for active, label in zip(rows, y, strict=True):
        counts[int(label > 0)][active] += 1
    return np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())


def descend(rows: list[np.ndarray], y: np.ndarray, seed: int = 17) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights per bucket (with the scale multiplied in), squared scales, and bias."""
    ratio = log_count_ratios(rows, y)
    values = []
    for active in rows:
        x = ratio[active]
        length = np.sqrt((x * x).sum())
        values.append((x / length if length > 0 else x).astype(np.float32))
    w, bias = np.zeros(1 << BITS, dtype=np.float32), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([float((v * v).sum()) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        moved = 0.0
        for i in order.permutation(len(rows)):
            active, x = rows[i], values[i]
            gradient = y[i] * (float(w[active] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), COST)
            step = (new - alpha[i]) * y[i]
            if step:
                w[active] += np.float32(step) * x
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return (w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias


def sigmoid(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that make margins probabilities (Newton steps on the smoothed targets)."""
    good, bad = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, float(np.log((good + 1) / (bad + 1)))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -50, 50)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin * margin).sum() + 1e-6, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """The model of rows of active buckets and their labels, +1 or -1."""
    flat = np.zeros(1 << BITS, dtype=np.float32)
    good = int((y > 0).sum())
    if good in (0, len(y)):
        # nothing to tell apart: every score is the share of good rows, a half without any
        share = min(max(good / len(y) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(flat, flat, 0.0, 1.0, float(np.log(share / (1 - share))))
    half = np.arange(len(y)) % 2
    margin = np.zeros(len(y))
    for side in (0, 1):
        train, test = np.flatnonzero(half != side), np.flatnonzero(half == side)
        if abs(y[train].sum()) == len(train):
            train = np.arange(len(y))
        part = Model(*descend([rows[i] for i in train], y[train]), 1.0, 0.0)
        margin[test] = [part.margin(rows[i]) for i in test]
    return Model(*descend(rows, y), *sigmoid(margin, y))


def held_out(id_col: str):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


@small_batches(1000)
def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Model:
    """Fit on labelled rows outside the held-out fold.

    Rows with a null label, and ids with both labels, are not learned from.
    """
    spark = docs.sparkSession
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("x"), F.max(label_col).alias("y"))
             .where("x = y").select("id", F.col("y").cast("int").alias("y"), F.xxhash64("id").alias("h")))
    usable = known.where(~held_out("id"))
    total = usable.count()
    share = min(1.0, 1.1 * MAX_TRAIN / max(total, 1))
    chosen = (usable.where(F.expr(f"pmod(h, 1000000) < {share} * 1000000"))
              .orderBy("h").limit(MAX_TRAIN))
    store = Store(spark, "quality")
    chosen = store.save(chosen.select("id", "y"), "chosen")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def extract(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array([f.tobytes() for f in features(batch.column(2))], pa.binary())], ["id", "y", "active"])

    # at most MAX_TRAIN rows of two numbers are broadcast
    kind = texts.schema[0].dataType.simpleString()
    made = (texts.join(F.broadcast(chosen), "id").select("id", "y", "text")
            .mapInArrow(extract, f"id {kind}, y int, active binary"))
    # a repeated id is learned from once
    made = store.save(made.dropDuplicates(["id"]).withColumn("h", F.xxhash64("id")), "features")

    def fit_one(batches):
        rows, y = [], []
        for batch in batches:
            rows += [np.frombuffer(x, dtype=np.uint32) for x in batch.column(1).to_pylist()]
            y += batch.column(0).to_pylist()
        model = fit(rows, np.where(np.array(y, dtype=np.int64) > 0, 1, -1))
        yield pa.RecordBatch.from_arrays([pa.array([model.to_bytes()], pa.binary())], ["model"])

    one = made.select("h", "y", "active").repartition(1).sortWithinPartitions("h").select("y", "active")
    fitted = store.save(one.mapInArrow(fit_one, "model binary"), "model").collect()
    model = Model.from_bytes(bytes(fitted[0]["model"])) if fitted else fit([], np.zeros(0))
    store.drop("features", "chosen")
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``held_out, score, predicted`` of every row of ``docs``, from its text alone.

    Null and empty texts have no n-grams; their score comes from the bias. Rows without id are
    scored as well and are not held out. Other columns are ignored, whatever their names.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())

    def run(batches):
        own = Model.from_bytes(held.value)
        for batch in batches:
            scores = [own.score(f) for f in features(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()),
                 pa.array([int(s >= CUTOFF) for s in scores], pa.int32())], [id_col, "held_out", "score", "predicted"])

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    return (docs.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col(text_col).cast("string"))
            .mapInArrow(run, f"`{id_col}` {kind}, held_out boolean, score double, predicted int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted good, with all their columns."""
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model.to_bytes())
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        own = Model.from_bytes(held.value)
        for batch in batches:
            good = [own.score(f) >= CUTOFF for f in features(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
