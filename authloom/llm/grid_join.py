"""Near-duplicate embeddings by an epsilon grid order join.

Two unit vectors of cosine c are sqrt(2 - 2c) apart. Vectors are rotated onto their principal axes and
sorted by the grid cells (one epsilon wide) of the leading axes; the sorted sequence is cut into
blocks. Intervals of blocks are joined from the whole sequence down; intervals, and in the end blocks,
whose bounding boxes are further apart than epsilon in the leading axes are skipped. A pair of blocks is joined by recursion on intervals of the two sequences, again skipping
intervals whose boxes (in all axes) are too far apart; what is left is compared by the cosine of the
vectors as they are, in double precision. Rotation and grid only decide what is skipped.

Equal vectors are one class with a weight. A pair of blocks returns sums per vector and a spanning
set of links, never the pairs themselves, so a large group of near copies costs no large output.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.components import components
from authloom.llm.store import Store, bounded_batches, small_batches

AXES = 6        # leading axes of the grid
BLOCK = 4096    # vectors of a block
LEAF = 256      # vectors of an interval that is compared as a whole
PARTNERS = 32   # blocks that one group of a block's partners holds
BITS = 4        # halvings of an interval of blocks from one level to the next
SAFE = 1e-7     # added to epsilon against rounding of the rotation

BLOCKS = "block long, dim int, ids binary, weights binary, vectors binary, low array<double>, high array<double>"


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaling first keeps squares of very large and very small components finite
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch, at: int):
    """Row numbers and vectors of a batch, per number of components."""
    sizes = np.asarray(batch.column(at).value_lengths())
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        yield int(dim), rows, _vectors(batch.column(at).take(pa.array(rows)), int(dim))


def _moments(batches):
    """Sums of products of components of unit vectors."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for dim, _, x in _by_dim(batch, 0):
            u = _unit(x)
            sums[dim] = sums.get(dim, 0) + u.T @ u
    for dim, m in sums.items():
        i, j = np.divmod(np.arange(dim * dim), dim)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(dim * dim, dim, dtype=np.int32)), pa.array(i.astype(np.int32)),
             pa.array(j.astype(np.int32)), pa.array(m.ravel())], ["dim", "i", "j", "s"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Per number of components, the rotation whose leading columns hold most of the sum of squares."""
    rows = (vectors.select("x").mapInArrow(_moments, "dim int, i int, j int, s double")
            .groupBy("dim", "i", "j").agg(F.sum("s").alias("s")).collect())  # dim * dim numbers
    out: dict[int, np.ndarray] = {}
    for dim in {r["dim"] for r in rows}:
        m = np.zeros((dim, dim))
        for r in rows:
            if r["dim"] == dim:
                m[r["i"], r["j"]] = r["s"]
        _, axes = np.linalg.eigh((m + m.T) / 2)
        out[dim] = np.ascontiguousarray(axes[:, ::-1])
    return out


def _cells(axes, eps: float):
    def run(batches):
        for batch in batches:
            cells = np.zeros((batch.num_rows, AXES), dtype=np.int32)
            dims = np.zeros(batch.num_rows, dtype=np.int32)
            for dim, rows, x in _by_dim(batch, 2):
                lead = _unit(x) @ axes.value[dim][:, :AXES]
                cells[rows, :lead.shape[1]] = np.floor(lead / eps)
                dims[rows] = dim
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(dims), *[pa.array(cells[:, k]) for k in range(AXES)]],
                ["id", "w", "x", "dim", *[f"c{k}" for k in range(AXES)]])

    return run


def _pack(axes, most: int):
    """Consecutive vectors of a sorted partition as blocks of one row."""

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # (ids, weights, vectors) of one dimension

        def full(dim):
            nonlocal number, held
            ids, w, x = (np.concatenate([h[k] for h in held]) for k in range(3))
            lead = _unit(x) @ axes.value[dim][:, :AXES]
            lead = np.pad(lead, ((0, 0), (0, AXES - lead.shape[1])))
            number += 1
            held = []
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([dim], pa.int32()),
                 *[pa.array([v.tobytes()], pa.binary()) for v in (ids, w, x)],
                 *[pa.array([v.tolist()], pa.list_(pa.float64())) for v in (lead.min(axis=0), lead.max(axis=0))]],
                ["block", "dim", "ids", "weights", "vectors", "low", "high"])

        now, size = None, 0
        for batch in batches:
            for dim, rows, x in _by_dim(batch, 2):
                if now is not None and dim != now and held:
                    yield full(now)
                    size = 0
                now = dim
                ids, w = np.asarray(batch.column(0))[rows], np.asarray(batch.column(1))[rows]
                lo = 0
                while lo < len(rows):
                    hi = min(len(rows), lo + most - size)
                    held.append((ids[lo:hi], w[lo:hi], x[lo:hi]))
                    size += hi - lo
                    lo = hi
                    if size == most:
                        yield full(dim)
                        size = 0
        if held:
            yield full(now)

    return run


class _Sequence:
    """A block: vectors, unit vectors' boxes per leaf, and sums."""

    def __init__(self, ids: bytes, weights: bytes, vectors: bytes, axes: np.ndarray, leaf: int) -> None:
        dim, self.leaf = len(axes), leaf
        self.ids, self.weights = np.frombuffer(ids, dtype=np.int64), np.frombuffer(weights, dtype=np.int64)
        self.x = np.frombuffer(vectors, dtype=np.float64).reshape(-1, dim)
        # powers of two change no digit of a cosine and keep products finite
        self.x = np.ldexp(self.x, -np.frexp(np.abs(self.x).max(axis=1, keepdims=True))[1])
        self.norm = np.sqrt((self.x * self.x).sum(axis=1))
        y = (self.x / self.norm[:, None]) @ axes
        starts = np.arange(0, len(y), leaf)
        self.low, self.high = np.minimum.reduceat(y, starts), np.maximum.reduceat(y, starts)
        self.degree = np.zeros(len(y), dtype=np.int64)

    def leaves(self) -> int:
        return len(self.low)


def _lowest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per node the smallest node it is connected with by the links a - b."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, a, least)
        np.minimum.at(now, b, least)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def join_intervals(p: _Sequence, q: _Sequence, same: bool, cosine: float, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Add the pair's links to the sums of both; returns links that connect what they connect."""
    a_out, b_out = [], []
    stack = [(0, p.leaves(), 0, q.leaves())]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        if same and b1 <= a0:
            continue  # the mirror image is done elsewhere
        gap = np.maximum(0, np.maximum(p.low[a0:a1].min(axis=0) - q.high[b0:b1].max(axis=0),
                                       q.low[b0:b1].min(axis=0) - p.high[a0:a1].max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 > 1 or b1 - b0 > 1:
            if a1 - a0 >= b1 - b0:
                m = (a0 + a1) // 2
                stack += [(a0, m, b0, b1), (m, a1, b0, b1)]
            else:
                m = (b0 + b1) // 2
                stack += [(a0, a1, b0, m), (a0, a1, m, b1)]
            continue
        i, j = slice(a0 * p.leaf, (a0 + 1) * p.leaf), slice(b0 * q.leaf, (b0 + 1) * q.leaf)
        near = (p.x[i] @ q.x[j].T) / (p.norm[i][:, None] * q.norm[j][None, :]) >= cosine
        if same and a0 == b0:
            near = np.triu(near, 1)
        elif same and b0 < a0:
            continue
        r, c = np.nonzero(near)
        if not len(r):
            continue
        p.degree[i] += near @ q.weights[j]
        q.degree[j] += near.T @ p.weights[i]
        # one leaf's links as one tree per component
        n = len(near)
        label = _lowest(n + near.shape[1], r, c + n)
        node = np.flatnonzero(label != np.arange(len(label)))
        place = lambda v: np.where(v < n, v + i.start, v - n + j.start + (0 if same else len(p.ids)))  # noqa: B023, E731
        a_out.append(place(node))
        b_out.append(place(label[node]))
    if not a_out:
        none = np.zeros(0, dtype=np.int64)
        return none, none
    ids = p.ids if same else np.concatenate((p.ids, q.ids))
    label = _lowest(len(ids), np.concatenate(a_out), np.concatenate(b_out))
    node = np.flatnonzero(label != np.arange(len(label)))
    return ids[node], ids[label[node]]


def _join(axes, cosine: float, eps: float, leaf: int):
    """Groups of a block (role 0, first) and its partners (role 1): sums (b null) and links."""

    def run(batches):
        own = None
        for batch in batches:
            for k in range(batch.num_rows):
                role, dim, ids, w, x = (batch.column(c)[k].as_py() for c in range(2, 7))
                other = _Sequence(ids, w, x, axes.value[dim], leaf)
                if role == 0:
                    own = other
                    continue
                same = len(own.ids) == len(other.ids) and (own.ids == other.ids).all()
                own.degree[:] = 0
                if same:
                    other = own
                a, b = join_intervals(own, other, bool(same), cosine, eps)
                parts = [own] if same else [own, other]
                node = np.concatenate([s.ids[s.degree > 0] for s in parts])
                total = np.concatenate([s.degree[s.degree > 0] for s in parts])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((node, a))),
                     pa.array([None] * len(node) + b.tolist(), pa.int64()),
                     pa.array(np.concatenate((total, np.zeros(len(a), dtype=np.int64))))], ["a", "b", "n"])

    return run


def _box(boxes: DataFrame, shift: int) -> DataFrame:
    """Boxes of the intervals of blocks whose numbers agree but for the last ``shift`` bits."""
    least = [F.min(F.col("low")[k]) for k in range(AXES)]
    most = [F.max(F.col("high")[k]) for k in range(AXES)]
    return boxes.groupBy("dim", F.shiftright("block", shift).alias("node")).agg(
        F.array(*least).alias("low"), F.array(*most).alias("high"))


def close_blocks(boxes: DataFrame, eps: float, bits: int = BITS) -> DataFrame:
    """``block, other``: pairs of blocks (``block, dim, low, high``) whose boxes are within ``eps`` of each other, once.

    The sequence of blocks is halved into intervals ``bits`` times a level. From the whole sequence down, only
    intervals whose boxes are near are joined by their parts, so the work follows the number of near
    intervals and not the square of the blocks, and no key holds more than an interval's parts.
    """
    part, number = boxes.agg(F.max(F.shiftright("block", 32)), F.max(F.col("block").bitwiseAND((1 << 32) - 1))).first()
    if part is None:
        return boxes.select("block", F.col("block").alias("other"))
    # block numbers count up in the low half, partitions in the high one
    shifts = [*range(0, int(number).bit_length(), bits), *range(32, 32 + int(part).bit_length(), bits), 62]
    gap = F.aggregate(
        F.zip_with(F.zip_with("low", "high2", lambda a, b: a - b), F.zip_with("low2", "high", lambda a, b: a - b),
                   lambda a, b: F.greatest(a, b, F.lit(0.0))),
        F.lit(0.0), lambda s, g: s + g * g)
    near = _box(boxes, 62).select("dim", F.col("node").alias("up"), F.col("node").alias("up2"))
    for above, shift in zip(shifts[:0:-1], shifts[-2::-1], strict=True):
        kids = _box(boxes, shift).withColumn("up", F.shiftright("node", above - shift))
        other = kids.select("dim", *[F.col(c).alias(f"{c}2") for c in ("up", "node", "low", "high")])
        near = (near.join(kids, ["dim", "up"]).join(other, ["dim", "up2"]).where("node <= node2").where(gap <= eps * eps)
                .select("dim", F.col("node").alias("up"), F.col("node2").alias("up2")))
    return near.select(F.col("up").alias("block"), F.col("up2").alias("other"))


@small_batches(1000)
def near_embeddings(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
                    block: int = BLOCK, leaf: int = LEAF, partners: int = PARTNERS) -> DataFrame:
    """One row per row of ``vectors``: its id, ``n_links, component_id, kept``.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without id
    have no links; vectors of different lengths are not compared. Repeated rows count as further
    vectors. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    store = Store(spark, "grid")
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SAFE
    every = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    valid = every.where(
        F.col("id").isNotNull() & F.exists("x", lambda v: v != 0)
        & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    classes = store.save(valid.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
                         .select("id", "w", "x"), "classes")
    axes = spark.sparkContext.broadcast(principal_axes(classes))

    grid = ["dim", *[f"c{k}" for k in range(AXES)]]
    celled = classes.mapInArrow(_cells(axes, eps), "id long, w long, x array<double>, "
                                + ", ".join(f"{c} int" for c in grid))
    blocks = store.save(celled.repartitionByRange(*grid, "id").sortWithinPartitions(*grid, "id")
                        .mapInArrow(_pack(axes, block), BLOCKS), "blocks")

    pairs = close_blocks(store.save(blocks.select("block", "dim", "low", "high"), "boxes"), eps)
    # every other pair the other way round, so that partners are spread evenly
    swap = F.pmod(F.xxhash64("block", "other"), F.lit(2)) == 1
    pairs = pairs.select(F.when(swap, F.col("other")).otherwise(F.col("block")).alias("block"),
                         F.when(swap, F.col("block")).otherwise(F.col("other")).alias("other"))
    groups = F.ceil(F.col("n") / partners)
    pairs = store.save(
        pairs.join(pairs.groupBy("block").agg(F.count(F.lit(1)).alias("n")), "block")
        .withColumn("part", F.pmod(F.xxhash64("other"), groups)).select("block", "part", "other"), "pairs")
    payload = ["dim", "ids", "weights", "vectors"]
    own = pairs.select("block", "part").distinct().join(blocks, "block").select("block", "part", F.lit(0).alias("role"), *payload)
    partner = (pairs.join(blocks.withColumnRenamed("block", "other"), "other")
               .select("block", "part", F.lit(1).alias("role"), *payload))
    bounded_batches(spark, 8)  # a row is a whole block
    joined = store.save(
        own.unionByName(partner).repartition("block", "part").sortWithinPartitions("block", "part", "role")
        .mapInArrow(_join(axes, cosine, eps, leaf), "a long, b long, n long"), "joined")

    degree = joined.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(joined.where("b IS NOT NULL").select("a", "b"), store, "parts")
    store.drop("blocks")
    copies = classes.where("w > 1").select(F.xxhash64("x").alias("h"), "x", F.col("id").alias("class_id"), "w")
    rows = valid.select("id", F.xxhash64("x").alias("h"), "x").join(copies, ["h", "x"]).select("id", "class_id", "w")
    rows = rows.groupBy("id").agg(F.min("class_id").alias("class_id"), F.max("w").alias("w"))
    single = valid.select("id").distinct()
    linked = (single.join(rows, "id", "left").withColumn("node", F.coalesce("class_id", "id"))
              .join(degree, "node", "left").join(parts.withColumnRenamed("id", "node"), "node", "left")
              .select("id", (F.coalesce("w", F.lit(1)) - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
                      F.coalesce("component", "node").alias("component_id")))
    out = every.select("id", F.coalesce(F.exists("x", lambda v: v != 0), F.lit(False)).alias("some"))
    return (out.join(linked, "id", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
