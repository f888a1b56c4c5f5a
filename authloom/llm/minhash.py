"""MinHash near-duplicate detection with an LSH forest.

1. Every document gets a signature of 256 minima over its five-word shingles. Documents with equal
   sets collapse into one representative.
2. The forest is 24 orders of the signatures: tree t sorts them from value 10t on, cyclically. A region
   of a tree is the set of representatives that agree in the first four values there; regions of one
   are dropped after a count of small rows. Two sets of similarity 0.85 share a region of some tree
   but for a chance of 2e-8.
3. Each tree is sorted inside its regions by the remaining values. The sorted region is cut into
   blocks at the positions where the common prefix is shortest, so that the depth at which
   documents are compared follows the density of the region. In a block, candidates are neighbours
   in the order (longest common prefix) and the block's hub: the member next to the block's most
   frequent values. In a region of several blocks every member is also compared with the hubs of all
   blocks, which finds the centre of a large group of near copies.
4. Candidates are confirmed on the full shingle sets, in two rounds: the best candidate of each
   document, then other candidates between what is still apart. Pairs inside one component need no look,
   which keeps the work of large groups linear.
5. Regions that hold several components even then are searched exactly, whatever their width. Shingles are
   put in an order with rare ones first. Two sets that reach the threshold share one of the first
   n - ceil(tn) + 1 shingles of the larger and n - ceil(2tn / (1 + t)) + 1 of the smaller set, so documents
   meet under these shingles only, and what documents of one template have in common stands at the end
   of the order. A shingle that many documents have is split in tiles. What the places of the shared
   shingle and the sizes allow is confirmed on the full sets like the other candidates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.components import components, joined
from authloom.llm.store import Store, small_batches
from authloom.llm.words import mix, shingle_sets

VALUES = 256   # signature length
TREES = 24
STRIDE = 10    # tree t begins at value 10t
DEPTH = 4      # values that a region shares
BLOCK = 512    # documents of a block
SLACK = 4.5    # standard deviations below the threshold at which a candidate is still confirmed
PART = 1024    # members of a wide region that are compared with its hubs at a time
HUBS = 1024    # hubs of a region that are held at a time
TILE = 512     # documents of one side of a tile under one shingle
MEET = 1 << 21  # comparisons under shingles that are made at once
BUCKETS = 1 << 18  # of the counts that put shingles in order

_FACTORS = mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ORDER = np.array([(STRIDE * t + np.arange(VALUES)) % VALUES for t in range(TREES)])


def signature(values: np.ndarray) -> np.ndarray:
    """The least high half of each factor's products over a set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for lo in range(0, len(values), 2048):
        np.minimum(least, (values[lo:lo + 2048, None] * _FACTORS).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def region_keys(sig: np.ndarray) -> np.ndarray:
    """Key of the region of each tree."""
    value = np.arange(1, TREES + 1, dtype=np.uint64)
    for k in range(DEPTH):
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + sig[_ORDER[:, k]].astype(np.uint64))
    return value


def _sign(batches):
    """Set size and digest, and of non-empty sets the region keys and the low bytes of the signature."""
    for batch in batches:
        sizes, digests, keys, sketches = [], [], [], []
        for values in shingle_sets(batch.column(1)):
            sizes.append(len(values))
            digests.append(hashlib.blake2b(values.tobytes(), digest_size=16).digest())
            sig = signature(values) if len(values) else None
            keys.append(None if sig is None else region_keys(sig).tobytes())
            sketches.append(None if sig is None else sig.astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), *[pa.array(c, pa.binary()) for c in (digests, keys, sketches)]],
            ["id", "n_shingles", "digest", "keys", "sketch"])


def _matrix(column: pa.Array, width: int, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), width)


def _regions(batches):
    """Region key of every representative in every tree."""
    for batch in batches:
        key = _matrix(batch.column(1), TREES, np.int64)
        ids = np.repeat(np.asarray(batch.column(0)), TREES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel()), pa.array(ids, pa.int64()),
             pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(key)))], ["key", "id", "tree"])


def _sketch(batches):
    """Rows of regions with the low bytes of their signature in the order of their tree."""
    for batch in batches:
        key, node, tree, n, sketch = (batch.column(k) for k in range(5))
        low = np.take_along_axis(_matrix(sketch, VALUES, np.uint8), _ORDER[np.asarray(tree)], axis=1)
        yield pa.RecordBatch.from_arrays(
            [key, node, n, pa.array([r.tobytes() for r in low], pa.binary())], ["key", "id", "n", "sketch"])


def least_matches(threshold: float, slack: float = SLACK) -> int:
    """Equal values of a signature that a pair of the threshold's similarity has but for ``slack`` deviations."""
    return int(np.floor(VALUES * threshold - slack * np.sqrt(VALUES * threshold * (1 - threshold))))


def _hub(rows: np.ndarray) -> tuple[int, int]:
    """The row that agrees most with the most frequent value of each column, and in how many."""
    ordered = np.sort(rows, axis=0)
    n = len(rows)
    # the longest run of equal values in each column
    change = np.vstack([np.ones((1, rows.shape[1]), dtype=bool), ordered[1:] != ordered[:-1]])
    run = np.arange(n)[:, None] - np.maximum.accumulate(np.where(change, np.arange(n)[:, None], 0), axis=0)
    best = ordered[run.argmax(axis=0), np.arange(rows.shape[1])]
    agree = (rows == best).sum(axis=1)
    k = int(agree.argmax())
    return k, int(agree[k])


def _cuts(rows: np.ndarray, most: int) -> list[int]:
    """Ends of blocks of a sorted region: at the shortest common prefix in the later half of each block."""
    n, lo, out = len(rows), 0, []
    common = np.concatenate(([0], (np.cumprod(rows[1:] == rows[:-1], axis=1)).sum(axis=1)))
    while n - lo > most:
        half = lo + most // 2
        lo = half + int(common[half:lo + most].argmin())
        out.append(lo)
    return [*out, n]


def _runs(batches, most: int):
    """Consecutive rows of one region, whole or at most several blocks of it at a time.

    Yields key, ids, further long columns and sketches. Rows arrive sorted by key and sketch.
    """
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = [np.asarray(c) for c in batch.columns[:-1]] + [_matrix(batch.columns[-1], VALUES, np.uint8)]
        if held is not None:
            table = [np.concatenate(x) for x in zip(held, table, strict=True)]
        key = table[0]
        cut = np.flatnonzero(key[1:] != key[:-1]) + 1
        last = int(cut[-1]) if len(cut) else 0
        if len(key) - last >= 8 * most:  # a region far longer than a block goes on in pieces
            last = len(key)
        bounds = [0, *[int(c) for c in cut if c < last], last]
        for lo, hi in zip(bounds, bounds[1:], strict=False):
            if hi > lo:
                yield [x[lo:hi] for x in table]
        held = [x[last:] for x in table]
    if held is not None and len(held[0]):
        key = held[0]
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(cut, cut[1:], strict=False):
            yield [x[lo:hi] for x in held]


EDGES = "kind int, key long, a long, b long, matches int, sketch binary"


class _Edges:
    """Rows of the candidate table, emitted in batches."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, kind: int, key: int, a: np.ndarray, b: np.ndarray, matches: np.ndarray, sketch=None) -> None:
        if len(a):
            self.parts.append((kind, key, a, b, matches, sketch))
            self.size += len(a)

    def batch(self) -> pa.RecordBatch:
        n = [len(p[2]) for p in self.parts]
        col = lambda k: np.concatenate([p[k] for p in self.parts]) if self.parts else np.zeros(0)
        sketches = [s for p in self.parts for s in ([p[5]] if p[5] is not None else [None] * len(p[2]))]
        out = pa.RecordBatch.from_arrays([
            pa.array(np.repeat([p[0] for p in self.parts], n).astype(np.int32), pa.int32()),
            pa.array(np.repeat([p[1] for p in self.parts], n).astype(np.int64), pa.int64()),
            pa.array(col(2).astype(np.int64)), pa.array(col(3).astype(np.int64)), pa.array(col(4).astype(np.int32)),
            pa.array(sketches, pa.binary())], ["kind", "key", "a", "b", "matches", "sketch"])
        self.__init__()
        return out


def _neighbours(least: int, most: int):
    """Candidates of sorted regions (kind 0), and the hubs of blocks of larger ones (kind 1)."""

    def run(batches):
        out = _Edges()
        for key, ids, n, rows in _runs(batches, most):
            wide = bool(n[0] > most)
            lo = 0
            for hi in _cuts(rows, most):
                block, own = rows[lo:hi], ids[lo:hi]
                for gap in (1, 2):
                    if len(own) > gap:
                        same = (block[gap:] == block[:-gap]).sum(axis=1)
                        hit = (same >= least) & (own[gap:] != own[:-gap])
                        out.add(0, int(key[0]), own[gap:][hit], own[:-gap][hit], same[hit])
                if len(own) > 3 or wide:
                    k, _ = _hub(block)
                    same = (block == block[k]).sum(axis=1)
                    hit = (same >= least) & (own != own[k])
                    out.add(0, int(key[0]), own[hit], np.full(int(hit.sum()), own[k]), same[hit])
                    if wide:
                        out.add(1, int(key[0]), own[k:k + 1], own[k:k + 1], np.zeros(1), block[k].tobytes())
                lo = hi
            if lo < len(ids):
                raise AssertionError("a block was left out")
            if out.size >= 20_000:
                yield out.batch()
        yield out.batch()

    return run


def _with_hubs(least: int):
    """Members of large regions against their hubs: each one's best hub of the part and group it stands in.

    Rows arrive sorted by key, part and group, hubs (kind 0) before members.
    """

    def run(batches):
        last, hubs, rows = None, [], None
        for batch in batches:
            where = list(zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True))
            kind, ids = np.asarray(batch.column(3)), np.asarray(batch.column(4))
            low = _matrix(batch.column(5), VALUES, np.uint8)
            a, b, m = [], [], []
            for k, at in enumerate(where):
                if at != last:
                    last, hubs, rows = at, [], None
                if kind[k] == 0:
                    hubs.append((ids[k], low[k]))
                    continue
                if not hubs:
                    continue
                if rows is None:
                    names, rows = np.array([h for h, _ in hubs]), np.array([r for _, r in hubs])
                same = (rows == low[k]).sum(axis=1)
                same[names == ids[k]] = -1
                best = int(same.argmax())
                if same[best] >= least:
                    a.append(ids[k])
                    b.append(names[best])
                    m.append(int(same[best]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int32())],
                                             ["a", "b", "matches"])

    return run


def _wide(forest: DataFrame, hubs: DataFrame, block: int, part: int = PART, group: int = HUBS) -> DataFrame:
    """``key, part, group, kind, id, sketch``: members of wide regions dealt into parts, hubs into groups."""
    size = hubs.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / group).cast("int").alias("groups"))
    parts = F.ceil(F.col("n") / part).cast("int")
    members = forest.where(F.col("n") > block).withColumn("parts", parts)
    each = members.groupBy("key").agg(F.max("parts").alias("parts")).join(size, "key")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = members.select("key", "id", "sketch").join(each, "key").select(
        "key", deal("parts").alias("part"), every("groups").alias("group"), F.lit(1).alias("kind"), "id", "sketch")
    other = hubs.join(each, "key").select(
        "key", every("parts").alias("part"), deal("groups").alias("group"), F.lit(0).alias("kind"), "id", "sketch")
    place = ["key", "part", "group"]
    return own.unionByName(other).repartition(*place).sortWithinPartitions(*place, "kind")


def _weigh(batches):
    """How many sets have the shingles of each bucket."""
    count = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for item in batch.column(0):
            np.add.at(count, (np.frombuffer(item.as_buffer(), dtype=np.uint64) % np.uint64(BUCKETS)).astype(np.int64), 1)
    met = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(count[met])], ["bucket", "n"])


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """How many first shingles of a set of ``n`` meet every partner's, as the larger and as the smaller set."""
    return n + percent * n // -100 + 1, n + 2 * percent * n // -(100 + percent) + 1


def _prefixes(weights, percent: int):
    """The first shingles of every set in the order of their buckets' counts, with their places."""

    def run(batches):
        weight = weights.value
        for batch in batches:
            out = [[], [], [], []]
            for item in batch.column(2):
                values = np.frombuffer(item.as_buffer(), dtype=np.uint64)
                probe, index = prefix_lengths(len(values), percent)
                order = np.lexsort((values, weight[(values % np.uint64(BUCKETS)).astype(np.int64)]))[:probe]
                place = np.arange(len(order))
                for column, x in zip(out, (values[order], place, place < index, np.full(len(order), len(values))), strict=True):
                    column.append(x)
            times = [len(x) for x in out[0]]
            h, place, index, n = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.astype(np.uint64).view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), times)),
                 pa.array(np.repeat(np.asarray(batch.column(1)), times)), pa.array(n.astype(np.int32)),
                 pa.array(place.astype(np.int32)), pa.array(index.astype(bool))],
                ["h", "id", "comp", "n", "place", "index"])

    return run


def _tiled(prefixes: DataFrame, tile: int = TILE) -> DataFrame:
    """``h, i, j, probe, id, comp, n, place``: under each shingle of several components every smaller set meets
    every larger one in one tile."""
    size = prefixes.groupBy("h").agg(
        F.ceil(F.count_if("index") / tile).cast("int").alias("ni"), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("nj"),
        F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("ni > 0 AND lo <> hi").drop("lo", "hi")
    rows = prefixes.join(size, "h")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["h", "i", "j", "probe", "id", "comp", "n", "place"]
    index = rows.where("index").withColumn("i", deal("ni")).withColumn("j", every("nj")).withColumn("probe", F.lit(False))
    probe = rows.withColumn("j", deal("nj")).withColumn("i", every("ni")).withColumn("probe", F.lit(True))
    return (index.select(*columns).unionByName(probe.select(*columns))
            .repartition("h", "i", "j").sortWithinPartitions("h", "i", "j", "probe"))


def _meet(percent: int):
    """Pairs of different components that sizes and places under a shared shingle allow."""

    def pairs(h, i, j, probe, ids, comp, n, place):
        if not len(h):
            return
        cut = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(h)]))
        larger = np.add.reduceat(probe.astype(np.int64), begin)  # they stand at the end of the tile
        left = np.flatnonzero(~probe)
        tile = np.searchsorted(begin, left, side="right") - 1
        times = larger[tile]
        ends = np.cumsum(times)
        lo = 0
        while lo < len(left):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MEET, side="right")))
            t = times[lo:hi]
            x = np.repeat(left[lo:hi], t)
            y = np.arange(len(x)) - np.repeat(np.cumsum(t) - t, t) + np.repeat((end - larger)[tile[lo:hi]], t)
            lo = hi
            ok = comp[x] != comp[y]
            x, y = x[ok], y[ok]
            ok = ((n[x] < n[y]) | ((n[x] == n[y]) & (ids[x] < ids[y]))) & (100 * n[x] >= percent * n[y])
            x, y = x[ok], y[ok]
            least = -(percent * (n[x] + n[y]) // -(100 + percent))  # of common shingles
            ok = np.minimum(n[x] - place[x], n[y] - place[y]) >= least
            x, y = ids[x[ok]], ids[y[ok]]
            yield np.unique(np.stack((np.maximum(x, y), np.minimum(x, y)), axis=1), axis=0)

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(c).astype(np.int64) if k != 3 else np.asarray(c.to_numpy(zero_copy_only=False))
                    for k, c in enumerate(batch.columns)]
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            last = int(same.argmax())  # rows are sorted: the last tile may go on
            for out in pairs(*[x[:last] for x in rows]):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])
            held = [x[last:] for x in rows]
        if held is not None:
            for out in pairs(*held):
                yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])

    return run


def allowed_pairs(sets: DataFrame, members: DataFrame, percent: int, store: Store, tile: int = TILE) -> DataFrame:
    """``a, b``: pairs of members (``id, comp``) of different components whose sets (``id, items``) may reach the
    threshold.

    Every pair that reaches it is among them: what is left out shares no shingle of the two prefixes, or
    differs too much in size, or has too few shingles after the shared one.
    """
    spark = sets.sparkSession
    counts = (sets.select("items").mapInArrow(_weigh, "bucket int, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n"))).toArrow()  # at most BUCKETS rows
    weight = np.zeros(BUCKETS, dtype=np.int64)
    weight[np.asarray(counts.column("bucket").combine_chunks())] = np.asarray(counts.column("n").combine_chunks())
    weights = spark.sparkContext.broadcast(np.minimum(weight, 0xFFFFFFFF).astype(np.uint32))
    prefixes = store.save(sets.join(members, "id").select("id", "comp", "items").mapInArrow(
        _prefixes(weights, percent), "h long, id long, comp long, n int, place int, index boolean"), "prefixes")
    weights.unpersist()
    return _tiled(prefixes, tile).mapInArrow(_meet(percent), "a long, b long").distinct()


def _bits(nodes: DataFrame) -> bytes:
    """A bitmap of the ids (modulo its bits): tells most rows that are not asked for.

    Some sixteen bits an id, from 2**20 to 2**28 bits (32 MB) in all.
    """
    size = 1 << min(28, max(20, int(16 * nodes.count()).bit_length()))
    bit = nodes.select(F.pmod("id", F.lit(size)).alias("h"))
    parts = bit.groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros((size // 32768 + 2, 4096), dtype=np.uint8)
    for row in parts:  # at most size / 32768 of 4 kB each
        out[row["bucket"]] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return size.to_bytes(8, "little") + out.tobytes()


def _sets(bits):
    """Shingle sets of the documents whose bit is set."""

    def run(batches):
        size, table = int.from_bytes(bits.value[:8], "little"), np.frombuffer(bits.value, dtype=np.uint8, offset=8)
        for batch in batches:
            at = np.mod(np.asarray(batch.column(0)), size)
            # buckets count from 1, bit 0 of the first bucket being value 1
            bucket, position = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
            asked = table[bucket * 4096 + position // 8] >> (position % 8).astype(np.uint8) & 1
            batch = batch.filter(pa.array(asked.astype(bool)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in shingle_sets(batch.column(1))], pa.binary())],
                ["id", "items"])

    return run


def _confirm(percent: int):
    """Pairs whose sets reach the threshold: 100 * intersection >= percent * union."""

    def run(batches):
        for batch in batches:
            keep = []
            x, y = batch.column(2), batch.column(3)
            for k in range(batch.num_rows):
                u, v = (np.frombuffer(c[k].as_buffer(), dtype=np.uint64) for c in (x, y))
                if min(len(u), len(v)) * 100 < percent * max(len(u), len(v)):
                    keep.append(False)
                    continue
                both = np.concatenate((u, v))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], ["a", "b"])

    return run


@small_batches(256)
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85,
                    block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """One row per row of ``docs``: its id, ``n_shingles, component_id, kept``.

    Documents are linked when 100 * intersection >= ``percent`` * union of their shingle sets.
    Null, empty and blank texts have no shingles and no links; rows without id are never linked,
    have a null component and are kept. Rows that repeat an id are one document. Other columns are
    ignored, whatever their names; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    store = Store(spark, "minhash")
    least = least_matches(percent / 100)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = store.save(texts.mapInArrow(_sign, "id long, n_shingles long, digest binary, keys binary, sketch binary"), "signed")

    some = signed.where("n_shingles > 0 AND id IS NOT NULL")
    first = some.groupBy("digest").agg(F.min("id").alias("id"))
    reps = store.save(some.join(first, ["digest", "id"], "left_semi").select("id", "keys", "sketch"), "reps")

    keys = reps.select("id", "keys").mapInArrow(_regions, "key long, id long, tree int")
    crowded = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = keys.join(crowded, "key").join(reps.select("id", "sketch"), "id").select("key", "id", "tree", "n", "sketch")
    forest = store.save(rows.mapInArrow(_sketch, "key long, id long, n long, sketch binary"), "forest")

    # a small region stays whole; a larger one is dealt out along its order
    wide = F.when(F.col("n") > block, F.col("sketch"))

    def ordered(df):
        return df.withColumn("along", wide).repartitionByRange("key", "along").sortWithinPartitions("key", "sketch", "id").drop("along")

    found = store.save(ordered(forest).mapInArrow(_neighbours(least, block), EDGES), "found")
    hubs = found.where("kind = 1").select("key", F.col("a").alias("id"), "sketch").distinct()
    best_hub = _wide(forest, hubs, block).select("key", "part", "group", "kind", "id", "sketch").mapInArrow(
        _with_hubs(least), "a long, b long, matches int")
    pair = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "matches")
    candidates = store.save(
        pair(found.where("kind = 0").select("a", "b", "matches").unionByName(best_hub))
        .groupBy("a", "b").agg(F.max("matches").alias("matches")), "candidates")

    def sets_of(nodes: DataFrame, name: str) -> DataFrame:
        """Shingle sets of the nodes (and of a few more)."""
        bits = spark.sparkContext.broadcast(_bits(nodes))
        out = store.save(texts.where("id IS NOT NULL").mapInArrow(_sets(bits), "id long, items binary"), name)
        bits.unpersist()
        return out

    def confirmed(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """The pairs that hold on the full sets, as a written table."""
        x = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
        y = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
        return store.save(pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y")
                          .mapInArrow(_confirm(percent), "a long, b long"), name)

    n_candidates = candidates.count()
    either = candidates.select(F.col("a").alias("id"), "a", "b", "matches").unionByName(
        candidates.select(F.col("b").alias("id"), "a", "b", "matches"))
    best = store.save(either.groupBy("id").agg(F.max(F.struct("matches", "a", "b")).alias("e"))
                      .select("e.a", "e.b").distinct(), "best", rows=n_candidates)
    sets = sets_of(either.select("id").distinct(), "candidate-sets")
    parts = components(confirmed(best, sets, "links-1"), store, "first", rows=n_candidates)

    # other candidates between what the first round left apart
    ends = lambda c: parts.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
    apart = store.save(
        candidates.select("a", "b").join(ends("a"), "a", "left").join(ends("b"), "b", "left")
        .where("coalesce(ac, a) <> coalesce(bc, b)").select("a", "b").join(best, ["a", "b"], "left_anti"), "apart", rows=n_candidates)
    final = parts
    if not apart.isEmpty():
        final = joined(parts, confirmed(apart, sets, "links-2"), store, "second")
    store.drop("candidate-sets")

    # all that share a region with another component, compared exactly
    placed = forest.select("key", "id").join(final, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
    members = store.save(placed.join(mixed, "key").select("id", "comp").distinct(), "members")
    if not members.isEmpty():
        sets = sets_of(members.select("id"), "member-sets")
        met = store.save(allowed_pairs(sets, members, percent, store, tile), "met")
        final = joined(final, confirmed(met, sets, "links-3"), store, "third")
        store.drop("member-sets", "prefixes")
    store.drop("forest", "found", "candidates", "reps")

    nodes = some.select("digest", "id").join(first.select("digest", F.col("id").alias("node")), "digest")
    placed = nodes.join(final.withColumnRenamed("id", "node"), "node", "left").select(
        "id", F.coalesce("component", "node").alias("component")).groupBy("id").agg(F.min("component").alias("component"))
    return (signed.select("id", "n_shingles").join(placed, "id", "left")
            .select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """``docs`` without the documents whose group has one with a smaller id; all columns as they are."""
    gone = near_duplicates(docs, id_col, text_col, percent).where("NOT kept").select(F.col(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
