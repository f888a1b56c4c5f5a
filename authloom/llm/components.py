"""Connected components of a link table, by randomised contraction in DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store

TAIL = 1 << 17  # links (two longs each) that one task finishes


def _finish(batches):
    """``id, root`` of all ends of at most ``TAIL`` links."""
    parts = [(np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches if b.num_rows]
    if not parts:
        return
    a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(ids))
    while True:  # every end takes the least root across its links, then roots are followed to their end
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while (root[root] != root).any():
            root = root[root]
        if (root[x] == root[y]).all():
            break
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], ["id", "root"])


def components(links: DataFrame, store: Store, name: str, tail: int = TAIL, rows: int | None = None) -> DataFrame:
    """``id, component``: every id that occurs in ``links`` (``a, b``) with the smallest id it reaches.

    Loops are no links. In each round every id goes to the id of least hash among itself and its
    neighbours, and links are renamed, which takes a quarter of the ids off at least (on the average, and
    nearly all in dense groups), so the number of rounds grows with the logarithm of the links. Minima are
    combined before the shuffle, so a hub with very many links costs a few partial rows. Once no more than
    ``tail`` links are left, one task finishes them. Each round is a written table, and so is the result.
    ``rows`` is a bound on the links, where one is known.
    """
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    links = store.save(links.select(*pair("a", "b")).where("a <> b").distinct(), f"{name}-links-0", rows=rows)
    layers, done = [], []
    while (rows := links.count()) > tail:
        step = len(layers)
        rank = lambda c: F.struct(F.xxhash64(F.lit(step), F.col(c)).alias("h"), F.col(c).alias("to"))  # noqa: B023, E731
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy("a").agg(F.min(rank("b")).alias("near"))
        layers.append(store.save(hook.select(F.col("a").alias("id"), F.least("near", rank("a"))["to"].alias("to")), f"{name}-to-{step}",
                                 rows=2 * rows))
        to = lambda c: layers[step].select(F.col("id").alias(c), F.col("to").alias(f"{c}2"))  # noqa: B023, E731
        links = store.save(links.join(to("a"), "a").join(to("b"), "b").where("a2 <> b2").select(*pair("a2", "b2")).distinct(),
                           f"{name}-links-{step + 1}", rows=rows)
        done.append(f"{name}-links-{step}")
    out = store.save(links.coalesce(1).mapInArrow(_finish, "id long, root long"), f"{name}-roots")
    store.drop(*done)
    for layer in reversed(layers):
        ends = out.select(F.col("id").alias("to"), "root")
        out = layer.join(ends, "to", "left").select("id", F.coalesce("root", "to").alias("root"))
    if not layers:  # then roots are the smallest ids already
        return out.select("id", F.col("root").alias("component"))
    out = store.save(out, f"{name}-all")
    least = out.groupBy("root").agg(F.min("id").alias("component"))
    return store.save(out.join(least, "root").select("id", "component"), f"{name}-components")


def joined(known: DataFrame, links: DataFrame, store: Store, name: str) -> DataFrame:
    """Components (``id, component``) of what ``known`` was found from and further ``links`` together.

    Both are written tables. Only links between different components are contracted; without any,
    ``known`` is the result, else it is a new written table.
    """
    rows = links.count()
    end = lambda c: known.select(F.col("id").alias(c), F.col("component").alias(f"{c}c"))
    across = store.save(
        links.select("a", "b").join(end("a"), "a", "left").join(end("b"), "b", "left")
        .select(F.coalesce("ac", "a").alias("a"), F.coalesce("bc", "b").alias("b")).where("a <> b").distinct(),
        f"{name}-across", rows=rows) if rows else links
    if across.isEmpty():
        return known
    more = components(across, store, name, rows=rows)
    moved = more.select(F.col("id").alias("component"), F.col("component").alias("new"))
    renamed = known.join(moved, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    both = renamed.unionByName(more.join(known.select("id"), "id", "left_anti").select("id", "component"))
    return store.save(both, f"{name}-joined", rows=known.count() + more.count())
