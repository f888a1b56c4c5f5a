"""Exact de-duplication in DataFrame operations only: 128-bit hash groups, confirmed byte by byte.

Grouping by (digest, text) compares the bytes of every group and combines copies before the shuffle,
so a text that a third of all rows share costs a few partial rows. What goes back to the documents is
one small row per digest. A digest that holds different texts (a collision) is told from the number
of its texts, and only then the rows of such digests are joined on the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom.llm.store import Store

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text_col: str) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower())


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                 digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of ``docs``: its id, ``keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays (``keep="max"``) or with the smallest
    (``keep="min"``). Rows without id count in the sizes and never stay where a row of their group
    has an id. Repeated rows with the id that stays are all marked kept. Null and empty texts are one
    group. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn(
        "digest", digest(F.col("norm")))
    texts = rows.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"), pick("id").alias("keep"))
    per_digest = texts.groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n"), pick("keep").alias("keep")).where("n > 1")
    store = Store(docs.sparkSession, "exact")
    groups = store.save(per_digest, "groups")

    small = rows.select("id", "digest", F.sha2("norm", 256).alias("text_sha256"))
    known = small.join(groups, "digest", "left")
    out = known.where("coalesce(texts, 1) = 1").select(
        "id", F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "text_sha256")
    if not groups.where("texts > 1").isEmpty():
        collided = groups.where("texts > 1").select("digest")
        own = rows.join(collided, "digest", "left_semi")
        out = out.unionByName(own.join(texts, ["digest", "norm"]).select(
            "id", F.col("keep").alias("keep_id"), F.col("n").alias("group_size"),
            F.sha2("norm", 256).alias("text_sha256")))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id"))).withColumnRenamed("id", id_col)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one row of every group of equal texts, all columns as they are.

    The row with the largest (smallest) id stays, a row without id only if its group has no other;
    of repeated rows one stays. One shuffle, with copies combined before it.
    """
    pick = {"min": F.min_by, "max": F.max_by}[keep]
    rank = F.col(id_col) if keep == "max" else F.coalesce(F.col(id_col), F.lit((1 << 63) - 1))
    rows = docs.select(F.struct("*").alias("row"), normalised(text_col).alias("norm"),
                       F.struct(rank, F.col(text_col)).alias("rank"))
    return (rows.groupBy(F.md5("norm").alias("digest"), "norm").agg(pick("row", "rank").alias("row"))
            .select("row.*"))
