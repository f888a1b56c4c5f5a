"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

Every document draws its number of copies from a Poisson distribution whose mean is the repetition
rate of its source, by inverting the distribution at a number hashed from seed and id: the same seed
gives the same mix on any cluster, whatever the partitions. Copies are dealt out by a hash of seed,
id and copy number and sorted by it inside partitions, which is a global shuffle without a sort of
the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.llm.store import Store

FEW = 500_000  # numbers of all sources' distributions that are broadcast
OUTPUTS = ("copy", "shuffle_key")


def _key(id_col: str, text_col: str) -> Column:
    """Text form of the id; rows without id are told apart by their text."""
    return F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0,
          source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``src, volume, rate``: characters of each source and its mean number of copies.

    Target shares are ``weights`` (sources not named get none), or proportional to volume ** alpha.
    The mix aims at ``size`` times the characters of the input. A source without characters has no
    rate to aim at; its rate is 1.
    """
    volume = docs.groupBy(F.col(source_col).alias("src")).agg(
        F.sum(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("double").alias("volume"))
    if weights is None:
        weighed = volume.withColumn("weight", F.pow("volume", F.lit(alpha)))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else None
        weighed = volume.withColumn("weight", F.coalesce(named[F.col("src")], F.lit(0.0)) if weights else F.lit(0.0))
    weighed = Store(docs.sparkSession, "mixing").save(weighed, "sources")
    characters, weights_sum = weighed.agg(F.sum("volume"), F.sum("weight")).first()
    target = (characters or 0.0) * size
    return weighed.select("src", "volume", F.when(
        (F.col("volume") == 0) | F.lit(not weights_sum), F.lit(1.0)
    ).otherwise(F.col("weight") / F.lit(float(weights_sum or 1)) * F.lit(target) / F.col("volume")).alias("rate"))


def _steps(rate: DataFrame) -> DataFrame:
    """``src, least, steps``: cumulated probabilities of ``least``, ``least`` + 1, ... copies, up to where they are 1.

    The counts are those within some twelve standard deviations of the rate, so even a large rate has
    few; below them lies less probability than a double can show.
    """
    by_k = Window.partitionBy("src").orderBy("k")
    # ln k! by its sum, or by Stirling's series where the counts begin beyond that
    factorial = F.when(F.col("least") == 0, F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(by_k)).otherwise(
        F.expr("(k + 0.5D) * ln(k) - k + 0.5D * ln(2 * pi()) + 1 / (12D * k) - 1 / (360D * k * k * k)"))
    return (
        rate.withColumn("least", F.expr("cast(greatest(0, floor(rate - 12 * sqrt(rate) - 40)) as bigint)"))
        .withColumn("k", F.explode(F.expr("sequence(least, cast(ceil(rate + 12 * sqrt(rate) + 40) as bigint))")))
        .withColumn("log_factorial", factorial)
        .withColumn("p", F.expr("CASE WHEN rate > 0 THEN exp(k * ln(rate) - rate - log_factorial) "
                                "WHEN k = 0 THEN 1D ELSE 0D END"))
        .withColumn("step", F.sum("p").over(by_k))
        .groupBy("src", "least").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    )


def mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, size: float = 1.0,
        seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``docs`` with each row repeated by its number of copies, plus ``copy`` (from 1) and ``shuffle_key``.

    Rows without source form a source of their own. Repeated rows draw the same number. Columns of
    the input named like the two outputs are replaced. An empty table gives an empty result.
    """
    docs = docs.drop(*OUTPUTS)
    drawn = docs.select(
        F.struct("*").alias("row"), F.col(source_col).alias("own_src"), _key(id_col, text_col).alias("key")
    ).withColumn("u", F.conv(F.substring(F.md5(F.concat_ws(":", "key", F.lit(str(seed)))), 1, 13), 16, 10)
                 .cast("double") / float(1 << 52))
    steps = Store(docs.sparkSession, "mixing").save(
        _steps(rates(docs, weights, alpha, size, source_col, text_col)), "steps")
    if (steps.agg(F.sum(F.size("steps"))).first()[0] or 0) <= FEW:  # beyond, a shuffle joins them
        steps = F.broadcast(steps)
    copies = (drawn.join(steps, F.col("own_src").eqNullSafe(F.col("src")))
              .withColumn("copies", F.col("least") + F.size(F.filter("steps", lambda s: s <= F.col("u"))))
              .where("copies > 0")
              .select("row", "key", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
              .withColumn("shuffle_key", F.md5(F.concat_ws(":", "key", "copy", F.lit(str(seed))))))
    return (copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
            .select("row.*", "copy", "shuffle_key"))
