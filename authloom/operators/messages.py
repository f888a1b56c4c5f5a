"""Message-table operators: decoding, dead letters, retention, inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.once import computed_once


def to_message(df: DataFrame) -> DataFrame:
    """Each row as one JSON document, NULL fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("payload"))


def decode(messages: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, broken messages) of JSON payloads.

    A payload counts as broken when it is no JSON object; extra or missing fields do not matter.
    """
    ok = F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{")
    tried = computed_once(
        messages.withColumn("body", F.when(ok, F.from_json("payload", schema))), messages.columns)
    good = tried.where(F.col("body").isNotNull()).select(
        *[c for c in messages.columns if c != "payload"], "body.*")
    return good, tried.where(F.col("body").isNull()).drop("body")


def typed_fields(messages: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Messages with typed fields of their payloads (``fields``: name to type), whatever else these hold.

    Each payload is parsed once into a variant. A field that is absent or of another type is NULL, and so
    are all fields of a payload that is no JSON.
    """
    parsed = computed_once(messages.withColumn("_body", F.try_parse_json("payload")), messages.columns)
    return parsed.select(*messages.columns, *[
        F.try_variant_get("_body", f"$['{name}']", kind).alias(name) for name, kind in fields.items()])


def retry_or_dead_letter(failed: DataFrame,
                         max_deliveries: int = fixed.MAX_DELIVERIES) -> tuple[DataFrame, DataFrame]:
    """Failed messages to deliver again (attempt counted up) and those given up.

    ``attempts`` is the number of deliveries made so far, the failed one included.
    """
    spent = F.coalesce("attempts", F.lit(1)) >= max_deliveries
    again = failed.where(~spent).withColumn("attempts", F.coalesce("attempts", F.lit(1)) + 1)
    return again, failed.where(spent)


def retain_stream(messages: DataFrame, now: Column, max_age: int = fixed.STREAM_MAX_AGE_SECONDS,
                  max_bytes: int = fixed.STREAM_MAX_BYTES) -> DataFrame:
    """Messages young enough and inside the newest ``max_bytes`` of their stream.

    The size runs over whole hours first. Only the hour in which the limit falls, one per stream, is
    sorted; hours before and after it are kept and dropped as they are.
    """
    young = messages.where(
        F.col("published_at") >= now - F.make_dt_interval(secs=F.lit(max_age))
    ).withColumns({
        "_size": F.octet_length("payload").cast("bigint"),
        "_hour": F.date_trunc("hour", "published_at"),
    })
    hours = young.groupBy("stream", "_hour").agg(F.sum("_size").alias("_bytes"))
    newer = Window.partitionBy("stream").orderBy(F.desc("_hour")).rowsBetween(
        Window.unboundedPreceding, -1)
    # message sizes may be null, and count as nothing then
    offsets = hours.select("stream", "_hour", F.coalesce("_bytes", F.lit(0)).alias("_bytes"),
                           F.coalesce(F.sum("_bytes").over(newer), F.lit(0)).alias("_newer")).where(
        F.col("_newer") <= max_bytes)
    near = young.join(offsets, ["stream", "_hour"])
    fits = F.col("_newer") + F.col("_bytes") <= max_bytes
    inside = Window.partitionBy("stream", "_hour").orderBy(
        F.desc("published_at"), F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    cut = near.where(~fits).withColumn("_run", F.sum("_size").over(inside)).where(
        F.col("_newer") + F.coalesce("_run", F.lit(0)) <= max_bytes).drop("_run")
    return near.where(fits).unionByName(cut).drop("_size", "_hour", "_bytes", "_newer").select(*messages.columns)


def stream_inventory(messages: DataFrame, consumers: DataFrame) -> DataFrame:
    """Messages, bytes and distinct consumers per stream."""
    sizes = messages.groupBy("stream").agg(
        F.count("*").alias("messages"),
        F.sum(F.octet_length("payload")).cast("bigint").alias("bytes"))
    readers = consumers.groupBy("stream").agg(F.count_distinct("consumer").alias("consumers"))
    return sizes.join(readers, "stream", "left").na.fill(0, ["consumers"])
