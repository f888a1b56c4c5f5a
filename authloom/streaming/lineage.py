"""Lineage of live streams: signals with the requests and the evidence that answer them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from authloom.streaming.ingest import column_families, to_table

END = "-end-"
KEYS = {"signals": ["signal_id"], "requests": ["query_id", "signal_id"], "evidence": ["evidence_id", "query_id"]}


FOUND = ["evidence_id", "lineage_id", "raw_ref"]


def _bundled(evidence: DataFrame) -> DataFrame:
    """``query_id, at`` and a list of each column of ``FOUND``: evidence of a request and an instant that stands together.

    Rows of one Arrow batch are put together, without state: a bundle needn't be whole, but what a join keeps
    is a row per bundle instead of one per piece of evidence.
    """
    keys = ["query_id", "at"]

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one thread: all lists of a bundle are in the order of its rows
            made = pa.Table.from_batches([batch]).group_by(keys, use_threads=False).aggregate([(c, "list") for c in FOUND])
            yield from made.select([*keys, *[f"{c}_list" for c in FOUND]]).rename_columns([*keys, *FOUND]).to_batches()

    kinds = {f.name: f.dataType.simpleString() for f in evidence.schema}
    shape = ", ".join([f"{c} {kinds[c]}" for c in keys] + [f"{c} array<{kinds[c]}>" for c in FOUND])
    return evidence.select(*keys, *FOUND).mapInArrow(bundle, shape)


def lineage_stream(signals: DataFrame, requests: DataFrame, evidence: DataFrame, delay: str, within: str) -> DataFrame:
    """``signal_id, signal_ref, query_id, evidence_id, lineage_id, raw_ref`` by two stream-stream joins.

    Every stream has ``at``. A request comes ``within`` that time after its signal, evidence within twice the
    time; ``delay`` is how late a row may arrive. A signal without request, and a request without evidence,
    is reported once the watermark says that none will come, and then forgotten.
    """
    seen = lambda df, *columns: df.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", delay).select(*columns)
    s = seen(signals, "signal_id", F.col("raw_ref").alias("signal_ref"), F.col("at").alias("s_at"))
    r = seen(requests, F.col("signal_id").alias("r_signal"), "query_id", F.col("at").alias("r_at"))
    e = evidence.withColumn("at", F.col("at").cast("timestamp"))
    e = seen(_bundled(e), F.col("query_id").alias("e_query"), *FOUND, F.col("at").alias("e_at"))
    asked = s.join(r, F.expr(f"signal_id = r_signal AND r_at >= s_at AND r_at <= s_at + INTERVAL {within}"), "left_outer")
    asked = asked.select("signal_id", "signal_ref", "s_at", "query_id")
    found = asked.join(
        e, F.expr(f"query_id = e_query AND e_at >= s_at AND e_at <= s_at + INTERVAL {within} + INTERVAL {within}"), "left_outer")
    return found.select("signal_id", "signal_ref", "query_id", F.inline_outer(F.arrays_zip(*FOUND))).select(
        "signal_id", "signal_ref", "query_id", *FOUND)


def land(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def land_ends(spark: SparkSession, path: str) -> None:
    """A far-future row in each stream, which lets the watermark pass all others."""
    for name, keys in KEYS.items():
        schema = spark.read.parquet(f"{path}/{name}").schema
        fixed = {**{k: F.lit(END) for k in keys}, "at": F.lit("2100-01-01 00:00:00").cast("timestamp")}
        spark.range(1).select(*[
            fixed.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]).write.mode("append").parquet(f"{path}/{name}")


def run_lineage(spark: SparkSession, source: str, path: str, checkpoint: str, delay: str = "10 minutes",
                within: str = "5 minutes") -> StreamingQuery:
    """Work off what has landed in ``source/signals``, ``/requests`` and ``/evidence`` since the checkpoint.

    State lies on disk (RocksDB), one store per join and partition. A trigger commits every one of them however few rows
    it has, so there are as many partitions as the tasks of two rounds, not as many as a shuffle of the session has.
    A checkpoint keeps the settings that it was begun with.
    """
    streams = [spark.readStream.schema(spark.read.parquet(f"{source}/{name}").schema).parquet(f"{source}/{name}") for name in KEYS]
    parts = min(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with column_families(spark, shuffle__partitions=str(parts), streaming__join__stateFormatVersion="3"):
        query = to_table(lineage_stream(*streams, delay, within), path, checkpoint)
    query.awaitTermination()
    return query


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """What a run has reported, without the end rows."""
    return spark.read.parquet(path).where(F.col("signal_id") != END)
