"""Streaming ingest: log tails, fresh signals, redelivery de-duplication, dead letters.

Sources are folders of closed files; the checkpoint is the read position, so a restart continues
where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from authloom.functions.text import unicode_trim
from authloom.operators import messages, requests
from authloom.sources.files import _file_path, _plain, tag_node


def stream_auth_lines(spark: SparkSession, nodes: dict[str, str], start: str = "earliest",
                      since: str | None = None, max_files: int = 1000) -> DataFrame:
    """Lines of new files in the nodes' landing folders.

    ``start="latest"`` skips files last modified before ``since`` (a timestamp text). A rotated log
    is simply a new file.
    """
    if start == "latest" and not since:
        raise ValueError("start='latest' needs the time to start from")
    out = None
    for folder in _folders(nodes):
        reader = spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", max_files)
        one = reader.text(folder)
        if start == "latest":  # a condition on files, by which older ones are not opened
            one = one.where(F.col("_metadata.file_modification_time") >= F.lit(since).cast("timestamp"))
        one = one.select(_plain(_file_path()).alias("file"), "value")
        out = one if out is None else out.union(one)
    return tag_node(out, F.col("file"), nodes).where(
        F.col("node_id").isNotNull() & (unicode_trim(F.col("value")) != ""))


def _folders(nodes: dict[str, str]) -> list[str]:
    """One pattern for all landing folders of a common parent, so that many nodes stay one source."""
    parents = {p.rstrip("/").rsplit("/", 1)[0] for p in nodes}
    return [f"{p}/*" if len(nodes) > 1 else next(iter(nodes)) for p in sorted(parents)]


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def column_families(spark: SparkSession, **more: str) -> Iterator[None]:
    """The state store that keyed state with several variables needs, for what starts inside.

    A started query has its own copy of the settings, so the session's are put back at once. ``more`` are further
    settings below ``spark.sql.``, with ``__`` for a dot.
    """
    wanted = {_PROVIDER: _ROCKSDB, **{f"spark.sql.{k.replace('__', '.')}": v for k, v in more.items()}}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Start an available-now run that appends to a parquet table."""
    return (df.writeStream.outputMode(mode).format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def tail_to_table(spark: SparkSession, nodes: dict[str, str], path: str, checkpoint: str) -> None:
    to_table(stream_auth_lines(spark, nodes), path, checkpoint).awaitTermination()


def _stream_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def fresh_to_table(spark: SparkSession, source: str, now: str, path: str, checkpoint: str) -> None:
    """Signals not stale at ``now``; a live job passes the current time."""
    fresh = requests.fresh_signals(_stream_parquet(spark, source), F.lit(now).cast("timestamp"))
    to_table(fresh, path, checkpoint).awaitTermination()


def deduplicate(signals: DataFrame, delay: str) -> DataFrame:
    """First delivery of each signal id; ``delay`` bounds how late a redelivery may come."""
    return signals.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["signal_id"])


def dedup_to_table(spark: SparkSession, source: str, path: str, checkpoint: str, delay: str) -> None:
    signals = _stream_parquet(spark, source).withColumn("published_at", F.col("published_at").cast("timestamp"))
    to_table(deduplicate(signals, delay), path, checkpoint).awaitTermination()


def decode_batches(stream: DataFrame, schema: str, good: str, retry: str, dead: str,
                   checkpoint: str) -> StreamingQuery:
    """Decode JSON messages; unreadable ones go to the retry table until their deliveries are used
    up, then to the dead-letter table."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        decoded, broken = messages.decode(batch, schema)
        again, given_up = messages.retry_or_dead_letter(broken)
        # a re-run of the same batch overwrites its own part only
        for df, base in ((decoded, good), (again, retry), (given_up, dead)):
            df.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
