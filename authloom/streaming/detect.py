"""Continuous threshold detection in event time.

The result depends on event times only, not on arrival: a match waits in state until the watermark
has passed it, then instants are judged in order. Keys are (node, rule, group), so the state of a
key is at most one rule window plus what is still in flight. Keys are judged in a fixed number of
shards: a call and its state operations cost more than the few instants of a key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from authloom.operators.detection import _accepted
from authloom.operators.rules import matches
from authloom.streaming.ingest import column_families, to_table

_SECOND = 1_000_000

_OUT = StructType([
    StructField("node_id", StringType()), StructField("rule_id", StringType()),
    StructField("group_key", StringType()), StructField("us", LongType()),
    StructField("window_count", LongType()),
])


SHARDS = 1024  # groups of keys that are judged together; the state of one is about that part of the whole
_KEYED = ["node_id", "rule_id", "group_key", "rules_version"]
_RULE = ["need", "window_seconds", "cooldown_seconds"]
# the keys of a shard with their rules (an Arrow stream), and rows of (number of the key, instant, matches, kind)
_STATE = StructType([StructField(c, BinaryType()) for c in ("keys", "code", "us", "n", "kind")])
_WAITING, _JUDGED, _FIRED = 0, 1, 2  # kinds: judged rows stay for one window, a key has one row for its last fire


def _packed(keys: pd.DataFrame, rows: pd.DataFrame) -> tuple:
    table = pa.Table.from_pandas(keys, preserve_index=False)
    with (out := pa.BufferOutputStream()), pa.ipc.new_stream(out, table.schema) as writer:
        writer.write_table(table)
    return (out.getvalue().to_pybytes(), *(rows[c].to_numpy(t).tobytes() for c, t in _ROWS.items()))


_ROWS = {"code": np.int32, "us": np.int64, "n": np.int64, "kind": np.int8}


def _unpacked(state: tuple) -> tuple[pd.DataFrame, pd.DataFrame]:
    keys = pa.ipc.open_stream(bytes(state[0])).read_all().to_pandas()
    return keys, pd.DataFrame({c: np.frombuffer(bytes(b), dtype=t) for (c, t), b in zip(_ROWS.items(), state[1:])})


def _with_fresh(keys: pd.DataFrame, rows: pd.DataFrame, fresh: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Keys and rows with new matches; the rule that a key was first seen with stays its own."""
    every = pd.concat([keys, fresh[[*_KEYED, *_RULE]]], ignore_index=True) if len(keys) else fresh[[*_KEYED, *_RULE]]
    number = every.groupby(_KEYED, dropna=False, sort=False).ngroup().to_numpy()
    _, first = np.unique(number, return_index=True)  # keys are distinct and come first, so they keep their numbers
    new = pd.DataFrame({"code": number[len(keys):], "us": fresh["us"].to_numpy(), "n": 1, "kind": _WAITING})
    return every.iloc[first].reset_index(drop=True), pd.concat([rows, new], ignore_index=True)


def _judged(keys: pd.DataFrame, rows: pd.DataFrame, mark: int) -> tuple[pd.DataFrame, pd.DataFrame, pd.DataFrame, int | None]:
    """Fires of all instants before the watermark ``mark``, then the keys and rows that may still count, and the
    next instant something is due at."""
    need, window, cooldown = (keys[c].to_numpy().astype(np.int64) for c in _RULE)
    window, cooldown = window * _SECOND, cooldown * _SECOND
    fired_rows = rows[rows["kind"] == _FIRED]
    last = np.full(len(keys), _NEVER, dtype=np.int64)
    last[fired_rows["code"].to_numpy()] = fired_rows["us"].to_numpy()
    counts = rows[rows["kind"] != _FIRED].groupby(["code", "us"], sort=True).agg(n=("n", "sum"), kind=("kind", "max")).reset_index()
    code, us, n, judged = (counts[c].to_numpy() for c in ("code", "us", "n", "kind"))
    count = _trailing(code, us, n, window)
    hit = np.flatnonzero((judged == _WAITING) & (us < mark) & (count >= need[code]))
    fires = []
    for at in np.split(hit, np.flatnonzero(np.diff(code[hit])) + 1) if len(hit) else []:
        k = code[at[0]]
        accepted, last[k] = _accepted(us[at], int(cooldown[k]), None if last[k] == _NEVER else int(last[k]))
        fires.append(at[accepted])
    found = np.concatenate(fires) if fires else hit
    out = keys.iloc[code[found]][_KEYED[:3]].assign(us=us[found], window_count=count[found])
    # an instant more than one window behind all that is to come counts for nothing any more
    left = us >= mark - window[code]
    code, us, n = code[left], us[left], n[left]
    # a key is forgotten when nothing can count or be suppressed any more
    held = np.zeros(len(keys), dtype=bool)
    held[code] = True
    held |= (last != _NEVER) & (last + cooldown >= mark)
    kept = pd.concat([
        pd.DataFrame({"code": code, "us": us, "n": n, "kind": np.where(us < mark, _JUDGED, _WAITING)}),
        pd.DataFrame({"code": (lasts := np.flatnonzero(held & (last != _NEVER))), "us": last[lasts], "n": 0, "kind": _FIRED})])
    # wake when the earliest waiting instant is complete, or a key has gone quiet for good
    quiet = np.where(held & (last != _NEVER), last + cooldown, _NEVER)
    np.maximum.at(quiet, code, us + window[code])
    waits = np.zeros(len(keys), dtype=bool)
    waits[code[us >= mark]] = True
    due = np.concatenate((us[us >= mark] // 1000 + 1, quiet[held & ~waits] // 1000 + 2))
    kept["code"] = (np.cumsum(held) - 1)[kept["code"].to_numpy()]
    return out, keys[held].reset_index(drop=True), kept, int(due.min()) if len(due) else None


_NEVER = -(2**62)


def _trailing(code: np.ndarray, us: np.ndarray, n: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Per instant, the matches of its key in [instant - window, instant]; rows are sorted by key and instant."""
    out = np.zeros(len(us), dtype=np.int64)
    if not len(us):
        return out
    # one ascending axis for as many keys as fit on it, on which no window reaches the key before
    begin, span = int(us.min()), int(us.max()) - int(us.min()) + int(np.abs(window).max()) + 1
    step = max(1, 2**62 // span)
    for k in range(0, int(code[-1]) + 1, step):
        lo, hi = np.searchsorted(code, (k, k + step))
        line = us[lo:hi] - begin + (code[lo:hi].astype(np.int64) - k) * span
        total = np.concatenate(([0], np.cumsum(n[lo:hi])))
        out[lo:hi] = total[1:] - total[np.searchsorted(line, line - window[code[lo:hi]])]
    return out


def _threshold(shard: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Sliding thresholds with cool-down for the keys (node, rule, group, rules version) of a shard.

    Keys share their calls and their state, so that a trigger costs by the rows it judges and not by the keys.
    Rows with the flush flag only move the watermark; they leave no state.
    """
    keys, rows = _unpacked(state.get) if state.exists else (pd.DataFrame(columns=[*_KEYED, *_RULE]), pd.DataFrame(
        {c: np.array([], dtype=t) for c, t in _ROWS.items()}))
    fresh = [f for f in (pdf[~pdf["flush"].astype(bool)] for pdf in frames) if len(f)] if not state.hasTimedOut else []
    if fresh:
        keys, rows = _with_fresh(keys, rows, pd.concat(fresh, ignore_index=True))
    if not len(keys):
        return
    ms = state.getCurrentWatermarkMs()
    out, keys, rows, due = _judged(keys, rows, ms * 1000)
    if len(keys):
        state.update(_packed(keys, rows))
        state.setTimeoutTimestamp(max(due, ms + 1))
    else:
        state.remove()
    if len(out):
        yield out


def detect_stream(events: DataFrame, rules: list[dict] | DataFrame, delay: str,
                  rules_version: int = 0) -> DataFrame:
    """Fires of an event stream. A new ``rules_version`` starts from empty cool-downs and counts,
    as a rule reload does."""
    return judge_stream(_with_flush(events, rules).withColumn("rules_version", F.lit(rules_version)), delay)


def judge_stream(matched: DataFrame, delay: str) -> DataFrame:
    """Fires of a stream of matches, each with the version of the rules it was found by."""
    matched = (
        matched
        .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        .withWatermark("timestamp", delay)
        .select("node_id", "rule_id", "group_key", "rules_version", "flush",
                F.unix_micros("timestamp").alias("us"), "need", "window_seconds",
                "cooldown_seconds", "timestamp",
                F.pmod(F.xxhash64(*_KEYED), F.lit(SHARDS)).alias("shard"))
    )
    found = matched.groupBy("shard").applyInPandasWithState(
        _threshold, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(
        "node_id", "rule_id", "group_key", F.timestamp_micros("us").alias("timestamp"), "window_count")


def _with_flush(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Matches, and rows with the ``flush`` flag as they are, so that they move the watermark."""
    flush = events.where("flush").select(
        "*", F.lit("").alias("rule_id"), F.lit(2**31 - 1).alias("need"),
        F.lit(1).alias("window_seconds"), F.lit(0).alias("cooldown_seconds"), F.lit("").alias("group_key"))
    return matches(events.where("NOT flush"), rules).unionByName(flush, allowMissingColumns=True)


LANDED = ["node_id", "id", "timestamp", "process", "message", "src_ip", "dst_user", "hostname", "log_type"]


def land_events(events: DataFrame, path: str) -> None:
    """Append closed events to a landing folder, as many tasks as the events have."""
    cols = [c for c in LANDED if c in events.columns]
    events.select(*cols, F.lit(False).alias("flush")).write.mode("append").parquet(path)


def land_end(spark: SparkSession, path: str) -> None:
    """One far-future row that ends event time: an append-mode stream only emits what the watermark
    has passed, and this lets it pass everything that was landed before."""
    schema = spark.read.parquet(path).schema
    fixed_values = {"node_id": F.lit("-"), "id": F.lit(-1).cast("bigint"), "process": F.lit("-"), "message": F.lit("-"),
                    "timestamp": F.lit("2100-01-01 00:00:00").cast("timestamp_ntz"), "flush": F.lit(True)}
    spark.range(1).select(*[
        fixed_values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in schema
    ]).write.mode("append").parquet(path)


def _landed(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(path).schema).option(
        "maxFilesPerTrigger", max_files).parquet(path)


def run_detection(spark: SparkSession, source: str, rules: list[dict], path: str, checkpoint: str,
                  delay: str = "1 minute", rules_version: int = 0, max_files: int = 1000) -> StreamingQuery:
    """Work off what has landed since the checkpoint; returns the finished query.

    ``delay`` is how late an event may arrive; a fire is reported that long after its event.
    """
    found = detect_stream(_landed(spark, source, max_files), rules, delay, rules_version)
    with column_families(spark):
        query = to_table(found, path, checkpoint)
    query.awaitTermination()
    return query


def publish_rules(catalog: DataFrame, path: str, version: int) -> None:
    """Write a version of the rules (columns of ``parse_catalog``); a version written again is replaced."""
    catalog.write.mode("overwrite").parquet(f"{path}/version={int(version)}")


def newest_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of the highest version published, with ``version``."""
    every = spark.read.parquet(path)
    return every.where(F.col("version") == every.select(F.max("version")).scalar())


def match_live(spark: SparkSession, source: str, rules: str, path: str, checkpoint: str,
               max_files: int = 1000) -> StreamingQuery:
    """A running query that matches landed events by the newest published rules.

    Every micro-batch reads the rules anew, so a version counts from the next trigger on, without a
    restart. A batch that runs again replaces its own matches.
    """
    def sink(batch: DataFrame, batch_id: int) -> None:
        catalog = newest_rules(spark, rules)
        version = catalog.select(F.max("version")).first()[0]
        found = _with_flush(batch, catalog.drop("version")).select(
            "node_id", "rule_id", "group_key", "flush", "timestamp", "need", "window_seconds", "cooldown_seconds",
            F.lit(version).cast("int").alias("rules_version"))
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (_landed(spark, source, max_files).writeStream.foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").start())


def run_judging(spark: SparkSession, source: str, path: str, checkpoint: str, delay: str = "1 minute",
                max_files: int = 1000) -> StreamingQuery:
    """Work off the matches that ``match_live`` has written since the checkpoint."""
    with column_families(spark):
        query = to_table(judge_stream(_landed(spark, source, max_files), delay), path, checkpoint)
    query.awaitTermination()
    return query


def keys_in_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``node_id, rule_id, group_key, rules_version, flush, last``: what a finished run still remembers, read from
    its checkpoint."""
    with column_families(spark):
        rows = spark.read.format("statestore").load(checkpoint).select("value.groupState.*")

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for state in pdf.itertuples(index=False, name=None):
                    known, held = _unpacked(state)
                    fired = held[held["kind"] == _FIRED]
                    last = pd.Series(fired["us"].to_numpy(), index=fired["code"].to_numpy()).reindex(range(len(known)))
                    yield known[_KEYED].assign(flush=False, last=last.astype("Int64"))

        return rows.mapInPandas(
            keys, "node_id string, rule_id string, group_key string, rules_version int, flush boolean, last bigint")


def windowed_thresholds(events: DataFrame, rules: list[dict], width: str, delay: str,
                        slide: str | None = None) -> DataFrame:
    """Tumbling or sliding window counts per rule and group, where they reach the threshold.

    Built-in aggregation only: cheaper than exact sliding detection, coarser at window edges.
    """
    matched = _with_flush(events, rules)
    timed = matched.withColumn("timestamp", F.col("timestamp").cast("timestamp")).withWatermark(
        "timestamp", delay)
    span = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    return (
        timed.groupBy(span.alias("w"), "node_id", "rule_id", "group_key", "need")
        .agg(F.count("*").alias("matched_count"))
        # Flush rows can never reach their threshold. A filter on the rule name would be moved below
        # the watermark and take away the very rows that advance it.
        .where(F.col("matched_count") >= F.col("need"))
        .select("node_id", "rule_id", "group_key", F.col("w.start").alias("window_start"),
                "matched_count")
    )


def run_windows(spark: SparkSession, source: str, rules: list[dict], path: str, checkpoint: str,
                width: str, delay: str = "1 minute", max_files: int = 1000) -> StreamingQuery:
    query = to_table(windowed_thresholds(_landed(spark, source, max_files), rules, width, delay), path, checkpoint)
    query.awaitTermination()
    return query
