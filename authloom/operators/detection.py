"""Threshold detection over matched events: snapshot, sliding event time, cool-down."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.fields import severity_level
from authloom.functions.numbers import block_of
from authloom.functions.text import lookup, short_hash
from authloom.functions.times import iso_z, micros
from authloom.operators.rules import matches, normalise

KEY = ["node_id", "rule_id", "group_key"]
_SECOND = 1_000_000


def threshold_snapshot(events: DataFrame, rules: list[dict] | DataFrame, now: Column) -> DataFrame:
    """Groups over their threshold as seen at ``now`` (the window has no upper bound)."""
    m = matches(events, rules).where(
        F.col("timestamp") >= now - F.make_dt_interval(secs=F.col("window_seconds")))
    return (
        m.groupBy(*KEY, "need")
        .agg(F.count("*").alias("matched_count"))
        .where(F.col("matched_count") >= F.col("need"))
        .drop("need")
    )


def group_stats(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Matched count with first and last time per rule and group."""
    return matches(events, rules).groupBy(*KEY).agg(
        F.count("*").alias("matched_count"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def instant_counts(matched: DataFrame) -> DataFrame:
    """Matches per (node, rule, group, instant).

    Auth logs tick in whole seconds, so this caps even the busiest group at one row per second,
    whatever its event volume, and combines before the shuffle.
    """
    return matched.groupBy(
        *KEY, "need", "window_seconds", "cooldown_seconds", micros(F.col("timestamp")).alias("us"),
    ).agg(F.count("*").alias("n"))


# Of two instants just one window apart, the earlier one counts. In windows of time their distance is 1, but for
# the rounding of two divisions and a difference; the next instant that doesn't count is 1 + 1 / window microseconds
# away, which is more than this for windows up to twenty years.
_ONE_WINDOW = "1.0000000000000009D"
_WINDOWS = 4  # of a bucket


def sliding_counts(matched: DataFrame) -> DataFrame:
    """Per instant, the matches of its group in [instant - window, instant].

    A group is cut into time buckets of ``_WINDOWS`` window lengths, and rows of the last window of a bucket also
    visit the next one, so a bucket holds all its look-back. Partitions are thereby at most five windows long
    and a hot group spreads over many tasks. Inside a bucket, time counts in windows, so one frame serves
    rules of any number of window lengths. What follows from other columns is derived after the shuffle.
    """
    window = f"(greatest(CAST(window_seconds AS BIGINT), 0L) * {_SECOND})"
    length = f"greatest({window}, 1L)"

    def begin(us: str) -> str:
        return f"({us} - pmod({us}, {_WINDOWS} * {length}))"

    parts = [*KEY, "window_seconds", "_bucket"]
    visits = instant_counts(matched).withColumn("_bucket", F.explode(F.expr(
        f"array_distinct(array({begin('us')}, {begin(f'(us + {length})')}))"))).repartition(*parts)
    # numbers near 0, for they are exact there; an empty window holds its own instant only: times are whole, so half a
    # step is less than any distance
    place = F.expr(f"(us - _bucket - 2 * {length}) / CAST({length} AS DOUBLE) * if({window} > 0, 1D, 2D)")
    count = F.expr(f"""sum(n) OVER (PARTITION BY {", ".join(parts)} ORDER BY _place
                       RANGE BETWEEN {_ONE_WINDOW} PRECEDING AND CURRENT ROW)""")
    return (
        visits.withColumn("_place", place).withColumn("window_count", count)
        .where(F.expr(f"_bucket = {begin('us')}"))
        .select(*KEY, "need", "window_seconds", "cooldown_seconds", "us", "n", "window_count")
    )


def threshold_hits(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Instants at which a group reaches its threshold, over the whole history."""
    return sliding_counts(matches(events, rules)).where(F.col("window_count") >= F.col("need"))


_FIRE_SCHEMA = (
    "node_id string, rule_id string, group_key string, us bigint, window_count bigint, fired boolean"
)


def _accepted(us: np.ndarray, cooldown: int, last: int | None) -> tuple[np.ndarray, int]:
    """Which of one key's ordered hits fire, and the last that did, in as many steps as there are fires."""
    fired = np.full(len(us), cooldown <= 0)
    if cooldown <= 0:
        return fired, int(us[-1])
    k = 0 if last is None else int(np.searchsorted(us, last + cooldown))
    while k < len(us):
        fired[k], last = True, int(us[k])
        k += 1 + int(np.searchsorted(us[k + 1:], last + cooldown))
    return fired, last


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Sorted rows in frames that hold whole groups of ``keys``."""
    held = []
    for pdf in batches:
        if not len(pdf):
            continue
        same = np.ones(len(pdf), dtype=bool)
        for c in keys:
            v = pdf[c].to_numpy()
            same &= v == v[-1]
        last = len(pdf) - int(np.argmin(same[::-1])) if not same.all() else 0
        first = pdf.iloc[0]
        if held and any(held[-1][c].iat[-1] != first[c] for c in keys):
            yield pd.concat(held)
            held = []
        if last:
            yield pd.concat([*held, pdf.iloc[:last]])
            held = []
        held.append(pdf.iloc[last:])
    if held:
        yield pd.concat(held)


_BLOCK = [*KEY, "block"]
_EXITS = "node_id string, rule_id string, group_key string, block bigint, cooldown_seconds int, entry bigint, exit bigint"


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each block of a key makes of a cool-down that runs into it: ``entry, exit``.

    The hit at which a block is entered is the first one that the last fire before it doesn't suppress.
    From there every fire has one successor, the first hit a cool-down later; ``exit`` is the last fire
    in the block. Only hits within a cool-down of the block's begin, and the next one, can be entered at;
    of those that lead to the same exit the latest is enough.
    """
    for pdf in _runs(batches, _BLOCK):
        us = pdf["us"].to_numpy()
        wait = pdf["cooldown_seconds"].to_numpy().astype(np.int64) * _SECOND
        begin = pdf["begin"].to_numpy()
        change = np.zeros(len(pdf), dtype=bool)
        for c in _BLOCK:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        group = np.cumsum(change)
        # one ascending axis for all groups, on which no cool-down reaches the next group
        place = us - begin
        line = place + group * (int(place.max()) + int(wait.max()) + 1)
        after = np.searchsorted(line, line + wait)
        here = np.arange(len(us))
        ends = (after == len(us)) | (group[np.minimum(after, len(us) - 1)] != group)
        to = np.where(ends, here, after)
        while True:  # successors of successors
            onward = to[to]
            if (onward == to).all():
                break
            to = onward
        leaves = us[to]
        late = place >= wait
        earlier = np.concatenate(([False], late[:-1] & ~change[1:]))
        some = np.flatnonzero(~late | ~earlier)  # the first late hit of a block, and all that are not late
        merged = np.concatenate((leaves[some][1:] == leaves[some][:-1], [False])) & np.concatenate(
            (group[some][1:] == group[some][:-1], [False]))
        keep = some[~merged]
        yield pd.DataFrame({**{c: pdf[c].to_numpy()[keep] for c in [*_BLOCK, "cooldown_seconds"]},
                            "entry": us[keep], "exit": leaves[keep]})


_BEFORE = "node_id string, rule_id string, group_key string, block bigint, us bigint"


def _befores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The last fire before every block of a key but the first, by one step per block."""
    key, last, block, done, leave = None, None, None, False, None
    for pdf in batches:
        out = []
        columns = [pdf[c].tolist() for c in [*_BLOCK, "cooldown_seconds", "entry", "exit"]]
        for *k, b, cooldown, entry, exit in zip(*columns):
            if k != key:
                key, last, block = k, None, None
            if b != block:
                last = last if block is None else leave
                block, done, leave = b, False, last
                if last is not None:
                    out.append((*k, b, last))
            if not done and (last is None or entry >= last + cooldown * _SECOND):
                done, leave = True, exit
        yield pd.DataFrame(out, columns=[*_BLOCK, "us"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk a block's hits in order; a row without count says when the key fired last before it."""
    current, last = None, None
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for c in _BLOCK:
            v = pdf[c].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        us, hit = pdf["us"].to_numpy(), pdf["hit"].to_numpy().astype(bool)
        cooldown = pdf["cooldown_seconds"].fillna(0).to_numpy().astype(np.int64) * _SECOND
        fired = np.zeros(len(pdf), dtype=bool)
        bounds = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for lo, hi in zip(bounds, bounds[1:]):
            block = tuple(pdf[c].iat[lo] for c in _BLOCK)
            if block != current:
                current, last = block, None
            if not hit[lo]:
                last, lo = int(us[lo]), lo + 1
            if lo < hi:
                fired[lo:hi], last = _accepted(us[lo:hi], int(cooldown[lo]), last)
        pdf["fired"] = fired
        yield pdf.loc[hit, [*KEY, "us", "window_count", "fired"]]


def judge_hits(hits: DataFrame, block_seconds: int = 86_400) -> DataFrame:
    """Mark each hit as fired or suppressed by the cool-down of its rule and group.

    The cool-down is an ordered fold, which no window function expresses, but folds of blocks compose. A key's
    time is cut into blocks of several cool-downs. Each block tells for every hit it can be entered at
    which fire is its last; one pass over these few rows finds the last fire before each block; then every
    block is judged by itself. So a key of any length spreads over as many tasks as it has blocks, and what
    a task holds at a time is a block.
    """
    columns = ["node_id", "rule_id", "group_key", "us", "window_count"]
    free = hits.where("cooldown_seconds <= 0").select(*columns, F.lit(True).alias("fired"))
    span = f"greatest(4L * cooldown_seconds, {int(block_seconds)}L) * {_SECOND}"
    held = hits.where("cooldown_seconds > 0").select(
        *columns, "cooldown_seconds", block_of("us", f"({span})").alias("block"))
    entered = (held.select(*_BLOCK, "us", "cooldown_seconds", F.expr(f"block * {span}").alias("begin"))
               .repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "us").mapInPandas(_exits, _EXITS))
    before = entered.repartition(*KEY).sortWithinPartitions(*_BLOCK, "entry").mapInPandas(_befores, _BEFORE)
    rows = held.withColumn("hit", F.lit(True)).unionByName(before.withColumn("hit", F.lit(False)), allowMissingColumns=True)
    judged = rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "hit", "us").mapInPandas(_judge, _FIRE_SCHEMA)
    return free.unionByName(judged).withColumn("timestamp", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")


def fires(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Accepted detections in event time."""
    return judge_hits(threshold_hits(events, rules)).where("fired").drop("fired")


def detect_stats(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Fired and suppressed hits per rule."""
    return judge_hits(threshold_hits(events, rules)).groupBy("rule_id").agg(
        F.count_if("fired").alias("signals_fired"),
        F.count_if(~F.col("fired")).alias("signals_suppressed"),
    )


def build_signals(fired: DataFrame, rules: list[dict]) -> DataFrame:
    """Signal rows. Ids are a hash of what identifies the detection, so re-runs agree."""
    by_id = {r.rule_id: r for r in normalise(rules)[0]}
    rule = F.col("rule_id")

    def of(field):
        return lookup(rule, {k: getattr(r, field) for k, r in by_id.items()}, "")

    severity = of("severity")
    by_ip = rule.isin([k for k, r in by_id.items() if r.group_by == "src_ip"])
    at = iso_z(F.col("timestamp"))
    suggested = F.coalesce(*[
        F.when(rule == k, F.array(*map(F.lit, r.suggested_logs)) if r.suggested_logs else F.array().cast("array<string>"))
        for k, r in by_id.items()
    ])
    return fired.select(
        F.concat(F.lit("sig-"), short_hash(F.col("node_id"), rule, F.col("group_key"), at))
        .alias("signal_id"),
        "node_id",
        rule.alias("detection_rule_id"),
        rule,
        severity_level(severity).alias("rule_level"),
        F.concat(of("name"), F.lit(": "),
                 F.col("window_count").cast("string"), F.lit(" matches from "), F.col("group_key"))
        .alias("rule_desc"),
        severity.alias("severity"),
        of("category").alias("category"),
        F.when(by_ip & (F.col("group_key") != fixed.GLOBAL_GROUP), F.col("group_key"))
        .otherwise(F.lit(fixed.NO_IP)).alias("src_ip"),
        at.alias("event_time"),
        suggested.alias("suggested_logs"),
        F.concat("node_id", F.lit("/auth_log#"), "group_key", F.lit("#"), at).alias("raw_ref"),
        F.col("window_count").alias("matched_count"),
    )
