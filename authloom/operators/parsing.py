"""Raw auth lines -> typed events, rejects, counters and ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.numbers import block_of
from authloom.functions.once import computed_once
from authloom.functions.text import SEP, non_empty, unicode_trim
from authloom.functions.times import syslog_timestamp

EVENT_COLUMNS = [
    "node_id", "id", "timestamp", "hostname", "process", "pid", "message",
    "src_ip", "src_port", "dst_user", "log_type", "raw_line",
]


def parse_header(lines: DataFrame) -> DataFrame:
    """Split each line once into header parts; ``header_ok`` is false where the shape is wrong.

    One regex replacement yields all nine parts, instead of one extraction per part.
    """
    raw = unicode_trim(F.col("value"))
    parts = F.split(
        F.regexp_replace(F.col("raw_line"), fixed.SYSLOG_HEADER,
                         SEP.join(f"${i}" for i in range(1, 10))),
        SEP,
    )
    staged = (
        lines.withColumn("raw_line", raw)
        .where(F.col("raw_line") != "")
        .withColumn("_p", F.when(~F.col("raw_line").contains(SEP), parts))
    )
    ok = F.coalesce(F.size("_p") == 9, F.lit(False))

    def part(i: int) -> Column:
        return F.when(ok, F.col("_p")[i])

    return staged.select(
        *[c for c in lines.columns if c != "value"], "raw_line",
        ok.alias("header_ok"),
        part(0).alias("month"), part(1).alias("day"), part(2).alias("hour"),
        part(3).alias("minute"), part(4).alias("second"),
        part(5).alias("hostname"), part(6).alias("process"),
        F.coalesce(non_empty(part(7)), F.when(ok, F.lit("0"))).alias("pid_text"),
        part(8).alias("message"),
    )


# (log type, plain text every match contains, pattern); within a process the first match wins
_SSHD = [
    ("ssh_failed_password", "Failed password for ", fixed.SSH_FAILED_PASSWORD),
    ("ssh_accepted", "Accepted p", fixed.SSH_ACCEPTED),
    ("ssh_scan", "Did not receive identification string", fixed.SSH_NO_IDENT),
    ("ssh_connection_closed", "Connection closed by ", fixed.SSH_CLOSED),
    ("ssh_auth_failure", "uthentication failure", fixed.SSH_AUTH_FAILURE),
    ("ssh_preauth_disconnect", "Received disconnect from ", fixed.SSH_PREAUTH),
]
_SUDO = [
    ("sudo_auth_failure", "authentication failure", None),
    ("sudo_success", "TTY=", fixed.SUDO_COMMAND),
]
_SU = [
    ("su_failed", "FAILED SU ", fixed.SU_FAILED),
    ("su_success", "(to ", fixed.SU_SUCCESS),
]
_FLAGS = "(?dU)"


def _first_match(message: Column, forms: list, other: str) -> Column:
    """Log type of the first matching form. The plain-text test keeps most regexes from running."""
    out = F
    for log_type, anchor, pattern in forms:
        cond = message.contains(anchor)
        if pattern:
            cond = cond & message.rlike(_FLAGS + pattern)
        out = out.when(cond, F.lit(log_type))
    return out.otherwise(F.lit(other))


def classify(events: DataFrame) -> DataFrame:
    """Add log_type, dst_user, src_ip and src_port_text.

    The matched text of an ssh form is a run of blank-separated words, so one extraction gives all
    its fields by position, counted from the end where an optional part comes first.
    """
    process, message, kind = F.col("process"), F.col("message"), F.col("log_type")
    typed = events.withColumn(
        "log_type",
        F.when(process == "sshd", _first_match(message, _SSHD, "ssh_other"))
        .when(process == "sudo", _first_match(message, _SUDO, "sudo_other"))
        .when(process == "su", _first_match(message, _SU, "su_other"))
        .otherwise(F.concat(process, F.lit("_other"))),
    )
    text = F
    for log_type, _, pattern in _SSHD:
        if log_type != "ssh_auth_failure":
            text = text.when(kind == log_type, F.regexp_extract(message, _FLAGS + pattern, 0))
    staged = typed.withColumn("_w", F.split(text, " "))

    def word(i: int) -> Column:
        return F.try_element_at("_w", F.lit(i))

    def group(pattern: str, i: int) -> Column:
        return non_empty(F.regexp_extract(message, _FLAGS + pattern, i))

    return staged.select(
        "*",
        F.when(kind.isin("ssh_failed_password", "ssh_accepted"), word(-5))
        # "Connection closed by authenticating user U IP port P": nine words when a user is named
        .when((kind == "ssh_connection_closed") & (F.size("_w") == 9), word(-4))
        .when(kind == "sudo_auth_failure", group(fixed.SUDO_USER, 1))
        .when(kind == "sudo_success", group(fixed.SUDO_COMMAND, 2))
        .when(kind == "su_failed", group(fixed.SU_FAILED, 1))
        .when(kind == "su_success", group(fixed.SU_SUCCESS, 1))
        .alias("dst_user"),
        F.when(kind == "ssh_preauth_disconnect", word(4)).otherwise(word(-3)).alias("src_ip"),
        F.when(kind == "ssh_preauth_disconnect", F.substring_index(word(6), ":", 1))
        .otherwise(word(-1)).alias("src_port_text"),
    ).drop("_w")


def parse_lines(lines: DataFrame, ref_year: int) -> DataFrame:
    """Every non-blank line with its parsed columns and ``reject_reason`` (NULL when usable).

    Input columns: ``value`` plus any keys to carry along (``node_id``, ``file``, ``line_no``).
    """
    typed = classify(parse_header(lines)).withColumns({
        "timestamp": syslog_timestamp(
            F.col("month"), F.col("day"), F.col("hour"), F.col("minute"), F.col("second"), ref_year),
        "pid": F.col("pid_text").try_cast("int"),
        "src_port": F.col("src_port_text").try_cast("int"),
    })
    bad_int = F.col("pid").isNull() | (F.col("src_port_text").isNotNull() & F.col("src_port").isNull())
    parsed = typed.withColumn(
        "reject_reason",
        F.when(~F.col("header_ok"), F.lit("header"))
        .when(F.col("timestamp").isNull(), F.lit("timestamp"))
        .when(bad_int, F.lit("integer")),
    ).drop("header_ok", "month", "day", "hour", "minute", "second", "pid_text", "src_port_text")
    return computed_once(parsed, [c for c in lines.columns if c != "value"])


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable events, rejected lines with their reason)."""
    events = parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")
    keys = [c for c in ("node_id", "file", "line_no") if c in parsed.columns]
    rejects = parsed.where(F.col("reject_reason").isNotNull()).select(
        *keys, "raw_line", "reject_reason")
    return events, rejects


def ingest_stats(parsed: DataFrame, now: Column | None = None,
                 retention_seconds: int = fixed.RETENTION_SECONDS) -> DataFrame:
    """Per node: lines parsed, inserted, failed and still held at ``now``."""
    ok = F.col("reject_reason").isNull()
    held = ok if now is None else ok & (
        F.col("timestamp") >= now - F.make_dt_interval(secs=F.lit(retention_seconds)))
    return parsed.groupBy("node_id").agg(
        F.count("*").alias("lines_parsed"),
        F.count_if(ok).alias("lines_inserted"),
        F.count_if(F.col("reject_reason").isin("timestamp", "integer")).alias("errors"),
        F.count_if(held).alias("events_held"),
    )


def assign_ids(events: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Dense ``id`` 1..n per node in (file, line_no) order.

    A node may hold most of the data, so rows are numbered inside fixed line blocks and shifted by
    the running total of the preceding blocks: no task ever sorts a whole node. ``events`` is read
    twice and should be a stored table.
    """
    key = ["node_id", "file", "_block"]
    blocked = events.withColumn("_block", block_of("line_no", block))
    sizes = blocked.groupBy(*key).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("node_id").orderBy("file", "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("line_no"))
    return (
        blocked.withColumn("_rn", inside)
        .join(offsets, key)
        .withColumn("id", F.col("_before") + F.col("_rn"))
        .drop("_block", "_rn", "_before")
    )


def load_lines(parsed: DataFrame, path: str) -> dict[str, int]:
    """Write parsed lines, usable and rejected ones apart (``usable=true/false``).

    ``lines_parsed, lines_inserted, errors`` are counted by the same pass over the lines. A load that runs
    again replaces what it wrote.
    """
    seen, ok = Observation(), F.col("reject_reason").isNull()
    (parsed.observe(
        seen, F.count(F.lit(1)).alias("lines_parsed"), F.count_if(ok).alias("lines_inserted"),
        F.count_if(F.col("reject_reason").isin("timestamp", "integer")).alias("errors"))
     .withColumn("usable", ok).write.mode("overwrite").partitionBy("usable").parquet(path))
    return {k: int(v) for k, v in seen.get.items()}


def retain(events: DataFrame, now: Column,
           retention_seconds: int = fixed.RETENTION_SECONDS) -> DataFrame:
    """Events not older than the retention at ``now``."""
    return events.where(
        F.col("timestamp") >= now - F.make_dt_interval(secs=F.lit(retention_seconds)))


def retain_by_registry(events: DataFrame, registry: DataFrame, now: Column,
                       source: str = "auth_log") -> DataFrame:
    """Per-node retention in days from the registry; nodes without an entry keep everything."""
    days = registry.where(F.col("source_name") == source).groupBy("node_id").agg(
        F.max("retention_days").alias("retention_days"))
    keep = F.col("retention_days").isNull() | (
        F.col("timestamp") >= now - F.make_dt_interval(days=F.col("retention_days")))
    return events.join(days, "node_id", "left").where(keep).drop("retention_days")
