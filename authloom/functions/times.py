"""Time parsing. Event time is a zone-less timestamp; offsets only matter for stored evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.text import lookup, non_empty


def syslog_timestamp(month: Column, day: Column, hour: Column, minute: Column, second: Column,
                     year: int) -> Column:
    """Zone-less timestamp from syslog parts, NULL when they form no valid instant."""
    month_no = lookup(month, {m: i + 1 for i, m in enumerate(fixed.MONTHS)})
    sec = second.try_cast("int")
    return F.when(
        sec < 60,  # 60 would silently roll over into the next minute
        F.try_make_timestamp_ntz(
            F.lit(year), month_no, day.try_cast("int"), hour.try_cast("int"),
            minute.try_cast("int"), sec.cast("decimal(8,6)"),
        ),
    )


def micros(ts: Column) -> Column:
    """Zone-less or instant timestamp as microseconds (session zone should be UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_z(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def normalize_ts(col: Column, now: Column, offset: str = "+0000") -> Column:
    """Offset text: missing -> now, Z kept, +08:00 -> +0800, naive -> session offset appended."""
    s = F.trim(col.cast("string"))
    has_offset = s.rlike(r"(?s)^.+T[^T]*[+-][^T]*$")
    return (
        F.when(non_empty(col.cast("string")).isNull(), now)
        .when(s.endswith("Z"), s)
        .when(has_offset, F.regexp_replace(s, r":(..)$", "$1"))
        .otherwise(F.concat(s, F.lit(offset)))
    )


def parse_any_ts(col: Column) -> Column:
    """Instant from any stored form (T or blank, fraction, Z, offset, slashes), else NULL.

    Forms without an offset are read in the session zone.
    """
    shaped = F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}"), col)
    return F.coalesce(
        shaped.try_cast("timestamp"),
        # only texts of this shape reach the parser: a failing parse costs an exception
        F.when(col.rlike(r"^\d{4}/"), F.try_to_timestamp(col, F.lit("yyyy/MM/dd HH:mm:ss"))),
    )
