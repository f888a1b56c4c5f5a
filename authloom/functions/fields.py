"""Field extraction over alternative names, severity maps and reply parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fixed
from authloom.functions.text import lookup, non_empty, unicode_trim


def first_filled(df: DataFrame, *names: str) -> Column:
    """First non-empty value among those of ``names`` that the frame has (top-level names)."""
    present = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*[non_empty(c) for c in present]) if present else F.lit(None).cast("string")


def severity_of(df: DataFrame, default: int = 0) -> Column:
    return F.coalesce(first_filled(df, "severity", "level").try_cast("int"), F.lit(default))


def src_ip_of(df: DataFrame) -> Column:
    return first_filled(df, "src_ip", "agent_ip", "data.srcip")


def hostname_of(df: DataFrame) -> Column:
    return first_filled(df, "hostname", "agent_name", "agent.name")


def severity_level(word: Column) -> Column:
    return lookup(word, fixed.SEVERITY_LEVEL, fixed.SEVERITY_LEVEL_DEFAULT)


def log_type_severity(log_type: Column) -> Column:
    return lookup(log_type, fixed.LOG_TYPE_SEVERITY, fixed.LOG_TYPE_SEVERITY_DEFAULT)


def reply_body(text: Column) -> Column:
    """The json-fenced block of a reply, else its first fenced block, else all of it."""
    tagged = F.regexp_extract(text, r"(?s)```json(.*?)(?:```|$)", 1)
    fenced = F.regexp_extract(text, r"(?s)```(.*?)(?:```|$)", 1)
    return unicode_trim(
        F.when(text.contains("```json"), tagged).when(text.contains("```"), fenced).otherwise(text)
    )


def parse_body(body: Column, schema: str = schemas.REPLY) -> Column:
    """Struct of a reply body, NULL when it is not a JSON object."""
    is_object = body.startswith("{") & F.try_parse_json(body).isNotNull()
    return F.when(is_object, F.from_json(body, schema))


def parse_replies(replies: DataFrame, column: str = "reply", schema: str = schemas.REPLY) -> DataFrame:
    """``column`` replaced by the struct ``verdict``; the body is cut out once, then parsed."""
    keys = [c for c in replies.columns if c != column]
    return replies.select(*keys, reply_body(F.col(column)).alias("_body")).select(
        *keys, parse_body(F.col("_body"), schema).alias("verdict"))
