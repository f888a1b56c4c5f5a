"""Small Column helpers for text. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\n"  # cannot occur inside one log line


def non_empty(col: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(col, F.lit(""))


# fixed values: the characters a Unicode-aware strip removes
WHITE_SPACE = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def unicode_trim(col: Column) -> Column:
    """Strip any Unicode white space on both ends (plain ``trim`` strips blanks only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def short_hash(*cols: Column) -> Column:
    """First 16 hex digits of SHA-256 over the pipe-joined values, NULL read as ''."""
    joined = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    return F.substring(F.sha2(joined, 256), 1, 16)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant lookup as a CASE expression (tables here hold at most a few dozen entries)."""
    out = None
    for k, v in table.items():
        cond = key == F.lit(k)
        out = F.when(cond, F.lit(v)) if out is None else out.when(cond, F.lit(v))
    return out if default is None else out.otherwise(F.lit(default))


def like_any(col: Column, patterns: list[str]) -> Column:
    """Case-sensitive LIKE '%p%' for any pattern; % and _ inside a pattern act as wildcards."""
    out = F.lit(False)
    for p in patterns:
        out = out | col.like("%" + p.replace("\\", "\\\\") + "%")
    return out


def compact(*items: Column) -> Column:
    """Array of the non-NULL items, in order."""
    return F.array_compact(F.array(*items))


def percent(col: Column) -> Column:
    """Share as whole percent with ties to even, e.g. 0.125 -> '12%'."""
    return F.concat(F.bround(col * F.lit(100.0), 0).cast("bigint").cast("string"), F.lit("%"))
