"""Rule catalog and rule x event matching."""

from __future__ import annotations

import json
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions import fixed
from authloom.functions.text import like_any, non_empty

_DEFAULTS = {
    "severity": "medium",
    "category": "unknown",
    "count": 1,
    "window_seconds": 300,
    "cooldown_seconds": 600,
    "suggested_logs": ["auth_log"],
}


class Rule(NamedTuple):
    """A usable rule with every default filled in."""

    rule_id: str
    name: str
    severity: str
    category: str
    process: str
    patterns: list[str]
    count: int
    window_seconds: int
    group_by: str | None
    cooldown_seconds: int
    suggested_logs: list[str]


def normalise(rules: list[dict]) -> tuple[list[Rule], list[str]]:
    """Usable rules, and for every other one why it is none.

    A value that is absent and one that is null both mean the default.
    """
    usable, problems = [], []
    for k, raw in enumerate(rules):
        try:
            match, threshold, signal = ((raw.get(part) or {}) for part in ("match", "threshold", "signal"))

            def value(source: dict, name: str):
                found = source.get(name)
                return _DEFAULTS.get(name) if found is None else found  # noqa: B023

            if not raw.get("id"):
                raise ValueError("has no id")
            if not match.get("process") or not match.get("patterns"):
                raise ValueError("has no process or no patterns")
            usable.append(Rule(
                str(raw["id"]), str(raw.get("name") or raw["id"]), str(value(raw, "severity")), str(value(raw, "category")),
                str(match["process"]), [str(p) for p in match["patterns"]], int(value(threshold, "count")),
                int(value(threshold, "window_seconds")), threshold.get("group_by") or None,
                int(value(raw, "cooldown_seconds")), list(value(signal, "suggested_logs"))))
        except (AttributeError, TypeError, ValueError) as e:
            problems.append(f"rule {k}: {e}")
    return usable, problems


def load_rules(path: str) -> list[dict]:
    """Rules of a YAML or JSON catalog file (a small driver-side configuration)."""
    with open(path, encoding="utf-8") as fh:
        text = fh.read()
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional dependency, only needed for YAML catalogs

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    return (data or {}).get("rules", [])


def parse_catalog(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One row per usable rule from JSON rule documents, defaults filled in.

    A rule without id, without a process or without patterns is skipped.
    """
    r = F.from_json(F.col(column), schemas.RULE)
    rules = docs.select(r.alias("r")).where("r IS NOT NULL").select(
        non_empty(F.col("r.id")).alias("rule_id"),
        F.coalesce(non_empty(F.col("r.name")), "r.id").alias("name"),
        F.coalesce("r.severity", F.lit(_DEFAULTS["severity"])).alias("severity"),
        F.coalesce("r.category", F.lit(_DEFAULTS["category"])).alias("category"),
        non_empty(F.col("r.match.process")).alias("process"),
        F.col("r.match.patterns").alias("patterns"),
        F.coalesce("r.threshold.count", F.lit(_DEFAULTS["count"])).alias("count"),
        F.coalesce("r.threshold.window_seconds", F.lit(_DEFAULTS["window_seconds"]))
        .alias("window_seconds"),
        non_empty(F.col("r.threshold.group_by")).alias("group_by"),
        F.coalesce("r.cooldown_seconds", F.lit(_DEFAULTS["cooldown_seconds"]))
        .alias("cooldown_seconds"),
        F.coalesce("r.signal.suggested_logs", F.array(*map(F.lit, _DEFAULTS["suggested_logs"])))
        .alias("suggested_logs"),
    )
    return rules.where(F.col("rule_id").isNotNull() & F.col("process").isNotNull() & (F.size("patterns") > 0))


def _rule_struct(rule: Rule, columns: list[str]) -> Column:
    if rule.group_by and rule.group_by not in columns:
        raise ValueError(f"rule {rule.rule_id!r} groups by {rule.group_by!r}, which events do not have")
    value = F.col(rule.group_by).cast("string") if rule.group_by else F.lit(None).cast("string")
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.count).cast("int").alias("need"),
        F.lit(rule.window_seconds).cast("int").alias("window_seconds"),
        F.lit(rule.cooldown_seconds).cast("int").alias("cooldown_seconds"),
        F.coalesce(value, F.lit(fixed.GLOBAL_GROUP)).alias("group_key"),
    )


def match_rules(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Event rows x matching rules, adding rule_id, need, window_seconds, cooldown_seconds and
    group_key, in one pass over the events for all rules.

    Rules become constant predicates below a CASE over their process, so an event is held against
    the patterns of its own process only, and the process list reaches the scan. A rule may group by
    any column of the events; unusable rules match nothing (``normalise`` names them).
    """
    by_process: dict[str, list[Rule]] = {}
    for rule in normalise(rules)[0]:
        by_process.setdefault(rule.process, []).append(rule)
    if not by_process:
        return match_rules(events.where("false"), [_NEVER])
    hits = None
    for process, own in sorted(by_process.items()):
        found = F.array_compact(F.array(*[
            F.when(like_any(F.col("message"), r.patterns), _rule_struct(r, events.columns)) for r in own]))
        here = F.col("process") == process
        hits = F.when(here, found) if hits is None else hits.when(here, found)
    return (
        events.where(F.col("process").isin(sorted(by_process)))
        .withColumn("_r", F.explode_outer(hits))
        .where(F.col("_r").isNotNull())
        .select("*", "_r.*")
        .drop("_r")
    )


GRAMS = (4, 8)  # characters of the literal pieces by which a pattern is found
WORDS = 1 << 21  # of 64 bits, that tell which pieces an index may have (16 MB)
COUNTS = 1 << 19  # of sixteen sizes each, that tell how many patterns have a piece (4 MB)
_CHUNK = 1024


def _grams(text: str) -> str:
    """SQL for all pieces of ``GRAMS`` characters of a text, and the empty one."""
    pieces = "".join(f", if(length({text}) < {n}, array(), transform(sequence(1, length({text}) - {n - 1}), i -> substring({text}, i, {n})))"
                     for n in GRAMS)
    return f"array_distinct(concat(array(''){pieces}))"


def _table(rows: DataFrame, size: int) -> Column:
    """``id, word`` as one array of ``size`` numbers, 0 where there is no row; its size doesn't depend on the rows."""
    every = rows.sparkSession.range(size).join(rows, "id", "left").withColumn("part", F.expr(f"id div {_CHUNK}"))
    parts = every.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word")))).alias("w"))
    whole = parts.agg(F.sort_array(F.collect_list(F.struct("part", F.col("w.word").alias("word")))).alias("w"))
    return whole.select(F.flatten("w.word")).scalar()


def _bits(hashed: str) -> str:
    """SQL for four bits of a word, by parts of a hash that its place doesn't use."""
    return "(" + " | ".join(f"shiftleft(1L, cast(shiftrightunsigned({hashed}, {k}) & 63 AS int))" for k in (40, 46, 52, 58)) + ")"


def _piece_bits(index: DataFrame) -> Column:
    """The pieces of an index as four bits each in one of ``WORDS`` numbers, whatever the size of the index."""
    hashed = index.select(F.xxhash64("process", "gram").alias("h"))
    return _table(hashed.groupBy((F.col("h").bitwiseAND(WORDS - 1)).alias("id")).agg(F.expr(f"bit_or({_bits('h')})").alias("word")), WORDS)


def _piece_sizes(pieces: DataFrame) -> Column:
    """How many rows each ``process, gram`` has: sixteen logarithms of hashed counts in each of ``COUNTS`` numbers.

    They tell a count from one three times as large. What shares a place is summed, so a piece may look more common
    than it is, never rarer.
    """
    place = F.xxhash64("process", "gram").bitwiseAND(16 * COUNTS - 1)
    counts = pieces.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))
    words = counts.groupBy(F.shiftright("place", 4).alias("id")).agg(F.expr(
        "bit_or(shiftleft(cast(least(floor(0.625 * log2(n)), 15) AS bigint), cast(place & 15 AS int) * 4))").alias("word"))
    return _table(words, COUNTS)


def pattern_index(catalog: DataFrame) -> DataFrame:
    """``process, gram`` and the rule with ``pattern`` and its number: every pattern of a catalog under one piece.

    A pattern stands under a piece of its literal parts that few patterns of its process have (as ``_piece_sizes``
    tells, so that pieces themselves are never shuffled); one without a literal part of as many characters as the
    shortest of ``GRAMS`` stands under the empty piece, which every message has.
    """
    each = catalog.select("*", F.posexplode("patterns").alias("no", "pattern")).where("pattern IS NOT NULL").withColumn(
        "_pieces", F.expr(f"array_distinct(flatten(transform(split(pattern, '[%_]'), f -> {_grams('f')})))"))
    sizes = _piece_sizes(each.select("process", F.explode("_pieces").alias("gram")))
    # the empty piece only where there is no other
    rank = f"""transform(_pieces, g -> named_struct('none', g = '', 'size', shiftright(get(_sizes, cast(shiftright(
        xxhash64(process, g) & {16 * COUNTS - 1}, 4) AS int)), cast(xxhash64(process, g) & 15 AS int) * 4) & 15,
        'short', -length(g), 'gram', g))"""
    return each.withColumn("_sizes", sizes).withColumn("gram", F.array_min(F.expr(rank))["gram"]).drop("_pieces", "_sizes")


def match_catalog(events: DataFrame, catalog: DataFrame) -> DataFrame:
    """``match_rules`` for a catalog that is data (columns of ``parse_catalog``), however many rules it has.

    Rules are found by an index of literal pieces of their patterns: distinct messages are cut into pieces, those
    that the index may have are joined with it, LIKE confirms, and a rule counts once for a message, by the first
    of its patterns that matches; events get the rules of their message. The plan does not depend on the catalog.
    All joins are by shuffle: the planner takes messages cut into pieces to be as small as their files. Of an event
    only the columns that are asked for, and those that rules group by, go through the shuffle. Rule ids have to be
    distinct. A rule that groups by a column which events do not have raises an error when it matches.
    """
    index = pattern_index(catalog)
    held = index.select(
        F.col("process").alias("_process"), F.col("gram").alias("_gram"), F.col("no").alias("_no"),
        F.col("patterns").alias("_patterns"), "rule_id", F.col("count").cast("int").alias("need"),
        F.col("window_seconds").cast("int").alias("window_seconds"),
        F.col("cooldown_seconds").cast("int").alias("cooldown_seconds"), F.col("group_by").alias("_by"))
    hit = "_message LIKE concat('%', replace(p, '\\\\', '\\\\\\\\'), '%')"
    value = "CASE " + " ".join(f"WHEN _by = '{c}' THEN _value{i}" for i, c in enumerate(events.columns))
    value += " WHEN _by IS NOT NULL THEN raise_error(concat('rule ', rule_id, ' groups by ', _by, ', which events do not have')) END"
    texts = events.select(F.col("process").alias("_of"), F.col("message").alias("_message")).distinct()
    hashed = "xxhash64(_of, _piece)"
    may = F.get(_piece_bits(index), F.expr(f"cast({hashed} & {WORDS - 1} AS int)"))
    bits = F.expr(_bits(hashed))
    pieces = texts.withColumn("_piece", F.explode(F.expr(_grams("_message")))).where(may.bitwiseAND(bits) == bits)
    found = pieces.join(held.hint("merge"), [F.col("_of") == F.col("_process"), F.col("_piece") == F.col("_gram")])
    first = F.expr(f"array_position(transform(_patterns, p -> coalesce({hit}, false)), true) = _no + 1")
    found = found.where(first).drop("_process", "_piece", "_gram", "_no", "_patterns")
    # not by a filter, which would move to where the catalog is read
    grouping = catalog.agg(F.collect_set(F.when(F.col("group_by").isin(events.columns), F.col("group_by")))).scalar()
    valued = events.withColumns({f"_value{i}": F.when(F.array_contains(grouping, c), F.col(c).cast("string"))
                                 for i, c in enumerate(events.columns)})
    each = valued.join(found.hint("merge"), [F.col("process") == F.col("_of"), F.col("message") == F.col("_message")])
    return each.withColumn("group_key", F.coalesce(F.expr(value), F.lit(fixed.GLOBAL_GROUP))).select(
        *events.columns, "rule_id", "need", "window_seconds", "cooldown_seconds", "group_key")


def matches(events: DataFrame, rules: list[dict] | DataFrame) -> DataFrame:
    """Matches of a configured list of rules, or of a catalog table."""
    return match_catalog(events, rules) if isinstance(rules, DataFrame) else match_rules(events, rules)


_NEVER = {"id": "-", "match": {"process": "-", "patterns": ["-"]}}
