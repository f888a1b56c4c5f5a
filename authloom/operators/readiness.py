"""Data-quality gate per case: coverage, integrity, time order and span, uniqueness.

Evidence rows carry ``case_key`` and ``ord`` (arrival order, unique within a case) next to the
common schema. ``cases`` (one ``case_key`` per row) adds cases without any evidence. Every figure
is a mergeable aggregate, so a case that holds a third of all rows still combines on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.numbers import block_of
from authloom.functions.text import compact, non_empty, percent
from authloom.functions.times import micros, parse_any_ts


def _filled(name: str) -> Column:
    return F.col(name).cast("string")


def _missing(name: str) -> Column:
    return F.coalesce(_filled(name), F.lit("")) == ""


def _good(name: str) -> Column:
    return ~F.coalesce(_filled(name), F.lit("")).isin("", "unknown")


def field_aggregates() -> list[Column]:
    """Rows, missing required values, well-filled slots (evidence_id counts twice), usable ids."""
    missing = sum((_missing(f).cast("int") for f in fixed.REQUIRED_FIELDS), F.lit(0))
    good = sum((_good(f).cast("int") for f in fixed.REQUIRED_FIELDS + fixed.RECOMMENDED_FIELDS),
               F.lit(0))
    return [
        F.count("*").alias("n"),
        F.sum(missing).alias("missing"),
        F.sum(good).alias("good"),
        F.count_if(~_missing("evidence_id")).alias("valid_count"),
    ]


def field_counts(evidence: DataFrame) -> DataFrame:
    return evidence.groupBy("case_key").agg(*field_aggregates())


def time_order(evidence: DataFrame, run: int = 100_000) -> DataFrame:
    """Per case: parsable times, span in seconds and whether arrival order runs backwards.

    Order is checked inside runs of ``run`` arrival numbers and then between the (few) runs of a
    case, so that no task sorts a whole hot case.
    """
    timed = evidence.select(
        "case_key", "ord", micros(parse_any_ts(non_empty(F.col("timestamp")))).alias("us"),
        block_of("ord", run).alias("_run"),
    )
    # unreadable times are skipped by the aggregates, a filter would parse every time twice
    before = F.last("us", ignorenulls=True).over(
        Window.partitionBy("case_key", "_run").orderBy("ord").rowsBetween(
            Window.unboundedPreceding, -1))
    runs = timed.withColumn("_back", F.col("us") < before).groupBy("case_key", "_run").agg(
        F.count("us").alias("n_ts"), F.min("us").alias("lo"), F.max("us").alias("hi"),
        F.coalesce(F.bool_or("_back"), F.lit(False)).alias("back"),
    )
    seen = F.max("hi").over(
        Window.partitionBy("case_key").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_across", F.col("lo") < seen).groupBy("case_key").agg(
        F.sum("n_ts").alias("n_ts"),
        (F.bool_or("back") | F.coalesce(F.bool_or("_across"), F.lit(False))).alias("unordered"),
        ((F.max("hi") - F.min("lo")) / F.lit(1e6)).alias("span"),
    ).where(F.col("n_ts") > 0)


def evidence_ids(evidence: DataFrame) -> DataFrame:
    """Every non-empty evidence id of a case and how often it stands there.

    Whoever needs a case's ids takes them from here, so that one shuffle serves all.
    """
    # the null checks are those that a join on both keys would add, and so would tell two plans apart
    return evidence.where(
        ~_missing("evidence_id") & F.col("evidence_id").isNotNull() & F.col("case_key").isNotNull(),
    ).groupBy("case_key", "evidence_id").agg(F.count("*").alias("c"))


def duplicate_ids(evidence: DataFrame) -> DataFrame:
    """Per case: whether a non-empty evidence id repeats."""
    return evidence_ids(evidence).groupBy("case_key").agg((F.max("c") > 1).alias("duplicated"))


def measures(counts: DataFrame, evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """``counts`` (any per-case frame with the field aggregates) completed by time order and
    duplicates, one row per case."""
    base = counts
    if cases is not None:
        base = cases.select("case_key").join(counts, "case_key", "left")
    return (
        base.join(time_order(evidence), "case_key", "left")
        .join(duplicate_ids(evidence), "case_key", "left")
        .na.fill(0, ["n", "missing", "good", "valid_count", "n_ts"])
        .na.fill(False, ["unordered", "duplicated"])
    )


def _coverage() -> tuple[Column, Column]:
    total = F.col("n") * len(fixed.REQUIRED_FIELDS)
    rate = F.lit(1.0) - F.col("missing") / total
    lost = F.when(F.col("n") == 0, F.lit(50)).otherwise(
        F.floor((F.lit(1.0) - rate) * 40).cast("int"))
    issue = F.when(F.col("n") == 0, F.lit("无证据数据")).when(
        F.col("missing") > 0,
        F.concat(F.lit("字段覆盖度不足："), F.col("missing").cast("string"), F.lit("/"),
                 total.cast("string"), F.lit(" 个必需字段缺失")))
    return lost, issue


def _integrity() -> tuple[Column, Column]:
    slots = F.col("n") * (len(fixed.REQUIRED_FIELDS) + len(fixed.RECOMMENDED_FIELDS))
    rate = F.col("good") / slots
    low = (F.col("n") > 0) & (F.when(F.col("n") > 0, rate) < 0.5)
    issue = F.when(low, F.concat(F.lit("字段完整性不足：非空值比例 "), percent(rate)))
    return F.when(low, F.lit(15)).otherwise(F.lit(0)), issue


def _temporal() -> tuple[Column, Column, Column, Column]:
    few = F.col("n_ts") < 2
    back = ~few & F.col("unordered")
    short = ~few & (F.col("span") < 30)
    lost = sum((F.when(c, F.lit(10)).otherwise(F.lit(0)) for c in (few, back, short)), F.lit(0))
    return (
        lost,
        F.when(few, F.concat(F.lit("时间戳不足 2 条（当前 "), F.col("n_ts").cast("string"),
                             F.lit(" 条），无法评估时序一致性"))),
        F.when(back, F.lit("时间戳存在乱序")),
        F.when(short, F.concat(F.lit("时间跨度不足 30 秒（当前 "),
                               F.bround("span", 0).cast("bigint").cast("string"), F.lit(" 秒）"))),
    )


def _flag(failed: Column) -> Column:
    return F.when(failed, F.lit("failed")).otherwise(F.lit("passed"))


def level_columns(score: Column) -> tuple[Column, Column, Column]:
    """(level, allowed actions, blocked actions) for a score."""
    def pick(i: int) -> Column:
        out = None
        for entry in fixed.READINESS_LEVELS:
            v = entry[i]
            value = F.lit(v) if isinstance(v, str) else F.array(*map(F.lit, v)).cast("array<string>")
            cond = score >= entry[0]
            out = F.when(cond, value) if out is None else out.when(cond, value)
        return out

    return pick(1), pick(2), pick(3)


def score(measured: DataFrame) -> DataFrame:
    """Add score, level, actions, issues and check flags to the raw figures."""
    cov_lost, cov_issue = _coverage()
    int_lost, int_issue = _integrity()
    tmp_lost, few, back, short = _temporal()
    dup = F.col("duplicated")
    dup_issue = F.when(dup, F.lit("evidence_id 存在重复，影响溯源完整性"))
    scored = measured.withColumns({
        "score": F.greatest(
            F.lit(100) - cov_lost - int_lost - tmp_lost - F.when(dup, F.lit(10)).otherwise(F.lit(0)),
            F.lit(0)).cast("int"),
        "readiness_issues": compact(cov_issue, int_issue, few, back, short, dup_issue),
        "readiness_checks": F.struct(
            # an empty case names no coverage issue, so its flag stays "passed"
            _flag((F.col("n") > 0) & (F.col("missing") > 0)).alias("field_coverage"),
            _flag(int_issue.isNotNull()).alias("field_integrity"),
            _flag(F.coalesce(few, back, short).isNotNull()).alias("temporal_consistency"),
            _flag(dup).alias("uniqueness"),
        ),
    })
    level, allowed, blocked = level_columns(F.col("score"))
    return scored.withColumns({"level": level, "allowed_actions": allowed, "blocked_actions": blocked})


def readiness(evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Score, level, allowed and blocked actions, issues and per-check flags, one row per case."""
    return score(measures(field_counts(evidence), evidence, cases)).select(
        "case_key", "score", "level", F.col("n").alias("evidence_count"), "valid_count",
        F.col("readiness_issues").alias("issues"), "allowed_actions", "blocked_actions",
        F.col("readiness_checks").alias("checks"),
    )


def gate(scored: DataFrame, action: str) -> DataFrame:
    """Cases whose level allows ``action``."""
    return scored.where(F.array_contains("allowed_actions", action))
