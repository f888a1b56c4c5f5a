"""Deterministic triage, kill-chain mapping and action advice per case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.fields import parse_replies
from authloom.functions.text import lookup, non_empty


def rule_histogram(evidence: DataFrame) -> DataFrame:
    """Rows per case and rule, with the arrival number of the rule's first row."""
    return evidence.groupBy(
        "case_key", F.coalesce(non_empty(F.col("rule_id")), F.lit("unknown")).alias("rule_id")
    ).agg(F.count("*").alias("cnt"), F.min("ord").alias("first_ord"))


def rule_rank() -> Column:
    """Order of the rules of a histogram: priority, then count, then earliest; NULL if unknown."""
    priority = lookup(F.col("rule_id"), fixed.TRIAGE_PRIORITY)
    return F.when(priority.isNotNull(), F.struct(
        lookup(priority, fixed.PRIORITY_RANK).alias("rank"),
        "cnt",
        (-F.col("first_ord")).alias("early"),
        "rule_id",
    ))


def best_rule(histogram: DataFrame) -> DataFrame:
    """Per case: total rows and its top rule, as a max over an ordered struct (which combines
    before the shuffle)."""
    return (
        histogram.groupBy("case_key")
        .agg(F.sum("cnt").alias("total"), F.max(rule_rank()).alias("top"))
        .select("case_key", "total", F.col("top.rule_id").alias("best_rule"))
    )


def _count_confidence(total: Column) -> Column:
    return F.when(total >= 5, F.lit("high")).when(total >= 3, F.lit("medium")).otherwise(F.lit("low"))


def judge(best: DataFrame) -> DataFrame:
    """Add event type, priority, confidence and summary to rows with total and best_rule."""
    known = F.col("best_rule").isNotNull()
    total = F.col("total")
    n = total.cast("string")
    typed = best.withColumn("event_type", F.coalesce(
        lookup(F.col("best_rule"), fixed.TRIAGE_EVENT_TYPE), F.lit("unknown")))
    return typed.withColumns({
        "priority": F.when(known, lookup(F.col("best_rule"), fixed.TRIAGE_PRIORITY))
        .when(total >= 5, F.lit("medium")).otherwise(F.lit("low")),
        "confidence": F.when(known, _count_confidence(total)).otherwise(F.lit("low")),
        "summary": F.when(known, F.concat(
            F.lit(fixed.SUMMARY_TYPED[0]), n, F.lit(fixed.SUMMARY_TYPED[1]), F.col("event_type"),
            F.lit(fixed.SUMMARY_TYPED[2]), F.col("best_rule"), F.lit(fixed.SUMMARY_TYPED[3])))
        .when(total > 0, F.concat(F.lit(fixed.SUMMARY_UNTYPED[0]), n, F.lit(fixed.SUMMARY_UNTYPED[1])))
        .otherwise(F.lit(fixed.SUMMARY_EMPTY)),
    })


def triage(evidence: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Event type, priority, confidence and summary per case."""
    best = best_rule(rule_histogram(evidence))
    if cases is not None:
        best = cases.select("case_key").join(best, "case_key", "left").na.fill(0, ["total"])
    return judge(best)


def phase_of(severity: Column, rule_id: Column) -> Column:
    out = None
    for top, phase in fixed.PHASE_BANDS:
        cond = severity <= top
        out = F.when(cond, F.lit(phase)) if out is None else out.when(cond, F.lit(phase))
    return out.otherwise(lookup(rule_id, fixed.PHASE_BY_RULE, fixed.PHASE_DEFAULT))


def phase_members(evidence: DataFrame) -> DataFrame:
    """Each evidence row with its kill-chain phase (long form of the ids per phase)."""
    severity = F.coalesce(F.col("severity").try_cast("int"), F.lit(0))
    return evidence.select(
        "case_key", "ord", "evidence_id",
        phase_of(severity, F.col("rule_id")).alias("kill_chain_phase"),
        F.coalesce(
            non_empty(F.col("description")),
            F.concat(F.lit(fixed.PHASE_DESCRIPTION[0]), F.coalesce("rule_id", F.lit("")), F.lit(fixed.PHASE_DESCRIPTION[1])),
        ).alias("description"),
    )


def kill_chain(evidence: DataFrame) -> DataFrame:
    """Phases per case with row count, first arrival and the first row's description."""
    return phase_members(evidence).groupBy("case_key", "kill_chain_phase").agg(
        F.count("*").alias("evidence_count"),
        F.min("ord").alias("first_ord"),
        F.min_by("description", "ord").alias("description"),
    )


def progress_text(phases: Column) -> Column:
    """Progress text from an array of (first_ord, kill_chain_phase) structs."""
    names = F.transform(F.array_sort(phases), lambda p: p["kill_chain_phase"])
    return F.concat(F.lit(fixed.PROGRESS), F.array_join(names, ", "))


def chain_progress(chain: DataFrame) -> DataFrame:
    """One progress text per case; a case has at most as many phases as there are bands."""
    return chain.groupBy("case_key").agg(progress_text(
        F.collect_list(F.struct("first_ord", "kill_chain_phase"))).alias("progress"))


def actions_for(event_type: Column) -> Column:
    """Advice list for an event type, the one for unknown types otherwise."""
    out = F  # the first when() opens the chain
    for kind, steps in fixed.ACTIONS.items():
        out = out.when(event_type == kind, F.array(*map(F.lit, steps)))
    return out.otherwise(F.array(*map(F.lit, fixed.ACTIONS["unknown"])))


def evidence_refs(evidence: DataFrame) -> DataFrame:
    """Evidence ids a case's analysis cites, one row each."""
    return evidence.where(non_empty(F.col("evidence_id")).isNotNull()).select(
        "case_key", "ord", "evidence_id")


def merge_replies(triaged: DataFrame, replies: DataFrame | None) -> DataFrame:
    """Prefer a parsed external verdict (column ``reply``, one row per case), field by field with
    defaults; cases without a readable one keep the deterministic result."""
    if replies is None:
        return triaged.withColumns({
            "reply_progress": F.lit(None).cast("string"),
            "actions": actions_for(F.col("event_type")),
        })
    v = F.col("_v")
    has = v.isNotNull() & (F.col("total") > 0)
    parsed = parse_replies(replies.select("case_key", "reply")).withColumnRenamed("verdict", "_v")
    none = F.array().cast("array<string>")

    def choose(name: str, default: str) -> Column:
        return F.when(has, F.coalesce(v[name], F.lit(default))).otherwise(F.col(name))

    merged = triaged.join(parsed, "case_key", "left").withColumns({
        "event_type": choose("event_type", "unknown"),
        "priority": choose("priority", "medium"),
        "confidence": choose("confidence", "medium"),
        "summary": choose("summary", fixed.REPLY_SUMMARY),
        "reply_progress": F.when(has, F.coalesce(v["progress"], F.lit(fixed.REPLY_PROGRESS))),
    })
    return merged.withColumn(
        "actions",
        F.when(v.isNotNull(), F.coalesce(v["suggested_actions"], none))
        .otherwise(actions_for(F.col("event_type"))),
    ).drop("_v")


def conclude(merged: DataFrame) -> DataFrame:
    """Add the conclusion to rows with summary, progress and reply_progress."""
    status = F.coalesce("reply_progress", "progress", F.lit(fixed.NO_PROGRESS))
    return merged.withColumns({
        "conclusion": F.concat("summary", F.lit(fixed.STATUS), status),
        "ref_count": F.coalesce("ref_count", F.lit(0)),
    })


def analysis(evidence: DataFrame, cases: DataFrame | None = None,
             replies: DataFrame | None = None) -> DataFrame:
    """One analysis row per case. Cited ids stay in :func:`evidence_refs`, their number is here."""
    judged = merge_replies(triage(evidence, cases), replies)
    progress = chain_progress(kill_chain(evidence))
    refs = evidence_refs(evidence).groupBy("case_key").agg(F.count("*").alias("ref_count"))
    return conclude(
        judged.join(progress, "case_key", "left").join(refs, "case_key", "left")
    ).select("case_key", "event_type", "priority", "confidence", "summary", "conclusion", "actions",
             "ref_count")


FAILED_ANALYSIS = {
    "summary": fixed.FAILED_SUMMARY,
    "conclusion": fixed.FAILED_CONCLUSION,
    "confidence": fixed.CONFIDENCE_LOW,
    "actions": fixed.FAILED_ACTIONS,
    "event_type": "unknown",
    "priority": "medium",
}


def analysis_or_default(cases: DataFrame, analysed: DataFrame) -> DataFrame:
    """Analysis for every case; a case whose analysis is missing gets the hand-over row."""
    d = FAILED_ANALYSIS
    out = cases.select("case_key").join(analysed, "case_key", "left")
    for name in ("summary", "conclusion", "confidence", "event_type", "priority"):
        out = out.withColumn(name, F.coalesce(name, F.lit(d[name])))
    return out.withColumns({
        "actions": F.coalesce("actions", F.array(*map(F.lit, d["actions"]))),
        "ref_count": F.coalesce("ref_count", F.lit(0)),
    })


def evidence_digest(evidence: DataFrame, rows: int = 20) -> DataFrame:
    """First ``rows`` rows per case as one text (the size limit of a prompt)."""
    w = Window.partitionBy("case_key").orderBy("ord")

    def show(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    line = F.concat(
        F.lit("["), show("evidence_id"), F.lit("] time="), show("timestamp"),
        F.lit(" rule="), show("rule_id"), F.lit(" severity="), show("severity"),
        F.lit(" src_ip="), show("src_ip"), F.lit(" host="), show("hostname"),
        F.lit(" desc="), show("description"),
    )
    top = evidence.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= rows)
    ordered = F.array_sort(F.collect_list(F.struct("_rn", line.alias("line"))))
    return top.groupBy("case_key").agg(
        F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("digest"))
