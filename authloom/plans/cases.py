"""Case review: readiness, analysis and verification of all cases in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.text import non_empty
from authloom.operators import readiness, triage, verification

_PHASES = list(dict.fromkeys(phase for _, phase in fixed.PHASE_BANDS))


def profile(evidence: DataFrame) -> DataFrame:
    """Everything about a case that merges: field counts, phases and top rule.

    Two aggregation levels, first per case and rule, then per case, give all of it from one scan
    and combine on the map side, however large a single case is. The first level keeps numbers
    only, so it stays a hash aggregate.
    """
    severity = F.coalesce(F.col("severity").try_cast("int"), F.lit(0))
    staged = evidence.withColumn("_phase", triage.phase_of(severity, F.col("rule_id")))
    sums = ["n", "missing", "good", "valid_count"]
    mins = [f"phase_{i}" for i in range(len(_PHASES))]
    by_rule = staged.groupBy(
        "case_key", F.coalesce(non_empty(F.col("rule_id")), F.lit("unknown")).alias("rule"),
    ).agg(
        *readiness.field_aggregates(),
        F.min("ord").alias("first_ord"),
        *[F.min(F.when(F.col("_phase") == p, F.col("ord"))).alias(f"phase_{i}")
          for i, p in enumerate(_PHASES)],
    ).withColumnsRenamed({"rule": "rule_id"}).withColumn("cnt", F.col("n"))
    merged = by_rule.groupBy("case_key").agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.min(c).alias(c) for c in mins],
        F.max(triage.rule_rank()).alias("top"),
    )
    found = F.array_compact(F.array(*[
        F.when(F.col(f"phase_{i}").isNotNull(), F.struct(
            F.col(f"phase_{i}").alias("first_ord"), F.lit(p).alias("kill_chain_phase")))
        for i, p in enumerate(_PHASES)
    ]))
    return merged.select(
        "case_key", *sums,
        F.col("n").alias("total"),
        F.col("valid_count").alias("ref_count"),
        F.col("top.rule_id").alias("best_rule"),
        triage.progress_text(found).alias("progress"),
    )


def review(evidence: DataFrame, cases: DataFrame, replies: DataFrame | None = None,
           refs: DataFrame | None = None) -> DataFrame:
    """One reviewed row per case of ``cases``: readiness, analysis and verdict.

    ``evidence`` is read a few times with different column subsets, so it should be a stored table.
    ``replies`` are external verdict texts, ``refs`` the ids they cite. Without ``refs`` an analysis
    cites its own evidence, which cannot dangle. Cases without evidence carry each step's defaults
    into the next one.
    """
    rows = readiness.measures(profile(evidence), evidence, cases).na.fill(0, ["total", "ref_count"])
    rows = readiness.score(rows).withColumnRenamed("n", "evidence_count")
    rows = triage.conclude(triage.merge_replies(triage.judge(rows), replies))
    if refs is None:
        rows = rows.withColumn("ref_issue", F.lit(None).cast("string"))
    else:
        rows = rows.join(verification.check_refs(refs, evidence, most=None), "case_key", "left")
    rows = rows.join(verification.trace_checks(evidence, most=None), "case_key", "left")
    return verification.verdict(rows).select(
        "case_key", "evidence_count", "valid_count", "score", "level", "readiness_issues",
        "readiness_checks", "allowed_actions", "event_type", "priority", "confidence", "summary",
        "conclusion", "actions", "ref_count", "verified", "issues", "checks", "final_confidence",
        "final_conclusion",
    )
