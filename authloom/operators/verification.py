"""Checks of an analysis against its evidence, per case.

Lists that could grow with a case are kept as rows (dangling references, lineage status) and as numbered
parts of a fixed number of values. An issue text of a review names every value; one that is asked for with
``most`` names that many, and says how many values and parts there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.numbers import block_of
from authloom.functions.text import compact, non_empty
from authloom.operators.readiness import evidence_ids
from authloom.operators.reporting import numbered

def _blank(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) == ""


LISTED = 1000  # values of one part


def _quoted(items: Column) -> Column:
    return F.concat(F.lit("'"), F.array_join(F.transform(items, lambda x: x["_v"]), "', '"), F.lit("'"))


def _listing(df: DataFrame, value: str, order: list[str], most: int | None, run: int = 100_000) -> DataFrame:
    """``case_key, n, listed``: how many values a case has, and all of them in order, or the first ``most``.

    All values are listed inside runs of the first order column, in as many tasks as there are runs; one task
    puts the texts of a case together and holds no more than its text. Of the first ones only these go to one
    task; values beyond them are counted where they are.
    """
    items = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    if most is None:
        runs = df.where(F.col("case_key").isNotNull()).withColumn("_run", block_of(order[0], run)).groupBy(
            "case_key", "_run").agg(F.count(F.lit(1)).alias("n"), items.alias("_i"))
        texts = F.array_sort(F.collect_list(F.struct("_run", _quoted(F.col("_i")).alias("_t"))))
        return runs.groupBy("case_key").agg(F.sum("n").alias("n"), texts.alias("_i")).select(
            "case_key", "n", F.array_join(F.transform("_i", lambda x: x["_t"]), ", ").alias("listed"))
    rank = F.row_number().over(Window.partitionBy("case_key").orderBy(*order))
    first = df.withColumn("_rank", rank).where(F.col("_rank") <= most).groupBy("case_key").agg(items.alias("_i"))
    counts = df.groupBy("case_key").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(first.select("case_key", _quoted(F.col("_i")).alias("listed")), "case_key")


def _beyond(most: int | None) -> Column:
    """What follows a listing that is not the whole."""
    if most is None:
        return F.lit("")
    return F.when(F.col("n") > most, F.concat(
        F.lit("（第 1 部分，共 "), F.expr(f"(n + {most - 1}) div {most}").cast("string"), F.lit(" 部分，"),
        F.col("n").cast("string"), F.lit(" 项）"))).otherwise("")


def _parts(df: DataFrame, value: str, order: list[str], most: int, run: int) -> DataFrame:
    """``case_key, part, n, listed``: all values of a case in numbered parts of ``most``.

    Positions are counted inside runs of the first order column and shifted by run totals, so a part is
    all that one task has to hold.
    """
    placed = numbered(df, run, order).withColumn("part", F.expr(f"cast((position - 1) div {most} + 1 as bigint)"))
    items = F.array_sort(F.collect_list(F.struct("position", F.col(value).alias("_v"))))
    return placed.groupBy("case_key", "part").agg(F.count(F.lit(1)).alias("n"), items.alias("_i")).select(
        "case_key", "part", "n", _quoted(F.col("_i")).alias("listed"))


def dangling_refs(refs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Cited evidence ids that the case does not contain (``refs``: case_key, ord, evidence_id)."""
    cited = refs.where(~_blank("evidence_id"))
    # the count stays in the plan, so that the shuffle is the one that finds repeated ids
    have = evidence_ids(evidence).where("c > 0").select("case_key", "evidence_id")
    return cited.join(have, ["case_key", "evidence_id"], "left_anti").select(
        "case_key", "ord", "evidence_id")


def check_refs(refs: DataFrame, evidence: DataFrame, most: int | None = LISTED) -> DataFrame:
    """Issue per case that cites unknown ids; without ``most`` it names all of them."""
    found = _listing(dangling_refs(refs, evidence), "evidence_id", ["ord", "evidence_id"], most)
    return found.select("case_key", F.concat(
        F.lit(fixed.UNKNOWN_REFS), "listed", F.lit("]"), _beyond(most)).alias("ref_issue"))


def dangling_parts(refs: DataFrame, evidence: DataFrame, most: int = LISTED, run: int = 100_000) -> DataFrame:
    """All unknown ids a case cites, in numbered parts: ``case_key, part, n, listed``."""
    return _parts(dangling_refs(refs, evidence), "evidence_id", ["ord", "evidence_id"], most, run)


def _named() -> Column:
    return F.concat(F.lit(fixed.ONE_EVIDENCE), F.coalesce("evidence_id", F.lit("None")))


def _raw_issue() -> Column:
    return F.when(_blank("raw_ref"), F.concat(_named(), F.lit(fixed.RAW_REF_MISSING))).when(
        ~F.col("raw_ref").contains("#") & ~F.col("raw_ref").contains("/"),
        F.concat(_named(), F.lit(fixed.RAW_REF_INVALID), F.col("raw_ref")))


def _lineage_issue() -> Column:
    return F.when(_blank("lineage_id"), F.concat(_named(), F.lit(fixed.LINEAGE_MISSING))).when(
        ~F.col("lineage_id").contains(":"),
        F.concat(_named(), F.lit(fixed.LINEAGE_INVALID), F.col("lineage_id")))


def trace_checks(evidence: DataFrame, most: int | None = LISTED) -> DataFrame:
    """Per case with a defect: ``raw_issue`` and ``lineage_issue`` of the first row whose raw
    reference or lineage id is missing or malformed, and ``query_issue`` if its evidence stems from
    more than one query, which names the first ``most`` of them, or all.

    One scan: rows are first combined per case and query, of which a case has few.
    """
    raw, lineage = _raw_issue(), _lineage_issue()

    def first(issue: Column) -> Column:
        return F.min(F.when(issue.isNotNull(), F.struct("ord", issue.alias("issue"))))

    per_query = evidence.groupBy("case_key", non_empty(F.col("query_id")).alias("query_id")).agg(
        first(raw).alias("raw"), first(lineage).alias("lineage"))
    # in one pass, so that the evidence is scanned once: a task streams the sorted queries of a case and
    # holds the first ones; the whole text holds all
    listed = F.struct(F.col("query_id").alias("_v"))
    if most is not None:
        rank = F.row_number().over(Window.partitionBy("case_key").orderBy(F.col("query_id").asc_nulls_last()))
        per_query, listed = per_query.withColumn("_rank", rank), F.when(F.col("_rank") <= most, listed)
    ids = F.array_sort(F.collect_list(listed))
    named = F.concat(F.lit(fixed.SEVERAL_QUERIES), _quoted(F.col("_i")), F.lit("}"), _beyond(most))
    return per_query.groupBy("case_key").agg(
        F.min("raw")["issue"].alias("raw_issue"), F.min("lineage")["issue"].alias("lineage_issue"),
        F.filter(ids, lambda x: x["_v"].isNotNull()).alias("_i"), F.count("query_id").alias("n"),
    ).select("case_key", "raw_issue", "lineage_issue", F.when(F.col("n") > 1, named).alias("query_issue")).where(
        "raw_issue IS NOT NULL OR lineage_issue IS NOT NULL OR query_issue IS NOT NULL")


def check_raw_ref(evidence: DataFrame) -> DataFrame:
    return trace_checks(evidence).where("raw_issue IS NOT NULL").select("case_key", "raw_issue")


def check_lineage(evidence: DataFrame) -> DataFrame:
    return trace_checks(evidence).where("lineage_issue IS NOT NULL").select("case_key", "lineage_issue")


def check_query_id(evidence: DataFrame) -> DataFrame:
    return trace_checks(evidence, most=None).where("query_issue IS NOT NULL").select("case_key", "query_issue")


def _lineage_status() -> Column:
    return F.when(_blank("lineage_id"), F.lit("missing")).when(
        ~F.col("lineage_id").contains(":"), F.lit("invalid_format")).otherwise(F.lit("valid"))


def lineage_status(evidence: DataFrame) -> DataFrame:
    """Status per evidence id, up to and including the first bad row (checking stops there)."""
    stop = evidence.where(_lineage_status() != "valid").groupBy("case_key").agg(
        F.min("ord").alias("bad_ord"))
    seen = evidence.join(stop, "case_key", "left").where(
        F.col("bad_ord").isNull() | (F.col("ord") <= F.col("bad_ord")))
    return seen.groupBy("case_key", F.coalesce("evidence_id", F.lit("None")).alias("evidence_id")).agg(
        F.max_by(_lineage_status(), "ord").alias("status"))


def conclusion_issues(conclusion: Column, evidence_count: Column, score: Column) -> Column:
    """Array of issues: absolute wording, too much said on little evidence, low readiness."""
    text = F.coalesce(conclusion, F.lit(""))
    wording = [
        F.when(text.contains(p), F.lit(fixed.FORBIDDEN_WORDING.format(p)))
        for p in fixed.FORBIDDEN_PHRASES
    ]
    thin = F.when(
        (evidence_count < 3) & (F.char_length(text) > 10),
        F.concat(F.lit(fixed.THIN_EVIDENCE[0]), evidence_count.cast("string"),
                 F.lit(fixed.THIN_EVIDENCE[1])))
    gated = F.when(
        (score < 60) & (evidence_count >= 3),
        F.concat(F.lit(fixed.LOW_READINESS[0]), score.cast("string"), F.lit(fixed.LOW_READINESS[1])))
    return compact(*wording, thin, gated)


def verdict(rows: DataFrame) -> DataFrame:
    """Add issues, check flags, overall verdict, final confidence and final conclusion.

    ``rows`` carries conclusion, evidence_count, score and the four issue texts (NULL = passed).
    """
    found = ["ref_issue", "raw_issue", "query_issue", "lineage_issue"]

    def flag(failed: Column) -> Column:
        return F.when(failed, F.lit("failed")).otherwise(F.lit("passed"))

    staged = rows.withColumn(
        "_c", conclusion_issues(F.col("conclusion"), F.col("evidence_count"), F.col("score")),
    ).withColumn("issues", F.concat(compact(*[F.col(c) for c in found]), F.col("_c")))
    ok = F.size("issues") == 0
    names = ["evidence_ref", "raw_ref", "query_id", "lineage_id"]
    return staged.withColumns({
        "verified": ok,
        "checks": F.struct(
            *[flag(F.col(c).isNotNull()).alias(n) for c, n in zip(found, names)],
            flag(F.size("_c") > 0).alias("conclusion"),
        ),
        "final_confidence": F.when(ok & (F.col("evidence_count") >= 5), F.lit(fixed.CONFIDENCE_HIGH))
        .when(ok, F.lit(fixed.CONFIDENCE_MEDIUM)).otherwise(F.lit(fixed.CONFIDENCE_LOW)),
        "final_conclusion": F.when(ok, F.coalesce("conclusion", F.lit("")))
        .otherwise(F.lit(fixed.UNVERIFIED_CONCLUSION)),
    }).drop("_c")


def verify(analysed: DataFrame, scored: DataFrame, evidence: DataFrame,
           refs: DataFrame) -> DataFrame:
    """All five checks and the overall verdict from separately stored results.

    ``refs`` lists every evidence id the analysis cites (its references and its timeline).
    """
    joined = (
        analysed.select("case_key", "conclusion")
        .join(scored.select("case_key", "score", "evidence_count"), "case_key", "left")
        .na.fill(0, ["score", "evidence_count"])
        .join(check_refs(refs, evidence, most=None), "case_key", "left")
        .join(trace_checks(evidence, most=None), "case_key", "left")
    )
    return verdict(joined).select(
        "case_key", "verified", "issues", "checks", "evidence_count",
        F.col("score").alias("readiness_score"), "final_confidence", "final_conclusion")
