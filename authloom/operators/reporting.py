"""Report text per case.

A report is built as numbered parts: part 0 is the head, then one part per ``block`` evidence
rows, then the tail. A part has a bounded size however large the case is, and the parts of a case
in order are its whole report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions.numbers import block_of

# --- fixed values: report wording ------------------------------------------------------------
TITLE = "# 安全研判报告"
UNKNOWN = "未知"
ABSENT = "N/A"
CLOSING = (
    "本报告基于数据编织架构，通过边缘按需取证、标准化映射、AI研判与复核验证，"
    "形成完整可信的安全事件分析结果。"
)


def _text(col: Column, absent: str = ABSENT) -> Column:
    return F.coalesce(col.cast("string"), F.lit(absent))


def numbered(rows: DataFrame, run: int, order: list[str], largest: dict[str, Column] | None = None) -> DataFrame:
    """Rows with their position in the case, numbered inside runs of the first ``order`` column plus an offset.

    ``largest`` are columns to add: the largest value of an expression in the whole case.
    """
    largest = largest or {}
    runs = rows.withColumn("_run", block_of(order[0], run))
    sizes = runs.groupBy("case_key", "_run").agg(F.count("*").alias("_n"), *[F.max(c).alias(n) for n, c in largest.items()])
    case = Window.partitionBy("case_key")
    earlier = Window.partitionBy("case_key").orderBy("_run").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select("case_key", "_run",
                           F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"),
                           *[F.max(n).over(case).alias(n) for n in largest])
    inside = F.row_number().over(Window.partitionBy("case_key", "_run").orderBy(*order))
    return runs.withColumn("_rn", inside).join(offsets, ["case_key", "_run"]).withColumn(
        "position", F.col("_off") + F.col("_rn")).drop("_run", "_rn", "_off")


def numbered_evidence(evidence: DataFrame, run: int = 100_000, largest: dict[str, Column] | None = None) -> DataFrame:
    """Evidence with its position in the case."""
    return numbered(evidence, run, ["ord"], largest)


def evidence_block(position: Column) -> Column:
    """Text of one numbered evidence entry."""
    return F.concat(
        F.lit("\n【证据 "), position.cast("string"), F.lit("】\n- 时间："),
        _text(F.col("timestamp"), UNKNOWN),
        F.lit("\n- 规则ID："), _text(F.col("rule_id"), UNKNOWN),
        F.lit("\n- 描述："), _text(F.col("description"), UNKNOWN),
        F.lit("\n- 源IP："), _text(F.col("src_ip"), UNKNOWN),
        F.lit("\n- 主机："), _text(F.col("hostname"), UNKNOWN), F.lit("\n"),
    )


def _python_list(items: Column) -> Column:
    quoted = F.transform(items, lambda x: F.when(
        x.contains("'") & ~x.contains('"'), F.concat(F.lit('"'), x, F.lit('"')),
    ).otherwise(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("\\'")), F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def report_parts(reviewed: DataFrame, evidence: DataFrame, report_time: Column, block: int = 1000,
                 title: str = TITLE, largest: dict[str, Column] | None = None) -> DataFrame:
    """(case_key, part, text) for every reviewed case; the last part number is the tail's.

    ``largest`` are columns to add that ``reviewed`` has as well: the largest value of an expression over the
    case's evidence. They come with the numbering, so the texts needn't be joined to get them.
    """
    largest = largest or {}
    steps = F.coalesce(F.col("actions"), F.array().cast("array<string>"))
    head = F.concat(
        F.lit(f"\n{title}\n报告时间："), report_time,
        F.lit("\n\n## 1. 数据就绪度评估\n- 就绪度评分："), _text(F.col("score")),
        F.lit(" 分\n- 评估等级："), _text(F.col("level")),
        F.lit("\n- 有效证据数："), _text(F.col("valid_count")),
        F.lit("\n\n## 2. 安全证据（标准化）\n"),
    )
    tail = F.concat(
        F.lit("\n## 3. AI 研判结果\n- 研判结论："), _text(F.col("conclusion")),
        F.lit("\n- 置信度："), _text(F.col("confidence")),
        F.lit("\n\n## 4. 处置建议\n"),
        F.array_join(F.transform(steps, lambda a: F.concat(F.lit("- "), a, F.lit("\n"))), ""),
        F.lit("\n## 5. 复核结果（防AI幻觉）\n- 复核状态：**"),
        F.when(F.coalesce("verified", F.lit(False)), F.lit("通过")).otherwise(F.lit("未通过")),
        F.lit("**\n- 发现问题："),
        _python_list(F.coalesce("issues", F.array().cast("array<string>"))),
        F.lit("\n- 最终结论："), _text(F.col("final_conclusion")),
        F.lit("\n- 最终置信度："), _text(F.col("final_confidence")),
        F.lit(f"\n\n## 6. 总结\n{CLOSING}\n"),
    )
    last = block_of("_padded", block) + 1
    frame = reviewed.withColumn("_padded", F.col("evidence_count") + (block - 1)).select("case_key", *largest, F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("part"), head.alias("text")),
        F.struct(last.alias("part"), tail.alias("text")),
    )).alias("p")).select("case_key", "p.part", "p.text", *largest)
    blocks = numbered_evidence(evidence, largest=largest).withColumn("_before", F.col("position") - 1).withColumn(
        "part", block_of("_before", block) + 1)
    entries = F.array_sort(F.collect_list(F.struct(
        "position", evidence_block(F.col("position")).alias("entry"))))
    body = blocks.groupBy("case_key", "part").agg(
        F.array_join(F.transform(entries, lambda e: e["entry"]), "").alias("text"), *[F.max(n).alias(n) for n in largest])
    return frame.unionByName(body)
