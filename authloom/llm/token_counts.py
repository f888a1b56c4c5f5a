"""Delta-maintained token-count rollups by source, language and tokenizer version.

A change log says which documents were inserted, deleted or counted anew. A batch of changes turns
into signed deltas, is summed per group, and is committed as one partition of the delta table; the
totals are the sum over committed batches. Committing a batch again replaces its partition by the
same rows, so a batch that is retried after a failure, or delivered twice, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom.llm.store import Store

GROUP = ["source", "lang", "tokenizer"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, batch long"


def signed(changes: DataFrame) -> DataFrame:
    """Changes as signed rows ``source, lang, tokenizer, docs, tokens``.

    ``changes`` has ``op`` (insert, delete, revise), ``doc_id, source, lang, tokenizer, tokens`` and, for a
    revision, ``old_tokens``. What is delivered again within its batch counts once: rows of the same
    ``change``, where there is such a column, else rows that are alike and have a document id. Rows without
    that name are changes of their own, whatever else they agree in. Null counts are 0; null sources,
    languages and tokenizers are groups of their own. Any other ``op`` raises an error when the batch is
    written.
    """
    sign = F.expr("""CASE op WHEN 'insert' THEN 1 WHEN 'delete' THEN -1 WHEN 'revise' THEN 0
                     ELSE raise_error('unknown change: ' || coalesce(op, 'null')) END""")
    name = "change" if "change" in changes.columns else "doc_id"
    columns = [*dict.fromkeys([name, "op", "doc_id", *GROUP, "tokens", "old_tokens"])]
    named = changes.where(F.col(name).isNotNull()).select(*columns)
    named = named.dropDuplicates([name]) if name == "change" else named.distinct()
    changes = named.unionByName(changes.where(F.col(name).isNull()).select(*columns))
    return changes.select(
        *GROUP, sign.cast("long").alias("docs"),
        F.expr("""CASE op WHEN 'insert' THEN coalesce(tokens, 0) WHEN 'delete' THEN -coalesce(tokens, 0)
                  WHEN 'revise' THEN coalesce(tokens, 0) - coalesce(old_tokens, 0) END""").cast("long").alias("tokens"))


class Rollup:
    """Totals kept as committed batches of group deltas in the shared folder."""

    def __init__(self, spark: SparkSession, store: Store | None = None) -> None:
        self.spark, self.store = spark, store or Store(spark, "rollup")
        self.path = f"{self.store.path}/deltas"

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Write the deltas of one batch as a whole; a repeated batch number replaces the earlier write."""
        deltas = signed(changes).groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        deltas.write.mode("overwrite").parquet(f"{self.path}/batch={int(batch)}")

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, docs, tokens`` over all committed batches; groups that came to nothing go.

        A log without any batch has no totals.
        """
        if not self.store.exists("deltas"):
            return self.spark.createDataFrame([], SCHEMA).drop("batch")
        deltas = self.spark.read.schema(SCHEMA).option("basePath", self.path).parquet(self.path)
        return (deltas.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
                .where("docs <> 0 OR tokens <> 0"))


def counted(docs: DataFrame, tokenizers: dict[str, str], texts: dict[str, Column]) -> DataFrame:
    """``doc_id, change, source, lang, tokenizer`` and one count per entry of ``texts``: a row per document and version.

    ``change`` is a name for each row, good once the result is written.

    ``tokenizers`` maps a version to a regular expression that matches one token; ``texts`` maps a
    count's name to the text it counts. All are counted in one pass; null texts have no tokens.
    """
    rows = F.array(*[
        F.struct(F.lit(version).alias("tokenizer"), *[
            F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("long").alias(name)
            for name, text in texts.items()])
        for version, pattern in tokenizers.items()])
    every = docs.select("doc_id", "source", "lang", F.inline(rows))
    return every.withColumn("change", F.monotonically_increasing_id())
