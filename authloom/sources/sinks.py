"""Typed evidence sink, result tables, latest run and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from authloom.functions.once import computed_once
from authloom.functions.sizes import literal_rows

# --- fixed values: stored time formats and the address shape ---------------------------------
TIME_FORMATS = {
    r"^[^.]{19}[+-]\d{4}$": "yyyy-MM-dd'T'HH:mm:ssZ",
    r"^[^.]{19}$": "yyyy-MM-dd'T'HH:mm:ss",
    r"^.{19}\.\d{3}[+-]\d{4}$": "yyyy-MM-dd'T'HH:mm:ss.SSSZ",
}
IPV4 = r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$"
IPV6 = r"^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"

TABLES = ["signals", "evidence", "readiness", "analysis", "verification", "reports"]


def stored_time(col: Column) -> Column:
    """Instant from one of the stored formats or epoch milliseconds, else NULL.

    A trailing Z counts as the offset +0000.
    """
    text = F.regexp_replace(col, "Z$", "+0000")
    out = F.when(col.rlike(r"^-?\d+$"), F.timestamp_millis(col.try_cast("bigint")))
    for shape, fmt in TIME_FORMATS.items():
        # only texts of the right shape reach a parser: a failing parse costs an exception
        out = out.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(fmt)))
    return out


def conform_evidence(evidence: DataFrame) -> DataFrame:
    """Evidence with enforced types and ``problem`` naming the first field that does not fit."""
    ip = F.col("src_ip")
    typed = evidence.withColumns({
        "event_time": stored_time(F.col("timestamp")),
        "severity_value": F.col("severity").try_cast("int"),
    })
    judged = typed.withColumn(
        "problem",
        F.when(F.col("timestamp").isNotNull() & F.col("event_time").isNull(), F.lit("timestamp"))
        .when(F.col("severity").isNotNull() & F.col("severity_value").isNull(), F.lit("severity"))
        .when(ip.isNotNull() & ~(ip.rlike(IPV4) | ip.rlike(IPV6)), F.lit("src_ip")),
    )
    return computed_once(judged, evidence.columns)


def split_valid(conformed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to store, rows that do not fit); a bad row never fails the load."""
    return (conformed.where(F.col("problem").isNull()).drop("problem"),
            conformed.where(F.col("problem").isNotNull()))


def bulk_counts(conformed: DataFrame) -> DataFrame:
    """Success and failure counts of a load, per source."""
    return conformed.groupBy("source").agg(
        F.count_if(F.col("problem").isNull()).alias("stored"),
        F.count_if(F.col("problem").isNotNull()).alias("failed"),
    )


def load_evidence(evidence: DataFrame, base: str, run: str) -> dict[str, int]:
    """Store what fits its types and, beside it, what doesn't; ``read, stored, failed`` are counted while writing.

    One pass over the evidence; a run that is repeated replaces its rows.
    """
    load = Observation()
    bad = F.col("problem").isNotNull()
    judged = conform_evidence(evidence).observe(
        load, F.count(F.lit(1)).alias("read"), F.count_if(~bad).alias("stored"), F.count_if(bad).alias("failed"))
    judged.withColumn("fits", ~bad).write.mode("overwrite").partitionBy("fits").parquet(f"{base}/run_id={run}")
    return {k: int(v) for k, v in load.get.items()}


_RUNS = "_runs"


def write_tables(results: dict[str, DataFrame], base: str, run: str, time_column: str = "at") -> dict[str, int]:
    """Write each result as one run of its table, by day of its time column, and commit the run.

    A run is a partition of every table, replaced when it is written again; its commit row, with the rows
    of each table counted while writing, comes last. Readers see committed runs only, so a load that
    failed half-way and was repeated counts once.
    """
    counts = {}
    for name, df in results.items():
        if name not in TABLES:
            raise ValueError(f"unknown table {name!r}")
        seen = Observation()
        (df.withColumn("dt", F.to_date(time_column))
         .observe(seen, F.count(F.lit(1)).alias("n"))
         # one file per day and task, also for a day that holds most rows
         .hint("rebalance", "dt")
         .write.mode("overwrite").partitionBy("dt").parquet(f"{base}/{name}/run_id={run}"))
        counts[name] = int(seen.get["n"])
    spark = next(iter(results.values())).sparkSession
    literal_rows(spark, [{"tables": counts}], "tables map<string,bigint>").write.mode("overwrite").parquet(
        f"{base}/{_RUNS}/run_id={run}")
    return counts


def runs(spark: SparkSession, base: str) -> DataFrame:
    """``tables, run_id`` of the committed runs."""
    return spark.read.schema("tables map<string,bigint>, run_id string").parquet(f"{base}/{_RUNS}")


def read_table(spark: SparkSession, base: str, name: str, latest: bool = False) -> DataFrame:
    """Rows of committed runs, or of the latest one (largest ``run_id``); runs are partitions and pruned."""
    rows = spark.read.parquet(f"{base}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    if latest:
        return rows.where(F.col("run_id") == runs(spark, base).select(F.max("run_id")).scalar())
    return rows.join(F.broadcast(runs(spark, base).select("run_id")), "run_id", "left_semi")


def latest_run(runs: DataFrame) -> DataFrame:
    """Rows of the most recent run (largest ``run_id``).

    The newest id is a scalar subquery, so a table partitioned by run is pruned to one partition. Of the
    tables that ``write_tables`` keeps, ``read_table(..., latest=True)`` gives the latest committed run.
    """
    newest = runs.select(F.max("run_id")).scalar()
    return runs.where(F.col("run_id") == newest)


GRAM = 3
BITS = 1 << 18  # of one file's index; a bucket of the bitmap functions has 32768


def _gram_bits(text: Column) -> Column:
    """Distinct bit numbers of all pieces of ``GRAM`` characters of a text in lower case."""
    low = F.lower(text)
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - (GRAM - 1), F.lit(1)))
    # numbers from 1, as the bitmap functions count
    bit = F.transform(places, lambda k: F.pmod(F.xxhash64(F.substring(low, k, F.lit(GRAM))), F.lit(BITS)) + 1)
    return F.when(F.length(low) >= GRAM, F.array_distinct(bit))


def write_text_index(spark: SparkSession, path: str, column: str, index: str) -> None:
    """``file, bucket, bits``: which pieces of text each file of a table has in a column, as hashed bitmaps.

    At most ``BITS / 8`` bytes (32 kB) a file, whatever its size; a task holds the distinct bits of its files, for
    the rows of every piece would have to be sorted before they become bitmaps.
    """
    rows = spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("file"), F.explode(_gram_bits(F.col(column))).alias("bit")).distinct()
    (rows.groupBy("file", F.bitmap_bucket_number("bit").alias("bucket"))
     .agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).write.mode("overwrite").parquet(index))


def files_with(spark: SparkSession, index: str, needle: str) -> DataFrame:
    """``file``: files whose index has all pieces of a text; others cannot hold it."""
    asked = spark.range(1).select(F.explode(_gram_bits(F.lit(needle))).alias("bit")).select(
        F.bitmap_bucket_number("bit").alias("bucket"), F.bitmap_bit_position("bit").alias("at"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    has = spark.read.parquet(index).join(F.broadcast(asked), "bucket").withColumn("byte", byte).where(
        F.expr("shiftright(byte, cast(at % 8 as int)) & 1 = 1"))
    n = asked.agg(F.count(F.lit(1))).scalar()
    return has.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("file")


def search_files(spark: SparkSession, path: str, index: str, column: str, needle: str, term: dict | None = None,
                 size: int = 10, order: list[str] | None = None) -> DataFrame:
    """``search`` over a table with a text index: only files that may hold the text are read.

    A text shorter than ``GRAM`` characters is searched for in all files.
    """
    if len(needle) < GRAM:
        return search(spark.read.parquet(path), term, (column, needle), size, order)
    # the names of files, which a reader lists on the driver anyway
    files = [r.file for r in files_with(spark, index, needle).collect()]
    table = spark.read.parquet(path)
    some = spark.read.schema(table.schema).option("basePath", path).parquet(*files) if files else table.limit(0)
    return search(some, term, (column, needle), size, order)


def search(df: DataFrame, term: dict | None = None, text: tuple[str, str] | None = None,
           size: int = 10, order: list[str] | None = None) -> DataFrame:
    """Rows with exact field values and, optionally, a column containing a text in any case."""
    out = df
    for name, value in (term or {}).items():
        out = out.where(F.col(name) == value)
    if text:
        name, needle = text
        out = out.where(F.contains(F.lower(name), F.lit(needle.lower())))
    return out.orderBy(*(order or ["evidence_id"])).limit(size)


