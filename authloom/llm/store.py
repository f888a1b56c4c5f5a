"""Written tables that cut lineage: kept in the shared folder, safe against lost executors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from authloom.sources.scratch import shared_dir


ROWS = 250_000  # small rows of one file


class Store:
    """One folder of intermediate tables below the cluster's shared folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: str | None = None, compression: str | None = None,
             rows: int | None = None) -> DataFrame:
        """Write ``df`` once and read it back with the schema it was written with.

        ``rows`` is a bound on its rows, where one is known: then no more tasks write than it takes files.
        """
        path = f"{self.path}/{name}"
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // ROWS)))
        writer = df.write.mode("overwrite")
        if compression:
            writer = writer.option("compression", compression)
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Limit the rows of one Arrow batch, so that a Python task holds little text at a time.

    For results that run later: the limit stays with the session.
    """
    now = int(spark.conf.get(_BATCH))
    if now <= 0 or now > rows:
        spark.conf.set(_BATCH, str(rows))


def small_batches(rows: int):
    """The same limit for a function that runs all its Python stages before it returns."""

    def wrap(function):
        @functools.wraps(function)
        def run(df: DataFrame, *args, **named):
            spark = df.sparkSession
            now = spark.conf.get(_BATCH)
            bounded_batches(spark, rows)
            try:
                return function(df, *args, **named)
            finally:
                spark.conf.set(_BATCH, now)

        return run

    return wrap
