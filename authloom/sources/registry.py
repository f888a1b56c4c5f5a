"""Source and client registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom import schemas

_FIELDS = ["source_name", "source_type", "local_path", "format", "query_engine", "query_endpoint",
           "retention_days"]


def load_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry file (one object or a list, flat or with nested ``sources``), one row per source.

    Entries are in order of their files' names (``entry_file``) and of their places there (``entry_no``).
    """
    entries = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("entry_file"),
        F.posexplode(F.from_json("value", f"array<struct<{schemas.REGISTRY}>>")).alias("entry_no", "r"))
    return flatten_registry(entries.select("entry_file", "entry_no", "r.*"))


def parse_registry(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Same, for registry entries held as JSON text; keeps ``entry_no`` as registry order."""
    return flatten_registry(docs.select("entry_no", F.from_json(column, schemas.REGISTRY).alias("r"))
                            .select("entry_no", "r.*"))


def flatten_registry(entries: DataFrame) -> DataFrame:
    """One row per (node, source). A flat entry describes itself; nested ones are unfolded."""
    keep = [c for c in ("entry_file", "entry_no") if c in entries.columns]
    own = F.array(F.struct(*[F.col(f) for f in _FIELDS]))
    nested = F.transform(
        F.coalesce("sources", F.expr("array()").cast(entries.schema["sources"].dataType)),
        lambda s: F.struct(*[s[f].alias(f) for f in _FIELDS]))
    listed = F.when(F.col("source_name").isNotNull(), F.concat(own, nested)).otherwise(nested)
    return entries.select("node_id", *keep, F.posexplode(listed).alias("source_no", "s")).select(
        "node_id", *keep, "source_no", "s.*")


def first_entries(registry: DataFrame) -> DataFrame:
    """One row per (node, source): where a pair is listed twice, the first entry counts."""
    order = F.struct(*[c for c in ("entry_file", "entry_no", "source_no") if c in registry.columns])
    return registry.groupBy("node_id", "source_name").agg(
        *[F.min_by(F.struct(f), order)[f].alias(f) for f in _FIELDS if f != "source_name"])


def registry_lookup(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Requests with their source's path and format; ``error`` is set where none is registered."""
    hit = first_entries(registry).select(
        "node_id", F.col("source_name").alias("source"), "local_path", "format")
    error = (
        F.when(F.col("_hit").isNull(), F.lit("source not found"))
        .when(F.coalesce("local_path", F.lit("")) == "", F.lit("source has no path"))
    )
    known = hit.withColumn("_hit", F.lit(True))
    return requests.join(known, ["node_id", "source"], "left").withColumn(
        "error", error).drop("_hit")


def registry_checks(clients: DataFrame, registry: DataFrame) -> DataFrame:
    """Violations: client node without auth_log entry, repeated client id, node with two clients."""
    auth = registry.where(F.col("source_name") == "auth_log").select("node_id").distinct()
    unregistered = clients.join(auth, "node_id", "left_anti").select(
        F.lit("node_without_auth_log").alias("problem"), F.col("client_id").alias("subject"))

    def repeated(key: str, problem: str) -> DataFrame:
        return clients.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
            F.lit(problem).alias("problem"), F.col(key).alias("subject"))

    return unregistered.unionByName(repeated("client_id", "client_id_repeated")).unionByName(
        repeated("node_id", "node_has_several_clients"))
