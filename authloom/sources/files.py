"""Readers: auth logs, alert NDJSON, stored evidence, federated scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from authloom import schemas
from authloom.functions.sizes import literal_rows
from authloom.functions.text import unicode_trim

_CORRUPT = "_corrupt_record"


def _file_path() -> Column:
    return F.col("_metadata.file_path")


def _plain(path: Column) -> Column:
    """A file's path as it is registered: without scheme, and with blanks and signs for their codes.

    File metadata are encoded as an address is, but ``+`` stands for itself there.
    """
    bare = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    return F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)


def resolve(path: str, base: str | None = None) -> str:
    """A registered path; a relative one stands below ``base`` (of the registry file, as a rule)."""
    if path.startswith("/") or ":/" in path:
        return path
    if base is None:
        raise ValueError(f"relative path {path!r} needs a base folder")
    return f"{base.rstrip('/')}/{path.removeprefix('./')}"


def _root(path: str) -> str:
    """Path without scheme and closing slash; the root folder is the empty text."""
    return ("/" + path.split(":", 1)[-1].strip("/")).rstrip("/")


def tag_node(df: DataFrame, path: Column, nodes: dict[str, str]) -> DataFrame:
    """Add ``node_id``: the node whose registered file or folder holds the row's file; the deepest
    one where several do. ``nodes`` maps path to node id.

    One equi join per distinct depth of the registered paths, of which there are few, with the
    file's ancestor at that depth.
    """
    roots = {_root(p): n for p, n in nodes.items()}
    depths = sorted({r.count("/") for r in roots}, reverse=True)
    df = df.withColumn("_path", path)
    for d in depths:
        at_depth = literal_rows(
            df.sparkSession, [{"_key": r, f"_n{d}": n} for r, n in roots.items() if r.count("/") == d],
            f"_key string, _n{d} string")
        df = df.withColumn("_key", F.substring_index("_path", "/", d + 1)).join(
            at_depth, "_key", "left").drop("_key")
    return df.withColumn("node_id", F.coalesce(*[F.col(f"_n{d}") for d in depths])).drop(
        "_path", *[f"_n{d}" for d in depths])


def _known_node(path: str) -> Column:
    """The row's node; a file outside all registered paths ends the scan instead of passing as NULL."""
    return F.coalesce("node_id", F.raise_error(F.concat(F.lit("no node is registered for "), F.col(path))).cast("string"))


def read_auth_lines(spark: SparkSession, nodes: dict[str, str], base: str | None = None) -> DataFrame:
    """Non-blank lines of the auth logs of many nodes (``nodes``: path -> node id, relative to ``base``).

    Lines end at ``\\n`` only. Inside a file, ``block_start`` and ``read_order`` give the line order:
    the offset of the split, then the order in which the split is read.
    """
    nodes = {resolve(p, base): n for p, n in nodes.items()}
    lines = spark.read.option("lineSep", "\n").text(list(nodes)).select(
        _plain(_file_path()).alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("read_order"),
        "value",
    )
    tagged = tag_node(lines, F.col("file"), nodes).withColumn("node_id", _known_node("file"))
    return tagged.where(unicode_trim(F.col("value")) != "")


def number_lines(lines: DataFrame) -> DataFrame:
    """``line_no`` 1.. per file from split offset and read order.

    Rows are numbered inside their split and shifted by the lines of the file's earlier splits, so
    a task sorts one split at most.
    """
    from pyspark.sql import Window

    key = ["file", "block_start"]
    sizes = lines.groupBy(*key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("file").orderBy("block_start").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(*key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy(*key).orderBy("read_order"))
    return lines.withColumn("_rn", inside).join(offsets, key).select(
        "node_id", "file", (F.col("_off") + F.col("_rn")).alias("line_no"), "value")


def read_alerts(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(alerts, unreadable lines). A half-written line is set aside instead of failing the scan."""
    raw = spark.read.schema(f"{schemas.ALERT}, {_CORRUPT} string").json(path)
    # The reader cannot be asked for the corrupt column alone, so a data column takes part.
    broken = F.col(_CORRUPT).isNotNull() & (F.length(F.coalesce("id", F.lit(""))) >= 0)
    return (
        raw.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT),
        raw.where(broken).select(F.col(_CORRUPT).alias("line")),
    )


def read_evidence(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Stored evidence: JSON array files."""
    return spark.read.schema(schemas.EVIDENCE).option("multiLine", True).json(path)


_READERS = {
    "syslog": lambda spark, path: spark.read.option("lineSep", "\n").text(path),
    "json": lambda spark, path: spark.read.json(path),
    "parquet": lambda spark, path: spark.read.parquet(*path),
    "csv": lambda spark, path: spark.read.option("header", True).csv(path),
    "orc": lambda spark, path: spark.read.orc(path),
}


def scan_source(spark: SparkSession, entries: list[dict], source: str,
                nodes: list[str] | None = None, schema: str | None = None,
                base: str | None = None) -> DataFrame:
    """One logical source over all or some nodes, each read in its registered format.

    ``entries`` are registry rows (driver-side configuration, one per node and source). Pass
    ``schema`` for JSON and CSV sources to avoid inference. Entries of one format share one reader.
    Relative paths stand below ``base``.
    """
    by_format: dict[str, dict[str, str]] = {}
    for e in entries:
        if e["source_name"] == source and (nodes is None or e["node_id"] in nodes):
            by_format.setdefault(e.get("format") or "json", {})[resolve(e["local_path"], base)] = e["node_id"]
    if not by_format:
        raise ValueError(f"source {source!r} is not registered for these nodes")
    out = None
    for fmt, paths in sorted(by_format.items()):
        if schema and fmt in ("json", "csv"):
            reader = spark.read.schema(schema)
            df = reader.json(list(paths)) if fmt == "json" else reader.option("header", True).csv(list(paths))
        else:
            df = _READERS[fmt](spark, list(paths))
        part = tag_node(df.select("*", _plain(_file_path()).alias("_file")), F.col("_file"), paths).withColumn(
            "node_id", _known_node("_file")).drop("_file")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
