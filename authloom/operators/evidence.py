"""Evidence retrieval for many requests at once, evidence rows, lineage and tamper checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.functions.text import non_empty, short_hash
from authloom.operators.requests import node_targeting

CONTENT = ["timestamp", "hostname", "process", "pid", "src_ip", "src_port", "dst_user",
           "log_type", "message", "raw_line"]
# filters of a request that ask for equality; one that is absent or empty asks for nothing
_OPTIONAL = ["src_ip", "process", "log_type", "dst_user"]
_SALTS = 64
_PLACES = 32_768  # bits that bitmap_construct_agg has


def _wanted(requests: DataFrame, nodes: DataFrame | None, equal: list[str]) -> DataFrame:
    """query_id, _limit (NULL: all), _since, and the key that a request asks for.

    The key is its node, which filters are set (``shape``, one bit each) and their values.
    """
    if nodes is not None:
        requests = node_targeting(requests, nodes)
    have = requests.schema["filters"].dataType.fieldNames()
    own = F.coalesce(F.col("limit").cast("long") if "limit" in requests.columns else F.lit(None),
                     F.lit(fixed.REQUEST_LIMIT))
    since = F.col("filters.since") if "since" in have else F.lit(None).cast("timestamp_ntz")
    values = [non_empty(F.col(f"filters.{c}")) if c in have else F.lit(None).cast("string") for c in equal]
    shape = sum((F.when(v.isNotNull(), 1 << i).otherwise(0) for i, v in enumerate(values)), F.lit(0))
    return requests.select(
        "query_id", F.when(own > 0, own).alias("_limit"), since.alias("_since"),
        F.struct(F.col("node_id"), shape.alias("shape"), *[v.alias(f"f{i}") for i, v in enumerate(values)])
        .alias("_key"))


def _everywhere(rows: DataFrame) -> DataFrame:
    """Rows once for every ``_salt``.

    A join with the numbers, for the planner knows how a join grows. It takes an explode to be as small as its
    input, and would broadcast it through the driver.
    """
    return rows.crossJoin(F.broadcast(rows.sparkSession.range(_SALTS).select(F.col("id").cast("int").alias("_salt"))))


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(_PLACES))


def _asked(wanted: DataFrame) -> Column:
    """One struct: the shapes that requests have, and for each place whether some request's key falls there.

    Bounded however many requests there are: at most 2 ** filters numbers, and as many booleans as there are places.
    """
    known = wanted.select(F.collect_set("_key.shape").alias("shapes"), F.bitmap_construct_agg(_place("_key")).alias("bits"))
    return known.select(F.struct("shapes", F.expr(
        f"""transform(sequence(0, {_PLACES - 1}), i -> (shiftright(cast(conv(hex(substring(
            bits, cast(i div 8 AS int) + 1, 1)), 16, 10) AS int), i % 8) & 1) = 1)""").alias("places"))).scalar()


def _answers(wanted: DataFrame, rows: DataFrame, equal: list[Column], order: list[Column]) -> DataFrame:
    """(query_id, rank, columns of ``rows``): the first rows of each request by ``order``.

    The rows are scanned once. A row stands under the shapes that requests have (one explode), and
    goes on only under keys that some request asks for. Requests for one key share its rows: the
    first ones are ranked once, as many as the largest limit asked of the key, in two levels, so that
    a busy key is cut in many tasks before its remainder meets in one. Keys asked for without a limit
    keep all rows, unranked and spread over the same tasks.
    """
    questions = wanted.groupBy("_key").agg(
        F.max("_limit").alias("_most"), F.bool_or(F.col("_limit").isNull()).alias("_all"))
    known = _asked(wanted)

    def key(mask: int) -> Column:
        return F.struct(F.col("node_id"), F.lit(mask).alias("shape"), *[
            (c if mask >> i & 1 else F.lit(None).cast("string")).alias(f"f{i}") for i, c in enumerate(equal)])

    def fits(mask: int) -> Column:
        # a shape that asks for a value the row lacks can match no request
        out = F.array_contains(F.col("_shapes"), mask)
        for i, c in enumerate(equal):
            if mask >> i & 1:
                out = out & c.isNotNull()
        return out

    keys = F.array_compact(F.array(*[F.when(fits(m), key(m)) for m in range(1 << len(equal))]))
    # most keys of a row no request asks for; a look at their places leaves these out before anything is shuffled, and the
    # join judges the rest. A question stands in every part of its key, so that a busy key is spread from the first join on
    visits = (rows.withColumn("_shapes", known["shapes"]).withColumn("_key", F.explode(keys)).drop("_shapes")
              .where(F.get(known["places"], _place("_key").cast("int")))
              .withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)).cast("int"))
              .join(_everywhere(questions), ["_key", "_salt"]))
    # a key may be asked for both ways
    ways = F.array_compact(F.array(F.when(F.col("_most").isNotNull(), F.lit("first")), F.when(F.col("_all"), F.lit("all"))))
    visits = visits.withColumn("_way", F.explode(ways))
    ranked = F.col("_way") == "first"

    def cut(df: DataFrame, *keys: Column | str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("rank", F.when(ranked, rank)).where(~ranked | (F.col("rank") <= F.col("_most")))

    found = cut(cut(visits, "_key", "_way", "_salt"), "_key", "_way", F.when(~ranked, F.col("_salt")))
    # what all rows of a key go to stands in every part of the key, so that its rows stay spread
    found = found.withColumn("_salt", F.when(ranked, 0).otherwise(F.col("_salt")))
    whole = F.col("_limit").isNull()
    mine = wanted.where(~whole).withColumn("_salt", F.lit(0)).withColumn("_way", F.lit("first")).unionByName(
        _everywhere(wanted.where(whole)).withColumn("_way", F.lit("all")))
    # a lower time bound only cuts the old end of newest-first rows, so ranks stay what they are
    late = F.col("_since").isNull() | (F.col("timestamp") >= F.col("_since"))
    # a row beside all its requests, then the next row: in a file of columns that takes a tenth of the bytes of the other
    # order, and what a task holds of a key is its requests
    return found.drop("_most", "_all").join(mine, ["_key", "_way", "_salt"]).where(
        (F.col("_limit").isNull() | (F.col("rank") <= F.col("_limit"))) & late).select("query_id", "rank", *rows.columns)


def retrieve_evidence(requests: DataFrame, events: DataFrame, nodes: DataFrame | None = None,
                      hashed: bool = False) -> DataFrame:
    """Newest events for each auth_log request: query_id, rank and the event's columns.

    With ``hashed`` also their content ``hash``, found once for an event however many requests it answers.

    Every request has its own limit: absent means 20, zero or less means all (their rank is NULL).
    Filters that are absent or empty are ignored.
    """
    wanted = _wanted(requests.where(F.col("source") == "auth_log"), nodes, _OPTIONAL)
    if hashed:
        events = events.withColumn("hash", content_hash())
    return _answers(wanted, events, [F.col(c) for c in _OPTIONAL], [F.desc("timestamp"), F.desc("id")])


def content_hash() -> Column:
    return short_hash(*[F.col(c) for c in CONTENT])


def auth_evidence(retrieved: DataFrame, minimize: bool = False) -> DataFrame:
    """Evidence rows for retrieved events (missing text becomes ''; ids and hashes repeatable).

    ``minimize`` leaves the message and raw line at the edge.
    """
    ts = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    ip = F.coalesce("src_ip", F.lit(""))
    digest = F.col("hash") if "hash" in retrieved.columns else content_hash()
    out = retrieved.select(
        F.concat(F.lit("ev-"), short_hash(F.col("query_id"), F.col("node_id"), F.col("id")))
        .alias("evidence_id"),
        "query_id", "node_id", "rank",
        F.lit("auth_log").alias("source"),
        F.concat("node_id", F.lit("/auth_log#"), ip, F.lit("#"), ts).alias("raw_ref"),
        F.concat("query_id", F.lit(":"), digest).alias("lineage_id"),
        digest.alias("hash"),
        ts.alias("timestamp"),
        F.coalesce("hostname", F.lit("")).alias("hostname"),
        F.coalesce("process", F.lit("")).alias("process"),
        "pid", ip.alias("src_ip"), "src_port", "dst_user",
        F.coalesce("log_type", F.lit("")).alias("log_type"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce("raw_line", F.lit("")).alias("raw_line"),
    )
    return out.drop("message", "raw_line") if minimize else out


def retrieve_alerts(requests: DataFrame, alerts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """First alerts by time for each alert request, by rule id if it names one; limits as above.

    ``alerts`` carries node_id.
    """
    wanted = _wanted(requests.where(F.col("source") != "auth_log"), nodes, ["rule_id"]).withColumn(
        "_since", F.lit(None).cast("string"))
    return _answers(wanted, alerts, [F.col("rule.id")], [F.asc("timestamp"), F.asc("id")]).select(
        "query_id", *alerts.columns)


def _alert_hash() -> Column:
    return short_hash(F.col("timestamp"), F.col("rule.id"), F.col("rule.level"),
                      F.col("rule.description"), F.col("agent.name"), F.col("agent.ip"),
                      F.col("full_log"))


def alert_evidence(retrieved: DataFrame) -> DataFrame:
    """Light evidence rows for alerts, with the number of rows their query returned.

    Rows are counted where they are, and the counts joined back: a query without limit may have any number.
    """
    digest = _alert_hash()
    returned = retrieved.groupBy("query_id").agg(F.count("*").alias("rows_returned"))
    return retrieved.join(returned, "query_id").select(
        F.concat(F.lit("ev-"), short_hash(F.col("query_id"), F.col("node_id"), F.col("id")))
        .alias("evidence_id"),
        "query_id", "node_id",
        F.concat("node_id", F.lit("/wazuh-alerts#"), "timestamp").alias("raw_ref"),
        F.concat("query_id", F.lit(":"), digest).alias("lineage_id"),
        digest.alias("hash"),
        "timestamp",
        F.col("rule.id").alias("rule_id"),
        F.col("agent.name").alias("agent_name"),
        F.coalesce("agent.ip", F.lit("")).alias("src_ip"),
        "rows_returned",
    )


def gateway_evidence(alerts: DataFrame, query_id: Column, source: str = "wazuh_alerts") -> DataFrame:
    """Alert rows as the thirteen-field evidence item; ``alerts`` carries node_id."""
    digest = _alert_hash()
    agent_ip = F.nullif(F.col("agent.ip"), F.lit(""))
    return alerts.select(
        F.concat(F.lit("ev-"), short_hash(query_id, F.col("node_id"), F.col("id")))
        .alias("evidence_id"),
        query_id.alias("query_id"),
        F.concat("node_id", F.lit(f"/{source}#"), "timestamp").alias("raw_ref"),
        F.concat(query_id, F.lit(":"), digest).alias("lineage_id"),
        digest.alias("hash"),
        "timestamp",
        F.lit(source).alias("source"),
        F.coalesce("rule.id", F.lit("")).alias("rule_id"),
        F.coalesce("rule.description", F.lit("")).alias("description"),
        F.coalesce(agent_ip, F.lit(fixed.NO_IP)).alias("src_ip"),
        F.coalesce("agent.name", F.lit("")).alias("hostname"),
        F.col("rule.level").alias("severity"),
        F.col("full_log").alias("raw_log"),
    )


def tampered(evidence: DataFrame) -> DataFrame:
    """Evidence whose content no longer gives its hash, or whose lineage carries another one."""
    again = evidence.withColumn("_again", short_hash(
        F.replace(F.col("timestamp"), F.lit("T"), F.lit(" ")),
        *[F.col(c) for c in CONTENT if c != "timestamp"]))
    suffix = F.substring_index("lineage_id", ":", -1)
    return again.where((F.col("hash") != F.col("_again")) | (F.col("hash") != suffix)).drop("_again")


def query_summary(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence count per request; requests without a hit are kept with 0."""
    counts = evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    return requests.select("query_id", "node_id", "source").join(counts, "query_id", "left").select(
        "query_id", "node_id", "source", F.coalesce("n", F.lit(0)).alias("evidence_count"))


def lineage_chain(signals: DataFrame, requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """signal -> query -> evidence -> raw reference, signals without evidence included."""
    return (
        signals.select("signal_id", F.col("raw_ref").alias("signal_ref"))
        .join(requests.select("signal_id", "query_id"), "signal_id", "left")
        .join(evidence.select("query_id", "evidence_id", "lineage_id", "raw_ref"), "query_id", "left")
        .select("signal_id", "signal_ref", "query_id", "evidence_id", "lineage_id", "raw_ref")
    )
