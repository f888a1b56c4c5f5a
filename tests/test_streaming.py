import random
import subprocess
import sys
from datetime import timedelta

import numpy as np
from pyspark.sql import functions as F

from authloom.functions import fixed
from authloom.operators import detection
from authloom.streaming import detect, ingest
from tests.conftest import ROOT
from tests.test_detection import MESSAGES, T0, brute_fires, events


def test_stream_detection_equals_batch(spark, tmp_path):
    rnd = random.Random(5)
    items = [(rnd.randrange(3000), rnd.choice(list(MESSAGES)), rnd.choice("aaab"), rnd.choice("uv")) for _ in range(400)]
    ev = events(spark, items)
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    run = lambda: detect.run_detection(spark, source, fixed.DEFAULT_RULES, out, ck, delay="10 minutes")
    for lo in range(0, 3000, 1000):  # a restart after each piece
        a, b = (F.lit(T0 + timedelta(seconds=s)).cast("timestamp_ntz") for s in (lo, lo + 1000))
        detect.land_events(ev.where((F.col("timestamp") >= a) & (F.col("timestamp") < b)), source)
        run()
    # an hour late: left out
    detect.land_events(ev.where(F.col("timestamp") < F.lit(T0 + timedelta(seconds=100)).cast("timestamp_ntz")), source)
    run()
    detect.land_end(spark, source)
    run()
    got = {(r.rule_id, r.group_key, int((r.timestamp - T0).total_seconds()), r.window_count)
           for r in spark.read.parquet(str(tmp_path / "out")).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).collect()}
    assert got == brute_fires(items, fixed.DEFAULT_RULES)


def test_tail_continues_from_its_checkpoint(spark, tmp_path):
    src, out, ck = tmp_path / "n1", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    nodes = {str(src): "n1"}
    (src / "1.log").write_text("a\n\nb\n")
    ingest.tail_to_table(spark, nodes, out, ck)
    (src / "2.log").write_text("c\n")
    ingest.tail_to_table(spark, nodes, out, ck)
    assert sorted(r.value for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_decode_batches_route_by_attempts(spark, tmp_path):
    rows = [(1, 1, '{"a": 1}'), (2, 1, "x"), (3, 3, "y")]
    spark.createDataFrame(rows, "seq bigint, attempts int, payload string").write.parquet(str(tmp_path / "in"))
    stream = ingest._stream_parquet(spark, str(tmp_path / "in"))
    q = ingest.decode_batches(stream, "a int", *[str(tmp_path / n) for n in ("good", "retry", "dead", "ck")])
    q.awaitTermination()
    assert [spark.read.parquet(str(tmp_path / n)).select("seq").collect()[0][0] for n in ("good", "retry", "dead")] == [1, 2, 3]


def test_state_queries_need_no_settings(tmp_path):
    """A session without any setting of this library: keyed state works, and is gone in the end."""
    code = f"""
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate())
from authloom.functions import fixed
from authloom.streaming import detect
from tests.conftest import ROOT
from tests.test_detection import events
detect.land_events(events(spark, [(k, "LOCAL_SSH_ACCEPTED", "a", "u") for k in range(50)]), {str(tmp_path / "in")!r})
detect.land_end(spark, {str(tmp_path / "in")!r})
detect.run_detection(spark, {str(tmp_path / "in")!r}, fixed.DEFAULT_RULES, {str(tmp_path / "out")!r}, {str(tmp_path / "ck")!r})
assert spark.read.parquet({str(tmp_path / "out")!r}).count() > 0
assert detect.keys_in_state(spark, {str(tmp_path / "ck")!r}).count() == 0
assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_live_lineage(spark, tmp_path):
    """Signals without request and requests without evidence are reported in the end; what comes late is not joined."""
    from authloom.streaming import lineage

    minute = lambda m: f"timestamp'2024-01-01' + make_dt_interval(0, 0, cast({m} as int))"
    rows = {"signals": spark.range(20).selectExpr("'s' || id AS signal_id", "'ref' || id AS raw_ref", f"{minute('id * 7')} AS at"),
            "requests": spark.range(0, 20, 2).selectExpr("'q' || id AS query_id", "'s' || id AS signal_id", f"{minute('id * 7 + 1')} AS at"),
            "evidence": spark.range(0, 20, 4).selectExpr(
                "'e' || id AS evidence_id", "'q' || id AS query_id", "'q:' || id AS lineage_id", "'r' || id AS raw_ref",
                f"{minute('id * 7 + if(id = 8, 30, 2)')} AS at")}
    base, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    for lo, hi in ((0, 60), (60, 500)):
        for name, df in rows.items():
            lineage.land(df.where(f"at >= {minute(lo)} AND at < {minute(hi)}"), f"{base}/{name}")
        lineage.run_lineage(spark, base, out, ck)
    lineage.land_ends(spark, base)
    lineage.run_lineage(spark, base, out, ck)
    got = {r.signal_id: (r.query_id, r.evidence_id) for r in lineage.read_lineage(spark, out).collect()}
    assert got == {f"s{k}": (f"q{k}" if k % 2 == 0 else None, f"e{k}" if k % 4 == 0 and k != 8 else None) for k in range(20)}


def test_keys_share_state_and_are_judged_apart(spark, tmp_path, monkeypatch):
    """Many keys in few shards: as many state rows as shards, and the fires of every key by itself."""
    monkeypatch.setattr(detect, "SHARDS", 4)
    rnd = random.Random(7)
    groups = [f"10.0.0.{i}" for i in range(60)]
    items = [(rnd.randrange(3000), rnd.choice(list(MESSAGES)), rnd.choice(groups), rnd.choice("uv")) for _ in range(1500)]
    source, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    run = lambda: detect.run_detection(spark, source, fixed.DEFAULT_RULES, out, ck, delay="10 minutes")
    detect.land_events(events(spark, items), source)
    first = run()
    held = detect.keys_in_state(spark, ck)
    keys = held.select("node_id", "rule_id", "group_key", "rules_version")
    assert 4 < keys.count() == keys.distinct().count()
    assert held.where("last IS NOT NULL").count() > 0
    assert first.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
    detect.land_end(spark, source)
    run()
    assert detect.keys_in_state(spark, ck).count() == 0
    got = {(r.rule_id, r.group_key, int((r.timestamp - T0).total_seconds()), r.window_count)
           for r in spark.read.parquet(out).withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz")).collect()}
    assert got == brute_fires(items, fixed.DEFAULT_RULES)


def test_instants_of_keys_on_several_axes():
    """Spans so long that only few keys fit on one axis of 64-bit instants."""
    code, us = np.repeat(np.arange(40), 3), np.tile([-10**17, 10**17 - 5, 10**17], 40)
    count = detect._trailing(code, us, np.ones(120, dtype=np.int64), np.full(40, 5))
    assert count.tolist() == [1, 1, 2] * 40


def test_live_lineage_keeps_bundles(spark, tmp_path):
    """Evidence of a request is one row of state, and a trigger commits no more stores than tasks of two rounds."""
    from authloom.streaming import lineage

    minute = lambda m: f"timestamp'2024-01-01' + make_dt_interval(0, 0, cast({m} as int))"
    ids = spark.range(30)
    each = ids.selectExpr("id", "explode(sequence(0, 19)) AS k").coalesce(1)
    base, out, ck = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    lineage.land(ids.selectExpr("'s' || id AS signal_id", "'ref' || id AS raw_ref", f"{minute('id')} AS at"), f"{base}/signals")
    lineage.land(ids.selectExpr("'q' || id AS query_id", "'s' || id AS signal_id", f"{minute('id')} AS at"), f"{base}/requests")
    # one of two instants, one of them too late to be joined; equal rows, and rows without id or reference
    lineage.land(each.selectExpr(
        "if(k = 7, null, 'e' || id || '-' || k div 2) AS evidence_id", "'q' || id AS query_id", "'q:' || k div 2 AS lineage_id",
        "if(k = 8, null, 'r' || k div 2) AS raw_ref", f"{minute('id + if(k >= 15, 30, 0)')} AS at"), f"{base}/evidence")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        first = lineage.run_lineage(spark, base, out, ck, delay="2 days")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    state = first.lastProgress["stateOperators"]
    assert {o["numShufflePartitions"] for o in state} == {2 * spark.sparkContext.defaultParallelism}
    assert max(int(o["numRowsTotal"]) for o in state) == 30 + 2 * 30
    lineage.land_ends(spark, base)
    lineage.run_lineage(spark, base, out, ck, delay="2 days")
    got = sorted(map(tuple, lineage.read_lineage(spark, out).select("signal_id", "query_id", "evidence_id", "lineage_id", "raw_ref").collect()), key=repr)
    want = [(f"s{i}", f"q{i}", None if k == 7 else f"e{i}-{k // 2}", f"q:{k // 2}", None if k == 8 else f"r{k // 2}")
            for i in range(30) for k in range(15)]
    assert got == sorted(want, key=repr)
    assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
