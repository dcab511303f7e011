"""JSON codecs, quarantine, tagging and ordering of wire rows."""

import json
import os
import subprocess
import sys

import pytest

from mendline import schemas as S
from mendline.operators import gaps
from mendline.sources import codecs, io
from mendline.streaming import engine

GOOD = {"eventId": "e1", "entity": "Employee", "recordId": "7", "type": "g", "timestamp": 5, "replayId": 9,
        "changedFields": {"b": 1, "a": {"x": [1, 2]}}, "gap": {"fromReplayId": 1, "toReplayId": 2, "reason": "r"}}


def cdc(spark):
    rows = [
        ("7", json.dumps(GOOD), 1, 0), (None, json.dumps(GOOD), 1, 1), ("7", None, 1, 2),
        ("7", json.dumps(GOOD)[:60], 1, 3), ("7", json.dumps({**GOOD, "recordId": None}), 1, 4),
        ("7", json.dumps({**GOOD, "type": None}), 1, 5), ("8", json.dumps(GOOD), 1, 6),
        ("7", json.dumps({**GOOD, "type": "X"}), 1, 7), ("7", json.dumps({**GOOD, "timestamp": "soon"}), 1, 8),
        ("7", json.dumps({**GOOD, "unknown": 1, "gap": None}), 1, 9)]
    return spark.createDataFrame(rows, io.WIRE)


def test_every_bad_row_has_a_reason(spark):
    got = {r.rec_offset: r for r in codecs.parse_cdc(cdc(spark)).collect()}
    assert [got[i].problem for i in range(10)] == [
        None, "null_key", "null_value", "bad_json", "null_record_id", "null_type", "key_mismatch", None, "bad_json", None]
    assert json.loads(got[0].payload) == GOOD["changedFields"] and got[0].gap.reason == "r"
    kept = codecs.quarantine(codecs.parse_cdc(cdc(spark))).collect()
    assert {r.rec_offset for r in kept} == {1, 2, 3, 4, 5, 6, 8}
    assert [r.value for r in kept if r.rec_offset == 3] == [json.dumps(GOOD)[:60]]


def test_fail_fast(spark):
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        codecs.decode(cdc(spark), S.CDC_EVENT, fail_fast=True).select("v.recordId").collect()


def test_kinds_and_modes(spark):
    fills = spark.createDataFrame([("8", json.dumps({"recordId": "7", "entityType": "E", "eventId": "f",
                                                     "cutoffLastModifiedEpochMs": 3, "allFields": {}}), 1, 0)], io.WIRE)
    parsed = codecs.parse_cdc(cdc(spark)), codecs.parse_fills(fills)
    strict = codecs.tag(*parsed, "strict").collect()
    assert {(r.rec_offset, r.seq, r.key) for r in strict} == {(0, 0, "7"), (7, 14, "7"), (9, 18, "7")}
    assert {(r.rec_offset, r.type, r.replay_id, r.gap and r.gap.reason) for r in strict} == {(0, "g", 9, "r"), (7, "X", 9, "r"), (9, "g", 9, None)}
    assert {(r.rec_offset, r.kind) for r in strict} == {(0, "G"), (7, "N"), (9, "G")}
    # In compat a fill goes by its key, a change by the id inside it.
    compat = codecs.tag(*parsed, "compat").collect()
    assert {(r.record_id, r.rec_offset, r.kind) for r in compat} == {
        ("7", 0, "G"), ("7", 6, "G"), ("7", 7, "N"), ("7", 9, "G"), ("8", 0, "F")}


def test_older_fill_without_flag(spark):
    fill = {"recordId": "7", "entityType": "E", "eventId": "f", "cutoffLastModifiedEpochMs": 3, "allFields": {"a": 1}}
    wire = spark.createDataFrame([("7", json.dumps(fill), 1, 0),
                                  ("7", json.dumps({**fill, "cutoffLastModifiedEpochMs": -1}), 1, 1),
                                  ("7", json.dumps({**fill, "isSuccess": False}), 1, 2)], io.WIRE)
    got = codecs.parse_fills(wire).withColumn("ok", gaps.fill_succeeded()).orderBy("rec_offset").collect()
    assert [(r.is_success, r.ok) for r in got] == [(None, True), (None, False), (False, False)]


def test_round_trip(spark):
    from pyspark.sql import functions as F
    parsed = codecs.parse_cdc(cdc(spark).filter("rec_offset = 0"))
    text = parsed.select(codecs.encode(
        F.col("event_id").alias("eventId"), "entity", F.col("record_id").alias("recordId"), "type",
        F.col("ts").alias("timestamp"), F.col("replay_id").alias("replayId"),
        codecs.field_map(F.col("payload")).alias("changedFields"), "gap").alias("t")).first().t
    assert json.loads(text) == GOOD


def test_json_lines_source(spark, tmp_path):
    wire = cdc(spark)
    io.write_batch(wire, "json", str(tmp_path / "w"))
    back = io.read_wire(spark, "json", str(tmp_path / "w"))
    assert sorted(map(str, back.collect())) == sorted(map(str, wire.collect()))


def test_work_goes_to_the_shared_folder(tmp_path):
    """In a session of its own, since the setting is fixed at start."""
    shared = tmp_path / "shared"
    code = f"""
from pyspark.sql import SparkSession
from mendline.sources import io
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", {str(shared)!r}).getOrCreate())
assert io.fresh_dir(spark, "x").startswith({str(shared)!r})
assert io.stored(spark.range(3)).count() == 3
spark.stop()
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, cwd=root)
    assert list(shared.rglob("part-*"))


def two_partitions(spark):
    """Keys 7 and 8, in partitions of their own, both with rows that name record 7; their offsets are equal."""
    event = lambda n, kind, at: json.dumps({"eventId": f"e{n}", "entity": "E", "recordId": "7", "type": kind, "timestamp": at, "changedFields": {"a": n}})
    fill = lambda n, at: json.dumps({"recordId": "7", "entityType": "E", "eventId": f"e{n}", "cutoffLastModifiedEpochMs": at, "allFields": {}})
    rows = lambda *r: spark.createDataFrame(r, io.PARTITIONED_WIRE)
    changes = rows(("7", event(0, "N", 1), 1, 0, 0), ("8", event(1, "G", 2), 2, 0, 1), ("7", event(2, "N", 30), 3, 1, 0),
                   ("8", event(3, "N", 4), 4, 1, 1), ("7", event(4, "N", 50), 5, 2, None))
    return changes, rows(("7", fill(1, 20), 6, 0, 0), ("7", fill(1, 20), 7, 0, 1))


def test_equal_offsets_in_two_partitions(spark, tmp_path):
    changes, fills = two_partitions(spark)
    tagged = codecs.tag(codecs.parse_cdc(changes), codecs.parse_fills(fills), "compat")
    decided = gaps.decide(codecs.arrival_order(tagged), "compat", codecs.WIRE_LAYOUT).collect()
    assert len({(r.record_id, r.seq) for r in decided}) == len(decided) == 7
    want = {(r.source_rank, r.rec_partition, r.rec_offset): r.decision for r in decided}
    assert want == {(0, 0, 0): "forwarded", (0, 1, 0): "command", (0, 0, 1): "flushed", (0, 1, 1): "dropped", (0, 0, 2): "flushed",
                    (1, 0, 0): "filled", (1, 1, 0): "fill_ignored"}
    # The same from files that carry the partition, as a stream.
    for name, table in (("cdc", changes), ("fills", fills)):
        table.write.parquet(f"{tmp_path}/{name}")
    read = lambda name: io.read_wire(spark, "parquet", f"{tmp_path}/{name}", stream=True, partitioned=True)
    stream = engine.gap_stream(codecs.tag(codecs.parse_cdc(read("cdc")), codecs.parse_fills(read("fills")), "compat"))
    written = engine.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.record_id, r.seq): r.decision for r in engine.final_decisions(written).collect()}
    assert got == {(r.record_id, r.seq): r.decision for r in decided}


def test_partition_of_a_topic_and_sequence_numbers(spark):
    topic = spark.createDataFrame([(b"7", b"{}", 3, 5), (b"8", None, 3, 5)], "key binary, value binary, partition int, offset bigint")
    wire = io._from_kafka(topic.selectExpr("key", "value", "timestamp_millis(9) AS timestamp", "partition", "offset"))
    assert [tuple(r) for r in wire.collect()] == [("7", "{}", 9, 5, 3), ("8", None, 9, 5, 3)]
    plain, fills = codecs.parse_cdc(cdc(spark)), codecs.parse_fills(two_partitions(spark)[1].drop("rec_partition"))
    seqs = {(r.source_rank, r.rec_offset, r.rec_partition): r.seq for r in codecs.tag(plain, fills).collect()}
    assert all(seq == offset * 2 + rank and partition == 0 for (rank, offset, partition), seq in seqs.items())
