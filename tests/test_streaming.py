"""The stateful operator: agreement with the fold over several micro-batches, restart, timers, outputs."""

import json
import time

import pytest
from pyspark.sql import functions as F

from fold import fold
from mendline import schemas as S
from mendline.operators import gaps
from mendline.plans import streams
from mendline.sources import codecs, io
from mendline.streaming import engine
from rows import SCHEMA, frame, rand_rows, row


def deliver(df, order, folder, checkpoint, out, transform, n):
    """Hand a table to a stream in `n` deliveries by order, running to the end after each; a row without order comes first."""
    rows = sorted(df.collect(), key=lambda r: tuple((r[c] is not None, r[c] or 0) for c in order))
    for i in range(n):
        part = rows[len(rows) * i // n:len(rows) * (i + 1) // n]
        df.sparkSession.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(folder)
        written = engine.run_to_end(transform(df.sparkSession.readStream.schema(df.schema).parquet(folder)), out, checkpoint)
    return written


def decisions(written):
    return {(r.record_id, r.seq): r.decision for r in engine.final_decisions(written).collect()}


@pytest.mark.parametrize("mode,timeout,most", [("compat", None, None), ("strict", 60, 3)])
def test_stream_is_the_fold(spark, tmp_path, mode, timeout, most):
    """Three deliveries, each run going on from the checkpoint of the one before."""
    rows = rand_rows(f"stream {mode}", 240)
    written = deliver(
        frame(spark, rows), ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
        lambda s: engine.gap_stream(s, mode, timeout_ms=timeout, max_buffer=most), n=3)
    decision, place, failed = fold(rows, mode, timeout, most)
    assert decisions(written) == decision
    numbers = {}
    for r in written.filter("emitted IS NOT NULL").collect():
        numbers.setdefault(r.record_id, []).append(r.emitted)
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in numbers.values())
    got = written.filter("decision = 'flushed'").collect()
    assert {(r.record_id, r.seq): r.pos for r in got} == place
    assert {(r.record_id, r.seq): r.err for r in written.filter("decision = 'gap_failed'").collect()} == failed
    held = engine.held_rows(spark, f"{tmp_path}/cp").collect()
    assert {(r.record_id, r.seq) for r in held} == {k for k, d in decision.items() if d == "pending"}


def test_timer_ends_a_quiet_gap(spark, tmp_path):
    folder = str(tmp_path / "in")
    frame(spark, [row("a", 0, "G", 10), row("a", 1, "N", 11), row("b", 2, "N", 12)]).write.parquet(folder)
    stream = engine.gap_stream(spark.readStream.schema(SCHEMA).parquet(folder), timeout_ms=1_000, timers=True)
    query = (stream.writeStream.format("parquet").option("path", f"{tmp_path}/out")
             .option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="500 milliseconds").start())
    try:
        until = time.time() + 60
        while time.time() < until:
            time.sleep(1)
            try:
                written = spark.read.schema(stream.schema).parquet(f"{tmp_path}/out")
                if written.filter("decision = 'gap_failed'").count():
                    break
            except Exception:  # nothing written yet
                continue
    finally:
        query.stop()
    assert decisions(written) == {("a", 0): "command", ("a", 1): "dead_letter", ("b", 2): "forwarded"}
    assert written.filter("decision = 'gap_failed'").first().err == "timeout"


def cdc_json(rec, type_, ts, n, fields=None):
    return json.dumps({"eventId": f"e{n}", "entity": "Employee", "recordId": rec, "type": type_, "timestamp": ts,
                       "replayId": n, "changedFields": fields or {"a": n}, "gap": None})


def test_loop_with_strict_outputs_and_quarantine(spark, tmp_path):
    """Changes with two gaps; one record has an image, the other has none; one row is no JSON."""
    wire = [("1", cdc_json("1", "N", 1000, 0), 1000, 0), ("1", cdc_json("1", "G", 2000, 1), 2000, 1),
            ("1", cdc_json("1", "N", 3000, 2), 3000, 2), ("1", cdc_json("1", "N", 200_000_000_000, 3), 4000, 3),
            ("2", cdc_json("2", "G", 1000, 4), 1000, 4), ("2", cdc_json("2", "N", 2000, 5), 2000, 5),
            ("3", '{"recordId":', 1000, 6), ("4", None, 1000, 7), (None, cdc_json("4", "N", 1, 8), 1000, 8)]
    spark.createDataFrame(wire, io.WIRE).write.parquet(f"{tmp_path}/cdc")
    image = '{"lastModifiedEpochMs":150000000000,"name":"x"}'
    images = lambda: spark.createDataFrame([("1", "Employee", image)], "record_id string, entity_type string, image string")
    out = streams.repair_loop(spark, str(tmp_path), images, mode="strict").collect()
    by_topic = {}
    for r in sorted(out, key=lambda r: (str(r.key), r.rec_offset)):
        by_topic.setdefault(r.topic, []).append((r.key, json.loads(r.value)))
    assert [(k, v["recordId"], v["entityType"], v["eventId"]) for k, v in by_topic[S.TOPICS["fill_command"]]] == [
        ("1", "1", "Employee", "e1"), ("2", "2", "Employee", "e4")]
    output = [(k, v["type"], v["eventId"], v["changedFields"]) for k, v in by_topic[S.TOPICS["cdc_out"]]]
    assert sorted(output, key=str) == sorted([
        ("1", "N", "e0", {"a": 0}), ("1", "F", "e1", json.loads(image)), ("1", "N", "e3", {"a": 3})], key=str)
    errors = {(k, v["reason"]) for k, v in by_topic[S.TOPICS["error"]]}
    assert errors == {("2", "fill_error"), ("2", "dead_letter"), ("3", "bad_json"), ("4", "null_value"), (None, "null_key")}


def test_fill_under_another_key(spark, tmp_path):
    """In compat a fill goes by its key, and names the record it says it is of."""
    fill = json.dumps({"recordId": "9", "entityType": "E", "eventId": "e", "cutoffLastModifiedEpochMs": 1, "allFields": {}})
    spark.createDataFrame([("7", cdc_json("7", "G", 1, 0), 1, 0)], io.WIRE).write.parquet(f"{tmp_path}/cdc")
    spark.createDataFrame([("7", fill, 5, 0)], io.WIRE).write.parquet(f"{tmp_path}/fills")
    read = lambda name: io.read_wire(spark, "parquet", f"{tmp_path}/{name}", stream=True)
    out = engine.run_to_end(engine.outputs(read("cdc"), read("fills")), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    made = [(r.key, json.loads(r.value)) for r in out if r.topic == S.TOPICS["cdc_out"]]
    assert [(k, v["recordId"], v["entity"], v["type"]) for k, v in made] == [("7", "9", "9", "F")]


def test_record_goes_through_unchanged(spark, tmp_path):
    """Type, replay id, gap information, key and time as received; replayed rows go out with key and time of the fill."""
    event = lambda n, type_, rec="7", **more: json.dumps({"eventId": f"e{n}", "entity": "E", "recordId": rec, "type": type_, "timestamp": n,
                                                          "replayId": 900 + n, "changedFields": {"a": n}, "gap": more.get("gap")})
    gap = {"fromReplayId": 1, "toReplayId": 2, "reason": "r"}
    cdc = [("8", event(0, "X", gap=gap), 100, 0), ("7", event(1, "g"), 1000, 1), ("7", event(2, "X"), 3000, 2), ("7", "{", 3500, 3)]
    fill = json.dumps({"recordId": "7", "entityType": "E", "eventId": "e1", "cutoffLastModifiedEpochMs": 1, "allFields": {"f": 1}})
    spark.createDataFrame(cdc, io.WIRE).write.parquet(f"{tmp_path}/cdc")
    spark.createDataFrame([("7", fill, 5000, 0)], io.WIRE).write.parquet(f"{tmp_path}/fills")
    read = lambda name: io.read_wire(spark, "parquet", f"{tmp_path}/{name}", stream=True)
    out = engine.run_to_end(engine.outputs(read("cdc"), read("fills")), f"{tmp_path}/out", f"{tmp_path}/cp").orderBy("rec_offset").collect()
    events = [(r.key, r.rec_ts, json.loads(r.value)) for r in out if r.topic == S.TOPICS["cdc_out"]]
    assert events[0] == ("8", 100, json.loads(cdc[0][1])) and events[0][2]["gap"] == gap and events[0][2]["type"] == "X"
    assert [(k, t, v["type"], v["replayId"]) for k, t, v in events[1:]] == [("7", 5000, "F", 0), ("7", 5000, "X", 902)]
    assert [json.loads(r.value)["reason"] for r in out if r.topic == S.TOPICS["error"]] == ["bad_json"]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_no_cut_of_the_stream_changes_the_result(spark, tmp_path, n):
    """Offsets of the two sources overlap and record times run backwards; the order is that of `arrival_order`."""
    import random
    pick = random.Random(11)
    rows = []
    for rank in (0, 1):
        for offset in range(0, 120, 1 + rank):
            rows.append((f"r{pick.randrange(3)}", 1000 + offset * 10 - pick.choice((0, 0, 0, 300)), rank, offset,
                         "F" if rank else pick.choice("NNG"), offset, 5 if rank else None))
    df = spark.createDataFrame(rows, "record_id string, rec_ts bigint, source_rank int, rec_offset bigint, kind string, ts bigint, cutoff bigint")
    df = df.withColumn("seq", F.col("rec_offset") * 2 + F.col("source_rank")).withColumns(
        {c: F.lit(None).cast(t) for c, t in (("event_id", "string"), ("entity", "string"), ("payload", "string"), ("is_success", "boolean"), ("err", "string"))})
    ordered = codecs.arrival_order(df)
    wanted = {(r.record_id, r.seq): r.decision for r in gaps.decide(ordered, layout=codecs.WIRE_LAYOUT).collect()}
    written = deliver(ordered, codecs.WIRE_ORDER, f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", engine.gap_stream, n)
    assert decisions(written) == wanted and set(wanted.values()) >= {"forwarded", "command", "filled", "flushed"}


def test_many_rounds(spark, tmp_path):
    """The loop goes on as long as commands come."""
    spark.createDataFrame([("1", cdc_json("1", "G", 5, 0), 5, 0)], io.WIRE).write.parquet(f"{tmp_path}/cdc")
    rounds = []

    def images():
        n = len(rounds)
        rounds.append(n)
        if n < 3:  # a further gap comes while the worker answers
            more = [("1", cdc_json("1", "G", 10**12 + n, n + 1), 10**12 + n, n + 1)]
            spark.createDataFrame(more, io.WIRE).write.mode("append").parquet(f"{tmp_path}/cdc")
        return spark.createDataFrame([("1", "Employee", '{"lastModifiedEpochMs":7}')], "record_id string, entity_type string, image string")

    out = streams.repair_loop(spark, str(tmp_path), images).collect()
    assert sum(r.topic == S.TOPICS["fill_command"] for r in out) == len(rounds) >= 2


def test_two_consumers_of_the_commands(spark, tmp_path):
    """Each worker reads all commands with a checkpoint of its own; answering twice changes nothing."""
    commands = [(str(i), json.dumps({"recordId": str(i), "entityType": "E", "eventId": f"e{i}"}), 1, i) for i in range(20)]
    spark.createDataFrame(commands, io.WIRE).write.parquet(f"{tmp_path}/commands")
    images = lambda: spark.createDataFrame([(str(i), "E", '{"lastModifiedEpochMs":%d}' % i) for i in range(15)],
                                           "record_id string, entity_type string, image string")
    for worker in ("a", "b"):
        for _ in range(2):  # the second run finds nothing new
            source = io.read_wire(spark, "parquet", f"{tmp_path}/commands", stream=True)
            engine.fill_worker(source, images, f"{tmp_path}/{worker}", f"{tmp_path}/cp-{worker}").awaitTermination()
    a, b = (io.read_wire(spark, "parquet", f"{tmp_path}/{w}/*").collect() for w in "ab")
    assert len(a) == 20 and sorted(a) == sorted(b)
    assert sum(json.loads(r.value)["isSuccess"] for r in a) == 15


def test_live_counters(spark, tmp_path):
    rows = rand_rows("counters", 100)
    frame(spark, rows).write.parquet(f"{tmp_path}/in")
    listener = engine.LiveCounters()
    spark.streams.addListener(listener)
    try:
        stream = engine.observed(engine.gap_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")))
        engine.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
        for _ in range(50):
            if listener.totals.get(S.RECEIVED):
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    decision = list(fold(rows)[0].values())
    n = lambda *d: sum(x in d for x in decision)
    assert listener.totals[S.RECEIVED] == n("forwarded", "command", "gap_dropped", "flushed", "dropped", "pending")
    assert listener.totals[S.BUFFERED] == n("flushed", "dropped", "pending")
    assert listener.totals[S.FILLED] == n("filled") and listener.totals[S.BUFFER_FLUSHED] == n("flushed")
    t = listener.totals
    assert t[S.RECEIVED] - t[S.FORWARDED] == t[S.GAP_DETECTED] + t[S.BUFFERED]


def test_first_fills(spark, tmp_path):
    fills = spark.createDataFrame([("1", "a", 1), ("1", "a", 1), ("1", "b", 2), ("2", "a", 2)],
                                  "record_id string, event_id string, rec_ts bigint")
    fills.write.parquet(f"{tmp_path}/in")
    stream = engine.first_fills(spark.readStream.schema(fills.schema).parquet(f"{tmp_path}/in"), "1 hour")
    assert engine.run_to_end(stream, f"{tmp_path}/out", f"{tmp_path}/cp").count() == 3
