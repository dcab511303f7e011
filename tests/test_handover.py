"""What comes after a table run: handover to a stream, quiet records by event time, forced fills over the wire."""

import json

import pytest
from pyspark.sql import functions as F

from fold import fold
from mendline.operators import gaps, limits
from mendline.sources import codecs, io
from mendline.streaming import engine
from rows import frame, rand_rows
from test_streaming import cdc_json, decisions, deliver


@pytest.mark.parametrize("mode,share", [("compat", 0.5), ("strict", 0.3)])
def test_table_and_then_stream_is_the_table_over_all(spark, tmp_path, mode, share):
    rows = rand_rows(f"handover {mode}", 260)
    first, rest = rows[:int(len(rows) * share)], rows[int(len(rows) * share):]
    decided = io.stored(gaps.decide(frame(spark, first), mode), "decided")
    initial = engine.handover(decided)
    written = deliver(frame(spark, rest), ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: engine.gap_stream(s, mode, initial=initial), n=2)
    want, place, _ = fold(rows, mode)
    got = {(r.record_id, r.seq): r.decision for r in decided.collect()} | decisions(written)
    assert got == want and "pending" in fold(first, mode)[0].values()
    # Rows handed over are replayed in their order, and numbers of emission go on.
    assert {(r.record_id, r.seq): r.pos for r in written.filter("decision = 'flushed'").collect()}.items() <= place.items()
    before = {r.record_id: r.emitted for r in initial.filter("part = 'progress'").collect()}
    firsts = {r.record_id: r.n for r in written.groupBy("record_id").agg(F.min("emitted").alias("n")).collect() if r.n is not None}
    assert all(n == before.get(record, 0) + 1 for record, n in firsts.items())
    state = {(r.record_id, r.seq) for r in engine.held_rows(spark, f"{tmp_path}/cp").collect()}
    assert state == {k for k, d in want.items() if d == "pending"}


def test_nothing_to_hand_over(spark, tmp_path):
    rows = rand_rows("none", 40)
    initial = engine.handover(gaps.decide(frame(spark, rows).filter("false")))
    written = deliver(frame(spark, rows), ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: engine.gap_stream(s, initial=initial), n=1)
    assert decisions(written) == fold(rows)[0]


@pytest.mark.parametrize("n", [1, 3])
def test_quiet_gaps_fail_by_event_time(spark, tmp_path, n):
    """The watermark is the latest record time of all records; the table form takes it as its instant."""
    rows = [r | {"rec_ts": r["arrived"]} for r in rand_rows("quiet", 200, records=25, hot=False)]
    df = frame(spark, rows).withColumn("rec_ts", F.col("arrived"))
    now = max(r["arrived"] for r in rows)
    want = {(r.record_id, r.seq): r.decision for r in limits.decide_limited(df, 300, as_of=now).collect()}
    written = deliver(df, ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: engine.gap_stream(s, timeout_ms=300, timers="event"), n=n)
    assert decisions(written) == want
    quiet = {(r.record_id, r.seq): r.decision for r in limits.decide_limited(df, 300).collect()}
    assert quiet != want and written.filter("decision = 'gap_failed' AND err = 'timeout'").count() > 0


def test_forced_fill_over_the_wire(spark, tmp_path):
    fill = lambda rec, n, **more: json.dumps({"recordId": rec, "entityType": "E", "eventId": f"e{n}", "cutoffLastModifiedEpochMs": 1000 + n,
                                              "allFields": {"f": n}, "isSuccess": True, "errMessage": ""} | more)
    spark.createDataFrame([("7", cdc_json("7", "N", 1, 0), 1, 0)], io.WIRE).write.parquet(f"{tmp_path}/cdc")
    spark.createDataFrame([("7", fill("7", 1, force=True), 5, 0), ("7", fill("7", 2), 6, 1), ("7", fill("7", 3, force=False), 7, 2)],
                          io.WIRE).write.parquet(f"{tmp_path}/fills")
    read = lambda name: io.read_wire(spark, "parquet", f"{tmp_path}/{name}", stream=True)
    out = engine.run_to_end(engine.outputs(read("cdc"), read("fills"), "strict"), f"{tmp_path}/out", f"{tmp_path}/cp").collect()
    made = [json.loads(r.value) for r in sorted(out, key=lambda r: r.rec_offset)]
    assert [(v["type"], v["changedFields"]) for v in made] == [("N", {"a": 0}), ("F", {"f": 1})]
    tagged = codecs.tag(*(parse(io.read_wire(spark, "parquet", f"{tmp_path}/{name}")) for parse, name in
                          ((codecs.parse_cdc, "cdc"), (codecs.parse_fills, "fills"))))
    decided = gaps.decide(codecs.arrival_order(tagged), "strict", codecs.WIRE_LAYOUT)
    assert sorted(r.decision for r in decided.collect()) == ["fill_ignored", "fill_ignored", "forced", "forwarded"]
