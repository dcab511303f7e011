"""Rows packed as text between Spark and the processor, and in state."""

import json

import pytest
from pyspark.sql import functions as F

from fold import fold
from mendline.operators import gaps
from mendline.streaming import engine, processor
from rows import frame, rand_rows, row
from test_streaming import decisions, deliver


class Counted:
    """State of one record in memory; counts calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, name, schema):
        return State(self)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.append(at)


class State:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _call(self, value):
        self.handle.calls += 1
        self.value = value

    def get(self):
        self._call(self.value)
        return iter(self.value) if isinstance(self.value, list) else self.value

    def update(self, value):
        self._call(value)

    def clear(self):
        self._call(None)

    def appendList(self, rows):
        self._call([*(self.value or []), *rows])


def texts(kinds, rank, first=0):
    return [{"row": json.dumps({"seq": 2 * i + rank, "source_rank": rank, "rec_offset": i, "rec_ts": i, "ts": i, "kind": kind, "event_id": f"e{i}",
                                "cutoff": 0 if kind == "F" else None, "is_success": True if kind == "F" else None})}
            for i, kind in enumerate(kinds, first)]


def unpacked(out):
    return [d for r in out for d in json.loads(r.rows)]


@pytest.mark.parametrize("options", [{}, {"match": True}])
def test_calls_to_state_do_not_grow_with_rows(options):
    calls = []
    for n in (10, 400):
        handle = Counted()
        handler = processor.PackedGapProcessor("strict", **options)
        handler.init(handle)
        out = []
        for rows in (texts("F" * n, 1), texts("GN" * (n // 2), 0)):
            out += unpacked(handler.handleInputRows(("r",), iter(rows), None))
        calls.append(handle.calls)
        assert {d["row"]["seq"] for d in out} == {*range(0, 2 * n, 2), *range(1, 2 * n, 2)}
    assert calls[0] == calls[1] <= 12


def test_one_timer_for_the_gap_that_stays_open():
    handle = Counted()
    handler = processor.PackedGapProcessor(timeout_ms=1_000, timers="event")
    handler.init(handle)
    changes, fills = texts("G" * 51, 0), texts("F" * 50, 1)
    list(handler.handleInputRows(("r",), iter(changes + fills), None))
    assert handle.timers == [50 + 1_001]


def test_texts_are_cut(monkeypatch):
    monkeypatch.setattr(processor, "CHUNK", 1_000)
    handle = Counted()
    handler = processor.PackedGapProcessor()
    handler.init(handle)
    out = list(handler.handleInputRows(("r",), iter(texts("G" + "N" * 200, 0)), None))
    assert len(out) > 10 and max(len(r.rows) for r in out) < 2_000
    assert len(handler.held.value) > 10 and max(len(x) for x, in handler.held.value) < 2_000
    out = unpacked(handler.handleInputRows(("r",), iter(texts("F", 1, first=300)), None))
    assert [d["decision"] for d in out] == ["filled"] + ["flushed"] * 200


def test_any_text_goes_through_state(spark, tmp_path):
    """Line ends, quotes, signs beyond the basic plane, no time, text longer than a JSON parser takes by default."""
    odd = ['a\nb\r\n\t"\\ \x00 \U0001f600', "", "null", None, "x" * 21_000_000]
    rows = [row("r", 0, "G", 1)] + [row("r", i, "N", 1 + i) | {"payload": p, "entity": None} for i, p in enumerate(odd, 1)]
    rows += [row("s", 9, "N", 1) | {"ts": None, "arrived": None, "payload": None, "entity": None, "event_id": None}]
    rows += [row("r", 20, "F", 50, 2, True)]
    df = frame(spark, rows)
    written = deliver(df, ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", lambda s: engine.gap_stream(s), n=2)
    assert decisions(written) == fold(rows)[0]
    short = F.when(F.length("payload") > 1_000, F.sha2("payload", 256)).otherwise(F.col("payload")).alias("payload")
    given = {(r.record_id, r.seq): tuple(r) for r in df.select("record_id", "seq", "arrived", "ts", "event_id", "entity", short).collect()}
    got = written.select("record_id", "seq", "arrived", "ts", "event_id", "entity", short).collect()
    assert {(r.record_id, r.seq): tuple(r) for r in got} == given


def test_held_rows_as_they_came(spark, tmp_path):
    rows = rand_rows("held", 120)
    df = frame(spark, rows)
    deliver(df, ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", lambda s: engine.gap_stream(s), n=3)
    held = {(r.record_id, r.seq): (r.ts, r.payload, r.event_id) for r in engine.held_rows(spark, f"{tmp_path}/cp").collect()}
    want = {k for k, d in fold(rows)[0].items() if d == "pending"}
    assert want and held == {(r["record_id"], r["seq"]): (r["ts"], r["payload"], r["event_id"]) for r in rows if (r["record_id"], r["seq"]) in want}


def test_a_record_is_parsed_in_calls_that_do_not_grow_with_its_rows(monkeypatch):
    real, calls = json.loads, []
    monkeypatch.setattr(processor.json, "loads", lambda text: calls.append(1) or real(text))
    counts = []
    for n in (10, 400):
        handler = processor.PackedGapProcessor("strict")
        handler.init(Counted())
        calls.clear()
        for rows in (texts("G" + "N" * n, 0), texts("F", 1, first=n + 1)):
            assert [*handler.handleInputRows(("r",), iter(rows), None)]
        counts.append(len(calls))
    assert counts[0] == counts[1]


@pytest.mark.parametrize("options", [{}, {"match": True}, {"max_buffer": 3}])
def test_wanted_columns_and_decisions_alone(options):
    """The same rules and the same state; only what is put out is less."""
    def run(**wanted):
        handler, out, size = processor.PackedGapProcessor("strict", **options, **wanted), [], 0
        handler.init(Counted())
        for kinds, rank, first in (("NGNNNNN", 0, 0), ("F", 1, 1), ("GNN", 0, 20)):
            rows = [{"row": json.dumps(json.loads(x["row"]) | {"payload": "p" * 1_000})} for x in texts(kinds, rank, first)]
            for r in handler.handleInputRows(("r",), iter(rows), None):
                size += len(r.rows)
                out += json.loads(r.rows)
        return out, size, (handler.record_state.value, handler.held.value)

    whole, size, state = run()
    for columns in (engine.DECISION, ("seq", "decision", "ts", "emitted")):
        some, less, same = run(columns=columns)
        assert some == [{c: d[c] if c in d else d["row"].get(c) for c in columns} for d in whole]
        assert less < size / 10 and same == state
    routed, less, same = run(only=engine.ROUTED)
    assert routed == [d for d in whole if d["decision"] in engine.ROUTED] and less < size and same == state
    assert len(whole) > len(routed) > 0


def test_columns_of_a_stream(spark, tmp_path):
    rows = rand_rows("columns", 120)
    written = deliver(frame(spark, rows), ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: engine.gap_stream(s, columns=engine.DECISION), n=2)
    assert written.columns == ["record_id", "seq", "decision"] and decisions(written) == fold(rows)[0]
    held = {(r.record_id, r.seq): (r.ts, r.payload) for r in engine.held_rows(spark, f"{tmp_path}/cp").collect()}
    assert held == {(r["record_id"], r["seq"]): (r["ts"], r["payload"]) for r in rows if fold(rows)[0][r["record_id"], r["seq"]] == "pending"}


def test_a_record_is_handed_over_in_one_row_beside_its_held_rows(spark):
    rows = rand_rows("handed", 200)
    decided = gaps.decide(frame(spark, rows))
    initial = engine.handover(decided).collect()
    assert len([r for r in initial if r.part != "held"]) == len({r["record_id"] for r in rows})
    assert any(r.open_seq is not None for r in initial if r.part != "held")
    handle = Counted()
    handler = processor.PackedGapProcessor()
    handler.init(handle)
    handler.handleInitialState(("r",), {"part": "progress", "row": json.dumps({"emitted": 3, "opened_at": 5, "open_seq": 1, "handed": 0})}, None)
    kept = json.loads(handler.record_state.value[0])
    assert handle.calls == 1 and kept["emitted"] == 3 and kept["gap"]["open_seq"] == 1
