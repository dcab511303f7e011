"""One case per rule: normal rows, gaps, fills, duplicates, failures, limits."""

import pytest
from pyspark.sql import functions as F

from fold import fold
from mendline.operators import counters, gaps, limits
from rows import frame, scenario

# name, rows, mode, decisions in order, replay order (positions in the input)
CASES = [
    ("normal passes", "N", "compat", ["forwarded"], []),
    ("gap opens", "G", "compat", ["command"], []),
    ("second gap while open", "G G", "compat", ["command", "gap_dropped"], []),
    ("buffer pending", "G N N", "compat", ["command", "pending", "pending"], []),
    ("fill flushes all, newest first", "G N@2 N@3 F(0)", "compat", ["command", "flushed", "flushed", "filled"], [2, 1]),
    ("fill flushes all, in order", "G N@2 N@3 F(0)", "strict", ["command", "flushed", "flushed", "filled"], [1, 2]),
    ("old rows are skipped", "G N@2 N@3 N@4 F(3)", "compat", ["command", "dropped", "dropped", "flushed", "filled"], [3]),
    ("empty buffer", "G F(5)", "compat", ["command", "filled"], []),
    ("fill without gap", "F(5)", "compat", ["fill_ignored"], []),
    ("forced fill, compat", "F(5+)", "compat", ["fill_ignored"], []),
    ("forced fill, strict", "F(5+)", "strict", ["forced"], []),
    ("duplicate fill", "G F(5) F(5)", "compat", ["command", "filled", "fill_ignored"], []),
    ("reopens", "G F(5) N G", "compat", ["command", "filled", "forwarded", "command"], []),
    ("failed fill, compat", "G N@2 F(-1!)", "compat", ["command", "flushed", "filled"], [1]),
    ("failed fill, strict", "G N@2 F(-1!)", "strict", ["command", "dead_letter", "fill_error"], []),
    ("failed fill without gap", "F(-1!)", "strict", ["fill_error"], []),
    ("units, compat", "G@1700000000 N@1700000000 F(1699999999000)", "compat", ["command", "dropped", "filled"], []),
    ("units, strict", "G@1700000000 N@1700000000 F(1699999999000)", "strict", ["command", "flushed", "filled"], [1]),
]


@pytest.fixture(scope="module")
def ruled(spark):
    """All cases of a mode in one table, one record per case."""
    out = {}
    for mode in ("compat", "strict"):
        rows = [r for name, text, m, _, _ in CASES if m == mode for r in scenario(text, name)]
        for r in gaps.replayed(gaps.decide(frame(spark, rows), mode, ts_unit="guess", cutoff_unit="guess"), mode).collect():
            out.setdefault(r.record_id, {})[r.seq] = r
    return out


@pytest.mark.parametrize("name,text,mode,want,order", CASES, ids=[c[0] for c in CASES])
def test_rule(ruled, name, text, mode, want, order):
    got = ruled[name]
    assert [got[i].decision for i in range(len(got))] == want
    assert [r.seq for r in sorted((r for r in got.values() if r.pos), key=lambda r: r.pos)] == order
    decision = fold(scenario(text), mode)[0]
    assert [decision["123", i] for i in range(len(want))] == want


LIMITED = [
    ("timeout", "G@1 N@2 N@12 F(0)@13", 10, None, ["command", "dead_letter", "forwarded", "fill_ignored"], {0: "timeout"}, [3]),
    ("just in time", "G@1 N@2 F(0)@11", 10, None, ["command", "flushed", "filled"], {}, []),
    ("late fill alone", "G@1 N@2 F(0)@12", 10, None, ["command", "dead_letter", "fill_ignored"], {0: "timeout"}, [2]),
    ("quiet gap stays open", "G@1 N@2", 10, None, ["command", "pending"], {}, []),
    ("reopens after timeout", "G@1 G@5 G@12 N@13 F(0)@14", 10, None,
     ["command", "gap_dropped", "command", "flushed", "filled"], {0: "timeout"}, []),
    ("overflow", "G N N N", None, 2, ["command", "dead_letter", "dead_letter", "dead_letter"], {0: "overflow"}, []),
    ("limit kept", "G N N F(0)", None, 2, ["command", "flushed", "flushed", "filled"], {}, []),
    ("fill after overflow", "G N N N N F(0)", None, 2,
     ["command", "dead_letter", "dead_letter", "dead_letter", "forwarded", "fill_ignored"], {0: "overflow"}, [5]),
    ("chain of gaps", "G@1 N@2 G@20 N@21 G@40 N@41 F(0)@42", 10, None,
     ["command", "dead_letter", "command", "dead_letter", "command", "flushed", "filled"], {0: "timeout", 2: "timeout"}, []),
    ("timeout before overflow", "G@1 N@2 N@3 N@20 N@21", 10, 2,
     ["command", "dead_letter", "dead_letter", "forwarded", "forwarded"], {0: "timeout"}, []),
]


@pytest.fixture(scope="module")
def limited(spark):
    out = {}
    for timeout, most in {(c[2], c[3]) for c in LIMITED}:
        rows = [r for c in LIMITED if (c[2], c[3]) == (timeout, most) for r in scenario(c[1], c[0])]
        for r in limits.decide_limited(frame(spark, rows), timeout, most).collect():
            out.setdefault(r.record_id, {})[r.seq] = r
    return out


@pytest.mark.parametrize("name,text,timeout,most,want,failed,late", LIMITED, ids=[c[0] for c in LIMITED])
def test_limits(limited, name, text, timeout, most, want, failed, late):
    got = limited[name]
    assert [got[i].decision for i in range(len(got))] == want
    assert {i: r.failed for i, r in got.items() if r.failed} == failed
    assert sorted(i for i, r in got.items() if r.late) == late
    decision, _, why = fold(scenario(text), "compat", timeout, most)
    assert [decision["123", i] for i in range(len(want))] == want
    assert {seq: reason for (_, seq), reason in why.items()} == failed


def test_null_time_is_not_newer(spark):
    rows = scenario("G N F(0)")
    rows[1]["ts"] = None
    assert {r.seq: r.decision for r in gaps.decide(frame(spark, rows)).collect()}[1] == "dropped"


def test_older_producer_without_success_flag(spark):
    rows = scenario("G F(5) G F(-1)")
    for r in rows:
        r["is_success"] = None
    got = {r.seq: r.decision for r in gaps.decide(frame(spark, rows), "strict").collect()}
    assert [got[i] for i in range(4)] == ["command", "filled", "command", "fill_error"]


def test_synthetic_row(spark):
    rows = scenario("G F(5)")
    compat = gaps.cdc_output(gaps.decide(frame(spark, rows))).first()
    assert (compat.type, compat.entity, compat.event_id, compat.ts) == ("F", "123", None, None)
    strict = gaps.cdc_output(gaps.decide(frame(spark, rows), "strict"), "strict").first()
    assert (strict.entity, strict.event_id, strict.ts) == ("Employee", "e1", 5)
    assert gaps.cdc_output(gaps.decide(frame(spark, rows), "strict"), "strict", cutoff_unit="s").first().ts == 5000


def test_units_of_the_sources(spark):
    """Milliseconds of the year 1972 are no seconds, unless a guess is asked for."""
    old = frame(spark, scenario("G@80000000000 N@80000000000 F(79000000000)"))
    fate = lambda rows, **units: {r.seq: r.decision for r in gaps.decide(rows, "strict", **units).collect()}[1]
    assert fate(old) == "flushed" and fate(old, cutoff_unit="s") == "dropped"
    mixed = frame(spark, scenario("G@1700000000 N@1700000000 F(1699999999000)"))
    assert fate(mixed) == "dropped" and fate(mixed, ts_unit="s") == "flushed"


def test_outputs_of_failed_gaps(spark):
    rows = frame(spark, scenario("G@1 N@2 N@12 G@13 N@14 F(0)@15")).withColumn("rec_ts", F.col("arrived") * 100)
    decided = limits.decide_limited(rows, 10, None)
    out = gaps.cdc_output(decided).orderBy("out_seq", "out_pos").collect()
    assert [(r.seq, r.type, r.rec_ts) for r in out] == [(2, "N", 1200), (5, "F", 1500), (4, "N", 1500)]
    errors = gaps.error_output(decided).orderBy("seq").collect()
    assert [(r.seq, r.decision, r.cause_seq, r.message) for r in errors] == [(0, "gap_failed", None, "timeout"), (1, "dead_letter", 0, None)]
    assert counters.gap_counters(decided).first().fill_commands_timeout == 1


def test_quiet_gap_as_of_an_instant(spark):
    rows = frame(spark, scenario("G@1 N@2"))
    fate = lambda at: [r.decision for r in limits.decide_limited(rows, 10, None, as_of=at).orderBy("seq").collect()]
    assert fate(11) == ["command", "pending"] and fate(12) == ["command", "dead_letter"]


def test_times_that_run_backwards(spark):
    """The latest arrival so far counts, in the windows as in the stream."""
    rows = scenario("G@1 N@20 N@3 G@4 N@5 F(0)@6")
    got = {r.seq: r.decision for r in limits.decide_limited(frame(spark, rows), 10, None).collect()}
    assert [got[i] for i in range(6)] == ["command", "forwarded", "forwarded", "command", "flushed", "filled"]


def test_failed_fill_without_gap_asks_for_nothing(spark):
    from mendline.operators import tables
    rows = scenario("F(-1!)", "a") + scenario("G N F(-1!)", "b") + scenario("G N F(-1!) G F(5)", "c") + scenario("G F(-1!) G F(-1!)", "d")
    got = tables.replay_failed_gaps(gaps.decide(frame(spark, rows), "strict")).collect()
    assert {(r.record_id, r.event_id, r.failed_seq) for r in got} == {("b", "e0", 2), ("d", "e2", 3)}


def test_first_answer_stays(spark):
    df = spark.createDataFrame([("1", "a", -1, False, 5), ("1", "a", 5000, True, 9), ("1", "a", 7000, True, 11), ("1", "b", -1, False, 3)],
                               "record_id string, event_id string, cutoff bigint, is_success boolean, rec_ts bigint")
    pick = lambda mode: {r.event_id: r.cutoff for r in gaps.dedupe_fills(df, mode=mode).collect()}
    assert pick("compat") == {"a": -1, "b": -1} and pick("strict") == {"a": 5000, "b": -1}


def test_unknown_mode_is_refused(spark):
    with pytest.raises(ValueError):
        gaps.decide(frame(spark, scenario("N")), "loose")
