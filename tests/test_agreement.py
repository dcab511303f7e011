"""Windows, with and without split records, and link chains against the plain fold on random rows."""

import pytest

from fold import fold
from mendline.operators import gaps, limits
from mendline.operators.ordered import DEFAULT, Layout
from rows import frame, rand_rows

LAYOUTS = {"whole": DEFAULT, "split": Layout(hot_rows=10), "fine": Layout(hot_rows=1)}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_decisions_and_replay(spark, mode, layout):
    rows = rand_rows(f"{mode}", 400)
    decision, place, _ = fold(rows, mode)
    decided = gaps.decide(frame(spark, rows), mode, LAYOUTS[layout])
    got = gaps.replayed(decided, mode, LAYOUTS[layout]).collect()
    assert {(r.record_id, r.seq): r.decision for r in got} == decision
    assert {(r.record_id, r.seq): r.pos for r in got if r.pos is not None} == place


@pytest.mark.parametrize("timeout,most,layout", [
    (60, None, "split"), (None, 3, "split"), (60, 3, "whole"), (60, 3, "split"), (5, 1, "fine"),
    (100_000, 100_000, "split"), (0, 0, "split")])
def test_limits(spark, timeout, most, layout):
    rows = rand_rows(f"limits {timeout} {most}", 400)
    decision, _, failed = fold(rows, "compat", timeout, most)
    decided = limits.decide_limited(frame(spark, rows), timeout, most, layout=LAYOUTS[layout])
    assert {(r.record_id, r.seq): r.decision for r in decided.collect()} == decision
    assert {(r.record_id, r.open_seq): r.failed for r in limits.failed_gaps(decided).collect()} == failed


def test_limits_strict(spark):
    rows = rand_rows("strict limits", 400)
    decided = limits.decide_limited(frame(spark, rows), 60, 3, "strict", LAYOUTS["split"])
    assert {(r.record_id, r.seq): r.decision for r in decided.collect()} == fold(rows, "strict", 60, 3)[0]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_episodes(spark, layout):
    rows = rand_rows("episodes", 400)
    decision, _, _ = fold(rows)
    want, current, number = {}, {}, {}
    for r in rows:
        rec, d = r["record_id"], decision[r["record_id"], r["seq"]]
        if d == "command":
            number[rec] = number.get(rec, 0) + 1
            current[rec] = want[rec, number[rec]] = {"open": r["seq"], "close": None, "held": 0, "flushed": 0}
        elif d == "filled":
            current[rec]["close"] = r["seq"]
        elif d in ("flushed", "dropped", "pending"):
            current[rec]["held"] += 1
            current[rec]["flushed"] += d == "flushed"
    got = gaps.episodes(gaps.decide(frame(spark, rows), layout=LAYOUTS[layout]), LAYOUTS[layout]).collect()
    assert {(r.record_id, r.episode): {"open": r.open_seq, "close": r.close_seq, "held": r.n_buffered,
                                       "flushed": r.n_flushed} for r in got} == want
