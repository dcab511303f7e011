"""Fills matched to the command they answer: no cut of either source changes the result."""

import random

import pytest
from pyspark.sql import functions as F

from mendline.streaming import engine, processor

WAIT = 60


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = tuple(value)

    def clear(self):
        self.value = None


class List(Value):
    def get(self):
        return iter(self.value or ())

    def appendList(self, rows):
        self.value = (*(self.value or ()), *rows)


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, key, value):
        self[tuple(key)] = tuple(value)

    def removeKey(self, key):
        del self[tuple(key)]


class Handle:
    """State in memory, for one record."""

    def getValueState(self, name, schema):
        return Value()

    def getListState(self, name, schema):
        return List()

    def getMapState(self, name, key, value):
        return Map()


def rows_of(seed):
    """Changes and fills of one record; fills name commands, now and then twice, wrongly, or none, and lie before or behind them."""
    pick = random.Random(seed)
    cdc, fills, now = [], [], 100
    for i in range(pick.randint(1, 25)):
        now += pick.choice((0, 1, 5, 30, 90))
        kind = pick.choice("NNG")
        cdc.append(dict(kind=kind, rec_ts=now - pick.choice((0, 0, 40)), ts=now, event_id=f"e{pick.randrange(4) if pick.random() < 0.2 else i}"))
    for g in [r for r in cdc if r["kind"] == "G"] + [{"event_id": "other", "rec_ts": 200}, {"event_id": None, "rec_ts": 150}]:
        for _ in range(pick.choice((0, 1, 1, 1, 2))):
            cutoff = pick.choice((g["rec_ts"] - 10, g["rec_ts"] + 1000, -1))
            fills.append(dict(kind="F", rec_ts=g["rec_ts"] + pick.choice((-100, -20, 0, 3, 40, 200)), event_id=g["event_id"], cutoff=cutoff,
                              is_success=cutoff >= 0, force=pick.random() < 0.3))
    pick.shuffle(fills)
    for rank, rows in enumerate((cdc, fills)):
        latest = None
        for offset, r in enumerate(rows):
            latest = r["rec_ts"] if latest is None else max(latest, r["rec_ts"])
            r.update(rec_offset=offset, source_rank=rank, seq=2 * offset + rank, at=latest)
    full = dict.fromkeys(processor._CARRIED)
    return [full | r for r in cdc], [full | r for r in fills]


def plain(cdc, fills):
    """What becomes of each row, knowing all."""
    place = lambda r: (r["at"], r["source_rank"], r["rec_offset"])
    ok = lambda f: f["is_success"]
    decision, used, closed, passed, waits = {}, set(), None, None, False
    for r in cdc:
        if waits:
            decision[r["seq"]] = "gap_dropped" if r["kind"] == "G" else "pending"
            continue
        passed = r["at"]
        if closed and place(r) < closed[0]:
            newer = r["ts"] > closed[1]["cutoff"]
            decision[r["seq"]] = "gap_dropped" if r["kind"] == "G" else "dead_letter" if not ok(closed[1]) else "flushed" if newer else "dropped"
        elif r["kind"] == "N":
            decision[r["seq"]], closed = "forwarded", None
        else:
            decision[r["seq"]], closed = "command", None
            fit = [f for f in fills if f["event_id"] == r["event_id"] and f["seq"] not in used and r["at"] <= f["at"] + WAIT]
            if fit:
                fill = fit[0]
                used.add(fill["seq"])
                decision[fill["seq"]] = "filled" if ok(fill) else "fill_error"
                closed = (max(place(fill), place(r)), fill)
            else:
                waits = True
    for f in fills:
        if f["seq"] not in used:
            gone = f["event_id"] is None or passed is not None and passed > f["at"] + WAIT
            decision[f["seq"]] = "fill_error" if not ok(f) else "forced" if gone and f["force"] else "fill_ignored"
    return decision


def run(deliveries):
    handler = processor.GapProcessor("strict", match=True, wait_ms=WAIT)
    handler.init(Handle())
    decision, sent = {}, []
    for rows in deliveries:
        for out in handler.handleInputRows(("r",), iter(rows), None):
            assert decision.get(out.seq) in (None, *engine.WAITING), "one last word on every row"
            decision[out.seq] = out.decision
            if out.emitted is not None and out.decision not in ("forced", "fill_error"):
                sent.append((out.emitted, out.seq, out.decision))
    numbers = [n for n, _, _ in sent]
    assert numbers == sorted(numbers)
    return {k: engine.WAITING.get(d, d) for k, d in decision.items()}, [x[1:] for x in sent]


def cut(pick, rows):
    marks = sorted(pick.choices(range(len(rows) + 1), k=pick.randint(0, 4)))
    return [rows[a:b] for a, b in zip([0, *marks], [*marks, len(rows)])]


@pytest.mark.parametrize("seed", range(40))
def test_independent_cuts_of_both_sources_give_one_result(seed):
    cdc, fills = rows_of(seed)
    want, order = plain(cdc, fills), None
    pick = random.Random(seed)
    for _ in range(50):
        parts = [*((0, x) for x in cut(pick, cdc)), *((1, x) for x in cut(pick, fills))]
        order_of = sorted(range(len(parts)), key=lambda i: pick.random())
        # Any interleaving that keeps each source's order; neighbouring deliveries may make one micro-batch.
        queues = {rank: [x for r, x in parts if r == rank] for rank in (0, 1)}
        batches = []
        for i in order_of:
            rows = queues[parts[i][0]].pop(0)
            if batches and pick.random() < 0.3:
                batches[-1] = batches[-1] + rows
            else:
                batches.append(list(rows))
        for b in batches:
            pick.shuffle(b)
        got, sent = run(batches)
        assert got == want
        order = sent if order is None else order
        assert sent == order


def test_the_fill_that_lies_before_its_marker():
    """Marker and change come on one topic, the fill on the other with an earlier time: whichever is read first, the gap is filled."""
    full = dict.fromkeys(processor._CARRIED)
    gap = full | dict(kind="G", rec_ts=100, ts=100, event_id="e", rec_offset=0, source_rank=0, seq=0)
    change = full | dict(kind="N", rec_ts=110, ts=110, event_id="n", rec_offset=1, source_rank=0, seq=2)
    fill = full | dict(kind="F", rec_ts=50, event_id="e", cutoff=5, is_success=True, rec_offset=0, source_rank=1, seq=1)
    for batches in ([[gap, change, fill]], [[gap, change], [fill]], [[fill], [gap, change]], [[gap], [fill], [change]]):
        assert run(batches) == ({0: "command", 1: "filled", 2: "forwarded"}, [(0, "command"), (1, "filled"), (2, "forwarded")])


def test_match_goes_with_strict_alone():
    for options in ({"mode": "compat"}, {"mode": "strict", "timeout_ms": 5}, {"mode": "strict", "max_buffer": 5}):
        with pytest.raises(ValueError):
            processor.GapProcessor(match=True, **options)


def test_matching_on_the_state_store(spark, tmp_path):
    """Several records, each source delivered on its own: fills first, then changes, and the other way round."""
    rows = []
    for seed in range(30):
        for r in sum(rows_of(seed), []):
            rows.append({"record_id": f"r{seed}"} | {c: r[c] for c in processor._CARRIED})
    schema = "record_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in processor.state_schema())
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    want = {(f"r{seed}", k): d for seed in range(30) for k, d in plain(*rows_of(seed)).items()}
    for first in (0, 1):
        folder = f"{tmp_path}/{first}"
        for rank in (first, 1 - first):
            df.filter(F.col("source_rank") == rank).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            stream = engine.gap_stream(spark.readStream.schema(df.schema).parquet(f"{folder}/in"), "strict", match=True, wait_ms=WAIT)
            written = engine.run_to_end(stream, f"{folder}/out", f"{folder}/cp")
        assert {(r.record_id, r.seq): r.decision for r in engine.final_decisions(written).collect()} == want
    assert {"filled", "flushed", "dropped", "forced", "dead_letter", "pending"} <= set(want.values())
