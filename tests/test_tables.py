"""Lookups, retries, tables, counters and sequences against plain Python, with and without split keys."""

import random

import pytest
from pyspark.sql import functions as F

from mendline import schemas as S
from mendline.operators import counters, gaps, lookup, retries, tables
from mendline.operators.ordered import DEFAULT, Layout, cut_hot_keys, is_cut, number_rows, scan

LAYOUTS = {"whole": DEFAULT, "split": Layout(hot_rows=10)}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_scan(spark, layout):
    rnd = random.Random(1)
    rows = [(f"k{0 if rnd.random() < .5 else rnd.randrange(3)}", i, rnd.choice([None, rnd.randrange(100)])) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, seq bigint, x int")
    got = scan(df, LAYOUTS[layout], before={"b": F.col("x")}, after={"a": F.col("x")}, max_before={"m": F.col("x")},
               count_before={"c": F.col("x") > 50}).collect()
    for r in got:
        own = [(s, x) for k, s, x in rows if k == r.record_id and x is not None]
        early, late = [x for s, x in own if s < r.seq], [x for s, x in own if s > r.seq]
        assert (r.b, r.a, r.m, r.c) == (early[-1] if early else None, late[0] if late else None,
                                        max(early, default=None), sum(x > 50 for x in early))
    assert len(got) == 200


def test_scan_on_times(spark):
    rows = [("k", t, i) for i, t in enumerate([0, 0, 0, 1, 5, 1000, 1001, 50_000, 50_000, 99_999])]
    df = spark.createDataFrame(rows, "record_id string, at bigint, seq bigint")
    layout = Layout(hot_rows=3, order=("at", "seq"))
    got = scan(df, layout, before={"b": F.col("seq")}, after={"a": F.col("seq")}).orderBy("seq").collect()
    assert [r.b for r in got] == [None, *range(9)] and [r.a for r in got] == [*range(1, 10), None]
    assert len({r.part for r in got}) > 1


@pytest.mark.parametrize("newest_first", [False, True])
@pytest.mark.parametrize("layout", LAYOUTS)
def test_number_rows(spark, layout, newest_first):
    rows = [("a", i, i // 37, i % 3 == 0) for i in range(150)] + [("b", i, 0, True) for i in range(5)]
    df = spark.createDataFrame(rows, "record_id string, seq bigint, run int, keep boolean")
    got = number_rows(df, "n", "run", LAYOUTS[layout], where=F.col("keep"), newest_first=newest_first).collect()
    for r in got:
        mates = [s for k, s, run, keep in rows if (k, run) == (r.record_id, r.run) and keep]
        mates.sort(reverse=newest_first)
        assert r.n == (mates.index(r.seq) + 1 if r.keep else None)


def test_lookup(spark):
    commands = spark.createDataFrame([("1", "E", "a", 1), ("2", "E", "b", 2), ("3", "E", "c", 3), ("1", "E", "d", 4),
                                      ("4", "E", "e", 5)], "record_id string, entity_type string, event_id string, seq bigint")
    stamped = '{"n":1,"lastModifiedEpochMs":%s}'
    images = spark.createDataFrame([("1", "E", stamped % 77), ("1", "E", stamped % 66), ("1", "E", "not json {"), ("2", "E", stamped % '"n/a"'),
                                    ("4", "E", "{}"), ("5", "E", stamped[:9])], "record_id string, entity_type string, image string")
    commands = commands.unionByName(spark.createDataFrame([("5", "E", "f", 6)], commands.schema))
    fills = {r.event_id: r for r in lookup.fill_lookup(commands, images, "http://host").collect()}
    assert [(fills[e].cutoff, fills[e].is_success) for e in "abcdef"] == [
        (77, True), (-1, False), (-1, False), (77, True), (-1, False), (-1, False)]
    assert fills["f"].err == "bad image: http://host/E/5" and fills["b"].err == "bad modification time: n/a"
    assert fills["c"].err == "not found: http://host/E/3" 
    assert fills["e"].err == "bad modification time: none" and fills["a"].err == ""
    assert {r.event_id for r in lookup.fill_lookup_hits(commands, images).collect()} == {"a", "d"}
    assert {r.event_id for r in lookup.fill_lookup_misses(commands, images).collect()} == {"c"}
    both = lookup.fill_lookup(commands, images).select("record_id", "event_id", "cutoff", F.col("seq").alias("rec_ts"))
    assert gaps.dedupe_fills(both.unionByName(both)).count() == 6


def test_outcomes(spark):
    df = spark.createDataFrame([(s,) for s in ("200", "404", "400", "503", "timeout", "bad_json", "302")], "s string")
    got = [r.o for r in df.select(lookup.outcome_class(F.col("s")).alias("o")).collect()]
    assert got == ["success", "permanent", "permanent", "transient", "transient", "permanent", "transient"]


@pytest.mark.parametrize("layout", LAYOUTS)
def test_retries_and_outages(spark, layout):
    rnd = random.Random(3)
    rows, now = [], 0
    for i in range(200):
        now += rnd.choice((1_000, 60_000, 300_000))
        rows.append(("r", rnd.choice("AAB"), i, now, rnd.choice(["transient", "transient", "success", "permanent"])))
    df = spark.createDataFrame(rows, "record_id string, entity_type string, seq bigint, ts bigint, outcome string")
    windows, delays = set(), {}
    for source in "AB":
        start = last = None
        n = 0
        for _, _, seq, ts, outcome in (r for r in rows if r[1] == source):
            if outcome == "transient":
                start, last, n = start or ts, ts, n + 1
                delays[seq] = (n, min(60_000, 1_000 * 2 ** (n - 1)))
            elif n:
                windows.add((source, start, last, ts, n, ts - start > 600_000))
                start, n = None, 0
        if n:
            windows.add((source, start, last, None, n, last - start > 600_000))
    got = retries.outage_windows(df, LAYOUTS[layout])
    assert {tuple(r) for r in got.collect()} == windows
    got = retries.retry_schedule(df, LAYOUTS[layout]).collect()
    assert {r.seq: (r.attempt, r.delay_ms) for r in got} == delays
    assert all(abs(r.jittered_ms - r.delay_ms) <= r.delay_ms * 0.2 for r in got)
    assert {r.delay_ms for r in retries.retry_schedule(df, LAYOUTS[layout], doubling=False).collect()} == {1000}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_sequences(spark, layout):
    rnd = random.Random(5)
    ids = sorted(rnd.sample(range(500), 200))
    df = spark.createDataFrame([(i,) for i in ids + ids[:50]], "replay_id bigint")
    got = {(r.from_id, r.to_id, r.n_missing) for r in tables.replay_gaps(df, "replay_id", LAYOUTS[layout]).collect()}
    assert got == {(a + 1, b - 1, b - a - 1) for a, b in zip(ids, ids[1:]) if b - a > 1}


@pytest.mark.parametrize("layout", LAYOUTS)
def test_change_capture(spark, layout):
    rows = [("1", i, v, p) for i, (v, p) in enumerate([("a", 1), ("a", 1), ("b", None), ("b", None), ("b", 2), ("c", 3)])]
    df = spark.createDataFrame(rows, "record_id string, seq bigint, name string, boss int")
    got = {r.seq: dict(r.changed) for r in tables.change_capture(df, ["name", "boss"], LAYOUTS[layout]).collect()}
    assert got == {2: {"name": "b", "boss": None}, 4: {"boss": "2"}, 5: {"name": "c", "boss": "3"}}


def test_images(spark):
    rows = [("1", 1, 0, "N", {"a": "1", "b": "1"}), ("1", 2, 0, "F", {"a": "2", "c": "2"}), ("1", 2, 1, "N", {"c": "3"}),
            ("2", 1, 0, "N", {"a": "9"}), ("2", 5, 0, "N", {"b": None}), ("3", 1, 0, "N", {"a": "1"}), ("3", 2, 0, "F", {}),
            ("4", 1, 0, "N", {"x": "1"}), ("4", 2, 0, "N", {"": "q"})]
    df = spark.createDataFrame(rows, "record_id string, out_seq bigint, out_pos bigint, type string, fields map<string,string>")
    got = {r.record_id: dict(r.image) for r in tables.images(df).collect()}
    assert got == {"1": {"a": "2", "c": "3"}, "2": {"a": "9", "b": None}, "3": {}, "4": {"": "q", "x": "1"}}


def test_stretches_follow_the_data(spark):
    """Sparse ids and a burst in time give stretches of about `hot_rows` rows."""
    for ids in ([i * 4_000_000_000 for i in range(200)], [10**12 + i % 50 for i in range(100)] + [0, 10**15]):
        df = spark.createDataFrame([("k", x, i) for i, x in enumerate(ids)], "record_id string, at bigint, seq bigint")
        for layout in (Layout(hot_rows=20, order=("at", "seq")), Layout(keys=(), hot_rows=20, order=("at", "seq"))):
            sizes = [r["count"] for r in cut_hot_keys(df, layout).groupBy("part").count().collect()]
            assert 4 <= len(sizes) <= 11 and max(sizes) <= 45


def test_even_keys_are_not_cut(spark):
    df = spark.range(100).selectExpr("id % 10 AS record_id", "id AS seq")
    cut = cut_hot_keys(df, Layout(hot_rows=10))
    assert not is_cut(cut) and cut.filter("part IS NOT NULL").count() == 0


def test_current_state_and_counts(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, None)], "record_id string, seq bigint, v string")
    assert {tuple(r) for r in tables.current_state(df).collect()} == {("a", 3, None), ("b", 2, "y")}
    assert [tuple(r) for r in tables.distinct_records(df).collect()] == [("a", 1), ("b", 2)]
    assert tables.record_count(df).first().n_records == 2


# Two recorded counter samples of the system this replaces (fixed values).
SAMPLES = [dict(received=114, forwarded=91, detected=20, buffered=3, filled=15),
           dict(received=191, forwarded=161, detected=20, buffered=10, filled=20)]


@pytest.mark.parametrize("sample", SAMPLES)
def test_recorded_counters(spark, sample):
    rows = ([("forwarded",)] * sample["forwarded"] + [("command",)] * sample["detected"]
            + [("dropped",)] * sample["buffered"] + [("filled",)] * sample["filled"])
    decided = spark.createDataFrame(rows, "decision string")
    report = {r.name: r.value for r in counters.counter_report(decided).collect()}
    assert report[S.RECEIVED] == sample["received"] and report[S.FORWARDED] == sample["forwarded"]
    assert report[S.GAP_DETECTED] == report[S.COMMAND_PUBLISHED] == sample["detected"]
    assert report[S.BUFFERED] == sample["buffered"] and report[S.BUFFER_FLUSHED] == 0.0
    assert report[S.FILLED] == report[S.FILL_RECEIVED] == sample["filled"]
    assert report[S.NOT_NORMAL] == report[S.DETECTED_OR_BUFFERED] and report[S.BALANCED] == 1.0
    assert list(report) == sorted(report)


def test_invalid_rows_break_the_balance(spark):
    decided = spark.createDataFrame([("invalid",), ("forwarded",), ("command",)], "decision string")
    r = counters.conservation(decided).first()
    assert (r.not_normal, r.detected_or_buffered, r.invalid_events, r.balanced, r.balanced_valid) == (2, 1, 1, False, True)


def test_upper(spark):
    df = spark.createDataFrame([("1", "aß")], "id string, payload string")
    assert tables.upper_payload(df).first().payload == "ASS"


def test_parse_long_strict(spark):
    from mendline.functions import parse_long_strict
    df = spark.createDataFrame([("12",), ("n/a",)], "x string")
    assert df.filter("x = '12'").select(parse_long_strict(F.col("x")).alias("v")).first().v == 12
    with pytest.raises(Exception, match="not a number"):
        df.select(parse_long_strict(F.col("x"))).collect()


def test_epoch_ms_ignores_the_session_zone(spark):
    from mendline.functions import epoch_ms
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:  # 02:30 does not exist on that day in New York
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123999' AS ts")
        assert df.select(epoch_ms(F.col("ts")).alias("v")).first().v == 1710037800123
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stored_results_are_columns_and_can_be_released(spark):
    from mendline.sources import io
    kept = io.stored(spark.range(10).withColumn("x", F.lit("a")), "kept")
    path = kept.inputFiles()[0].rpartition("/")[0]
    assert path.startswith(("file:", "/")) and kept.schema.names == ["id", "x"] and kept.count() == 10
    assert io.release(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
