"""Tables that streams keep: whatever the order and the cut of what arrives, they end up as the table forms say."""

import random
import time

import pytest
from pyspark.sql import functions as F

from mendline.operators import gaps, retries, tables
from mendline.sources import io
from mendline.streaming import engine, kept
from rows import frame, rand_rows
from test_streaming import deliver


def shuffled(spark, rows, schema, seed):
    """Rows with an order of arrival of their own."""
    order = list(range(len(rows)))
    random.Random(seed).shuffle(order)
    return spark.createDataFrame([(*r, i) for r, i in zip(rows, order)], f"{schema}, arrival bigint")


# --- images -----------------------------------------------------------------------------------------

CHANGES = "record_id string, at bigint, is_full boolean, fields map<string,string>"


def folded(changes):
    images = {}
    for rec, _, is_full, fields in sorted(changes, key=lambda c: (c[1] is not None, c[1] or 0)):
        image = images.setdefault(rec, {})
        if is_full:
            image.clear()
        image.update(fields or {})
    return images


@pytest.mark.parametrize("n", [1, 2, 5])
def test_images_in_any_order(spark, tmp_path, n):
    rnd = random.Random(n)
    changes = [(f"r{rnd.randrange(3) if rnd.random() < .6 else 0}", i, rnd.random() < .1,
                rnd.choice([None, {}, {f"f{rnd.randrange(5)}": rnd.choice([None, str(i)])}, {"a": f"{i}", "b": "é"}]))
               for i in range(150)] + [("empty", 5, True, {}), (None, 3, False, {"a": "null key"}), ("late", None, False, {"a": "no place"}),
                                       ("late", 1, False, {"b": "1"})]
    written = deliver(shuffled(spark, changes, CHANGES, n), ["arrival"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: kept.images(s.drop("arrival")), n)
    got = {r.record_id: r.image for r in kept.newest_images(written).collect()}
    assert got == {rec: image for rec, image in folded(changes).items()}
    versions = written.groupBy("record_id").agg(F.max("version").alias("last"), F.count("*").alias("n")).collect()
    assert all(r.last == r.n <= n for r in versions)


def test_images_behind_the_gap_handler(spark, tmp_path):
    rows = rand_rows("image", 200)
    df = frame(spark, rows).withColumn("payload", F.concat(F.lit('{"f'), F.col("seq") % 4, F.lit('":"'), F.col("seq"), F.lit('"}')))
    written = deliver(df, ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: kept.images(kept.emitted_changes(engine.gap_stream(s))), 3)
    table = df.withColumns({"fields": F.from_json("payload", "map<string,string>"), "type": F.col("kind"), "replay_id": F.col("seq")})
    want = tables.images(gaps.cdc_output(gaps.decide(table), keep=["fields"]))
    images = lambda t: {r.record_id: r.image for r in t.collect()}
    assert images(kept.newest_images(written)) == images(want) != {}


# --- missing numbers --------------------------------------------------------------------------------

@pytest.mark.parametrize("n,block", [(1, 1 << 16), (2, 7), (5, 16), (4, 1)])
def test_missing_numbers_under_any_arrival(spark, tmp_path, n, block):
    rnd = random.Random(n)
    rows = [(src, rnd.randrange(-60, 160)) for src in ("a", "a", "b") for _ in range(90)] + [("c", 5), ("c", 5), ("d", None), (None, 3), (None, 9)]
    df = shuffled(spark, rows, "source string, id bigint", n)
    written = deliver(df, ["arrival"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", lambda s: kept.seen_runs(s, "id", ["source"], block), n)
    want = set()
    for source in {s for s, _ in rows}:
        ids = sorted({i for s, i in rows if s == source and i is not None})
        want |= {(source, a + 1, b - 1, b - a - 1) for a, b in zip(ids, ids[1:]) if b - a > 1}
    got = [tuple(r) for r in kept.missing(written, ["source"]).collect()]
    assert set(got) == want and len(got) == len(want)
    # A run is put out and taken back in turns.
    assert {r.n for r in written.groupBy("source", "block", "from_id", "to_id").agg(F.sum("change").alias("n")).collect()} <= {0, 1}


def test_one_sequence_without_keys(spark, tmp_path):
    df = spark.createDataFrame([(n, -n) for n in (*range(1, 40), *range(70, 90), 200)], "id bigint, arrival bigint")
    written = deliver(df, ["arrival"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", lambda s: kept.seen_runs(s, "id", block=10), 3)
    assert sorted(map(tuple, kept.missing(written).collect())) == [(40, 69, 30), (90, 199, 110)]


# --- outages ----------------------------------------------------------------------------------------

def attempts(seed, n=140):
    rnd, now, out = random.Random(seed), 0, []
    for seq in range(n):
        now += rnd.choice([1, 20, 150])
        source = rnd.choice(["A", "A", "A", "B", None])
        out.append((source, seq, now, rnd.choices(["transient", "success", "permanent"], (75, 20, 5))[0]))
    return out + [("quiet", n, now + 1, "transient"), ("A", n + 1, now + 500, "success"), ("late", n + 2, now + 501, "transient")]


@pytest.mark.parametrize("n", [1, 2, 5])
def test_alarms_are_the_breached_windows(spark, tmp_path, n):
    rows = attempts(n)
    df = spark.createDataFrame(rows, "entity_type string, seq bigint, ts bigint, outcome string")
    written = deliver(df, ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out", lambda s: kept.outages(s, limit_ms=300), n)
    windows = retries.outage_windows(df, limit_ms=300, as_of=max(r[2] for r in rows)).collect()
    alarms = [(r.entity_type, r.started) for r in written.filter("kind = 'breach'").collect()]
    assert sorted(alarms, key=str) == sorted(((r.entity_type, r.started) for r in windows if r.breached), key=str)
    assert ("quiet", rows[-3][2]) in alarms and not any(r[0] == "late" for r in alarms)
    ended = {(r.entity_type, r.started, r.last_failure, r.at, r.n_failures) for r in written.filter("kind = 'ended'").collect()}
    assert ended == {(r.entity_type, r.started, r.last_failure, r.ended, r.n_failures) for r in windows if r.ended is not None}


# --- duplicate answers ------------------------------------------------------------------------------

def test_answers_are_forgotten(spark, tmp_path):
    schema = "record_id string, event_id string, cutoff bigint, rec_offset bigint"
    stream = lambda: kept.first_fills(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), keep_ms=3_000)

    def send(*rows):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(f"{tmp_path}/in")
        out = engine.run_to_end(stream(), f"{tmp_path}/out", f"{tmp_path}/cp", idle=False).collect()
        state = spark.read.format("statestore").option("path", f"{tmp_path}/cp").option("stateVarName", "seen").load()
        return sorted((r.record_id, r.event_id, r.cutoff) for r in out), state.select("key.event_id").collect()

    out, state = send(("a", "e1", 1, 4), ("a", "e1", 2, 3), ("a", "e2", 3, 5), ("b", "e1", 4, 6))
    assert out == [("a", "e1", 2), ("a", "e2", 3), ("b", "e1", 4)] and len(state) == 3
    time.sleep(4)
    out, state = send(("c", "e9", 5, 7))
    assert len(out) == 4 and [r.event_id for r in state] == ["e9"]


# --- current state ----------------------------------------------------------------------------------

STATE = "record_id string, seq bigint, value string"


def newest(rows):
    best = {}
    for rec, seq, value in rows:
        rank = (seq is not None, seq or 0, value is not None, value or "")
        if rec not in best or best[rec][0] < rank:
            best[rec] = rank, (rec, seq, value)
    return {row for _, row in best.values()}


@pytest.mark.parametrize("n", [1, 2, 5])
def test_upsert_in_any_order(spark, tmp_path, n):
    rnd = random.Random(n)
    rows = [(f"r{rnd.randrange(30) if rnd.random() < .6 else 0}", i // 2, f"v{i}") for i in range(120)]
    rows += rows[:3] + [(None, 1, "x"), (None, None, "y"), ("none", None, None)]
    df = shuffled(spark, rows, STATE, n)
    table = kept.UpsertTable(spark, f"{tmp_path}/table", STATE, buckets=8)
    stream = lambda: spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    for i in range(n):
        df.filter(F.col("arrival") % n == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        table.follow(stream(), f"{tmp_path}/cp")
    got = [tuple(r) for r in table.read().collect()]
    assert set(got) == newest(rows) and len(got) == len(newest(rows))
    assert len(table.manifests()) == n and (table.vacuum() > 0) == (n > 1)
    assert {tuple(r) for r in table.read().collect()} == set(got) and table.vacuum() == 0


def test_repeated_and_broken_batches(spark, tmp_path):
    table = kept.UpsertTable(spark, f"{tmp_path}/table", STATE, buckets=16)
    batch = lambda *rows: spark.createDataFrame(rows, STATE)
    assert table.read().count() == 0
    table.merge(batch(("a", 1, "1"), ("b", 1, "1")), 0)
    first = table.versions()
    # A batch that broke off before its manifest leaves no trace.
    batch(("a", 9, "broken")).withColumn("bucket", F.lit(min(first))).write.partitionBy("bucket").parquet(f"{tmp_path}/table/data/{1:010d}")
    assert {tuple(r) for r in table.read().collect()} == {("a", 1, "1"), ("b", 1, "1")}
    table.merge(batch(("a", 2, "2")), 1)
    table.merge(batch(("a", 3, "not this: the batch is in")), 1)
    table.merge(batch(), 2)
    assert {tuple(r) for r in table.read().collect()} == {("a", 2, "2"), ("b", 1, "1")}
    # Only the touched bucket has a new version.
    assert sum(v != first.get(b) for b, v in table.versions().items()) == 1
    with pytest.raises(ValueError):
        table.merge(batch(("a", 5, "5")), -1)
