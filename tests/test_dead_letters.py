"""Dead letters are settled once each, behind the fill that their record is asked for."""

import pytest
from pyspark.sql import functions as F

from mendline.operators import deadletters, gaps, limits
from mendline.operators.ordered import Layout
from mendline.sources import io
from mendline.streaming import engine
from rows import frame, rand_rows
from test_streaming import deliver

SCHEMA = "record_id string, seq bigint, open_seq bigint, type string, event_id string, entity string, ts bigint, payload string"
FILL = "record_id string, event_id string, cutoff bigint, is_success boolean, payload string"


def letters_of(spark, rows):
    return deadletters.dead_letters(io.stored(limits.decide_limited(frame(spark, rows), 60, 3, "strict")))


def plain(letters, fills):
    """Rows by record: the fill, then what is newer in order; what isn't has no place."""
    out = []
    for rec, cutoff in fills.items():
        mine = sorted((r for r in letters if r.record_id == rec), key=lambda r: r.seq)
        newer = [r for r in mine if r.ts > cutoff]
        out += [(rec, None, "filled", 0)] * bool(mine) + [(rec, r.seq, "flushed", i + 1) for i, r in enumerate(newer)]
        out += [(rec, r.seq, "dropped", None) for r in mine if r not in newer]
    return sorted(out, key=str)


def view(df):
    return sorted(((r.record_id, r.seq, r.decision, r.pos) for r in df.collect()), key=str)


@pytest.mark.parametrize("layout", [Layout(), Layout(hot_rows=7)])
def test_every_dead_letter_once(spark, tmp_path, layout):
    rows = rand_rows("letters", 400)
    letters = letters_of(spark, rows)
    all_letters = letters.collect()
    middle = sorted(r.ts for r in all_letters)[len(all_letters) // 2]
    records = sorted({r.record_id for r in all_letters})
    assert len(records) >= 3 and len(all_letters) > 20
    ledger = deadletters.Ledger(spark, f"{tmp_path}/ledger", SCHEMA)
    assert ledger.open().count() == 0 and ledger.settled().count() == 0
    # Batches overlap and are repeated.
    for batch, part in ((0, "seq < 200"), (1, "seq >= 150"), (1, "seq >= 150"), (0, "seq < 200")):
        ledger.keep(letters.filter(part), batch)
    assert ledger.open().count() == len(all_letters)
    assert [(r.record_id, r.event_id) for r in ledger.commands().orderBy("record_id").collect()] == [
        (rec, min((r.seq, r.event_id) for r in all_letters if r.record_id == rec)[1]) for rec in records]
    fills = spark.createDataFrame([
        (records[0], "a", middle, True, "{}"), (records[0], "b", middle - 5, True, "{}"), (records[1], "c", -1, False, "{}"), ("none", "d", 1, True, "{}")], FILL)
    want = plain(all_letters, {records[0]: middle})
    for _ in range(2):  # a repeated run replaces itself
        assert view(ledger.replay(fills, 1, layout=layout)) == want
    assert view(ledger.settled()) == want
    assert {r.record_id for r in ledger.commands().collect()} == set(records[1:])
    more = spark.createDataFrame([(r, "x", middle - 10, True, "{}") for r in records], FILL)
    for _ in range(2):
        ledger.replay(more, 2, layout=layout)
    want += plain(all_letters, {r: middle - 10 for r in records[1:]})
    assert view(ledger.settled()) == sorted(want, key=str) and ledger.open().count() == 0
    assert ledger.replay(more, 3).count() == 0
    seqs = [(r.record_id, r.seq) for r in ledger.settled().filter("seq IS NOT NULL").collect()]
    assert len(seqs) == len(set(seqs)) == len(all_letters)
    # Another process goes on with the same folder.
    assert deadletters.Ledger(spark, f"{tmp_path}/ledger", SCHEMA).open().count() == 0


def test_failed_fills_make_dead_letters_too(spark):
    decided = gaps.decide(frame(spark, rand_rows("failed", 600, hot=False)), "strict")
    rows = deadletters.dead_letters(decided).collect()
    causes = {(r.record_id, r.seq) for r in decided.filter("decision = 'fill_error'").collect()}
    assert rows and all((r.record_id, r.open_seq) in causes for r in rows)


def test_dead_letters_of_a_stream(spark, tmp_path):
    rows = rand_rows("letters", 300)
    written = deliver(frame(spark, rows), ["seq"], f"{tmp_path}/in", f"{tmp_path}/cp", f"{tmp_path}/out",
                      lambda s: engine.gap_stream(s, "strict", timeout_ms=60, max_buffer=3), n=2)
    ledger = deadletters.Ledger(spark, f"{tmp_path}/ledger", SCHEMA)
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(written.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/out")
        deadletters.keep_stream(ledger, stream, f"{tmp_path}/keep").awaitTermination()
    # The stream names the failed gap, or the failed fill, as the table does.
    assert sorted(map(tuple, ledger.kept().collect())) == sorted(map(tuple, letters_of(spark, rows).select(*deadletters.LETTER).collect()))
