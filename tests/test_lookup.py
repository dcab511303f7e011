"""Which image answers a command, and what belongs to a session."""

import random

from mendline.operators import lookup
from mendline.operators.ordered import Layout
from mendline.sources import io

COMMAND = "record_id string, entity_type string, event_id string, seq bigint, gap_at bigint, asked_at bigint"
IMAGE = "record_id string, entity_type string, image string, taken bigint"


def answers(df):
    return {r.seq: (r.cutoff, r.err.split(":")[0]) for r in df.collect()}


def test_a_broken_newest_image_is_a_failed_fill(spark):
    commands = spark.createDataFrame([(str(i), "E", "e", i, 0, 0) for i in range(4)], COMMAND)
    fine = '{"lastModifiedEpochMs":5}'
    images = spark.createDataFrame([("0", "E", fine, 1), ("0", "E", '{"lastMod', 2), ("1", "E", '{"lastMod', 1), ("1", "E", fine, 2),
                                    ("2", "E", fine, 1), ("2", "E", '{"lastModifiedEpochMs":"n/a"}', 2)], IMAGE)
    assert answers(lookup.fill_lookup(commands, images)) == {
        0: (-1, "bad image"), 1: (5, ""), 2: (-1, "bad modification time"), 3: (-1, "not found")}
    # Without a time of its own the latest usable version counts.
    assert answers(lookup.fill_lookup(commands, images.drop("taken"))) == {0: (5, ""), 1: (5, ""), 2: (5, ""), 3: (-1, "not found")}


def test_image_as_of_the_command(spark):
    pick = random.Random(3)
    images = [(str(pick.choice((0, 0, 0, 1, 2))), "E", pick.choice(('{"x', '{"lastModifiedEpochMs":%d}' % (t - pick.randint(0, 30)))), t)
              for t in pick.sample(range(200), 40)]
    commands = [(str(pick.choice((0, 0, 0, 1, 2, 3))), "E", f"e{i}", i, at - pick.randint(0, 40), at) for i, at in enumerate(pick.choices(range(200), k=60))]
    want = {}
    for rec, _, _, seq, gap, asked in commands:
        known = [(taken, image) for r, _, image, taken in images if r == rec and taken <= asked]
        cutoff = int(max(known)[1].split(":")[1][:-1]) if known and ":" in max(known)[1] else None
        want[seq] = ((-1, "not found") if not known else (-1, "bad image") if cutoff is None else
                     (cutoff, "") if cutoff >= gap else (-1, "stale image"))
    for hot_rows in (1_000_000, 5):
        got = lookup.fill_lookup_as_of(spark.createDataFrame(commands, COMMAND), spark.createDataFrame(images, IMAGE),
                                       layout=Layout(keys=("entity_type", "record_id"), hot_rows=hot_rows))
        assert answers(got) == want
    assert {e for _, e in want.values()} == {"", "not found", "bad image", "stale image"}


def test_release_leaves_other_sessions_alone(spark):
    other = spark.newSession()
    mine, theirs = io.stored(spark.range(3)), io.stored(other.range(4))
    assert io.release(other) == 1 and mine.count() == 3
    assert theirs is not None and io.release(other) == 0


def test_a_folder_of_one_machine_is_not_shared():
    assert io.is_shared("file:/tmp/x", "local[8]") and io.is_shared("hdfs://a/b", "yarn")
    assert not io.is_shared("/tmp/x", "yarn") and not io.is_shared("file:/tmp/x", "local-cluster[2,1,1024]")
