"""Records without gap markers and fills go past the windows, with the same result."""

import pytest
from pyspark.sql import functions as F

from mendline.operators import gaps, quiet
from mendline.operators.ordered import Layout
from rows import frame, rand_rows, row


def mixed(seed):
    """Ten records with control rows, among them a hot one, and 300 without, one of them as large as all others."""
    rows = rand_rows(seed, 300, records=10)
    rows += [row("still" if i % 2 else f"q{i % 300}", 1_000 + i, "N", 5_000 + i) for i in range(900)]
    return rows + [row(None, 5_000, "N", 1), row(None, 5_001, "N", 2)]


def as_rows(df, names=None):
    return sorted(map(str, df.select(*(names or sorted(df.columns))).collect()))


@pytest.mark.parametrize("words", [1, 3, quiet.WORDS])
@pytest.mark.parametrize("mode", ["compat", "strict"])
def test_same_result_whatever_the_filter(spark, mode, words):
    rows, layout = frame(spark, mixed(mode)), Layout(hot_rows=20)
    plain = gaps.decide(rows, mode, layout)
    got = quiet.decide(rows, mode, layout, words=words)
    assert as_rows(got) == as_rows(plain, sorted(got.columns))
    assert as_rows(quiet.cdc_output(rows, mode, layout, words=words)) == as_rows(gaps.cdc_output(plain, mode, layout))
    # What follows goes on from the result as from that of the windows.
    assert as_rows(gaps.replayed(got, mode, layout).drop("part")) == as_rows(gaps.replayed(plain, mode, layout).drop("part"))


def test_quiet_rows_are_not_shuffled(spark):
    rows = frame(spark, mixed("shuffle"))
    still, rest = quiet.split(rows)
    assert still.count() + rest.count() == rows.count()
    busy = {r.record_id for r in rows.filter("kind <> 'N'").select("record_id").distinct().collect()}
    assert {r.record_id for r in rest.select("record_id").distinct().collect()} == busy
    assert not {r.record_id for r in still.select("record_id").distinct().collect()} & busy
    plan = still._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_no_control_row_no_row_and_no_key(spark):
    only = frame(spark, [row("a", 1, "N", 1), row("b", 2, "N", 2)])
    assert {r.decision for r in quiet.decide(only).collect()} == {"forwarded"}
    assert quiet.cdc_output(only).count() == 2
    assert quiet.decide(only.limit(0)).collect() == []
    with pytest.raises(ValueError):
        quiet.control_filter(only, ())


def test_filter_is_bounded_and_seldom_wrong(spark):
    keys = spark.range(40_000).select(F.col("id").alias("record_id"), F.when(F.col("id") < 20_000, "G").otherwise("N").alias("kind"))
    assert quiet.control_filter(keys, words=512).count() == 512
    rest = quiet.split(keys, words=1 << 12)[1]
    assert rest.filter("kind = 'G'").count() == 20_000
    assert rest.filter("kind = 'N'").count() < 1_000  # about five keys a word
