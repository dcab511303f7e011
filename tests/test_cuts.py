"""Hot keys are cut evenly, whatever their order columns look like."""

import random

import pytest
from pyspark.sql import functions as F

from mendline.operators.ordered import PART, Layout, cut_hot_keys, number_rows, scan

SCHEMA = "record_id string, arrived long, rank int, seq long"


def cases(name):
    n = 4_000
    early = random.Random(1).sample(range(n), n)
    return {
        "future": [("hot", 10**12 if i >= 5 else i, 0, i) for i in range(n)],  # a running maximum behind one row of the future
        "instant": [("hot", 7, i % 2, i) for i in range(n)],
        "bursts": [("hot", 100 * (i // 1_900), 0, i) for i in range(n)],
        "nulls": [("hot", None, None, i) for i in range(n)],
        "shuffled": [("hot", early[i] ** 3, 0, i) for i in range(n)],
    }[name] + [("cold", i, 0, i) for i in range(50)]


@pytest.mark.parametrize("name", ["future", "instant", "bursts", "nulls", "shuffled"])
def test_stretches_of_like_size_in_order(spark, name):
    layout = Layout(order=("arrived", "rank", "seq"), hot_rows=100)
    rows = cut_hot_keys(spark.createDataFrame(cases(name), SCHEMA), layout)
    assert rows.filter("record_id = 'cold'").filter(F.col(PART).isNotNull()).count() == 0
    hot = rows.filter("record_id = 'hot'")
    sizes = [r["count"] for r in hot.groupBy(PART).count().collect()]
    assert sum(sizes) == 4_000 and len(sizes) >= 38 and max(sizes) < 250
    none_first = lambda v: (v is not None, v or 0)
    placed = sorted(hot.collect(), key=lambda r: (none_first(r.arrived), none_first(r["rank"]), r.seq))
    assert [r[PART] for r in placed] == sorted(r[PART] for r in placed)


def test_one_sequence_and_equal_places(spark):
    """Without keys, and with rows that are equal in the whole order, which stay together."""
    layout = Layout(keys=(), order=("arrived", "seq"), hot_rows=30)
    rows = spark.createDataFrame([("x", i // 100, 0, i) for i in range(1_000)], SCHEMA)
    assert cut_hot_keys(rows, layout).select(PART).distinct().count() >= 20
    seen = scan(rows, layout, before={"last": F.when(F.col("seq") % 70 == 0, F.col("seq"))}, count_before={"n": F.lit(True)})
    assert {r.seq: (r.last, r.n) for r in seen.collect()} == {i: ((i - 1) // 70 * 70 if i else None, i) for i in range(1_000)}
    numbered = number_rows(rows.withColumn("run", F.lit(1)), "pos", "run", layout, newest_first=True)
    assert {r.seq: r.pos for r in numbered.collect()} == {i: 1_000 - i for i in range(1_000)}
    same = spark.createDataFrame([("x", 1, 0, i // 50) for i in range(200)], SCHEMA)
    assert cut_hot_keys(same, layout).groupBy("seq").agg(F.count_distinct(PART).alias("n")).filter("n > 1").count() == 0
