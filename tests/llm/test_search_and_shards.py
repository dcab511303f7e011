import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendline.llm import shards, topk


def plain_top(rows, is_query, k):
    whole = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    dim = max(map(len, whole.values()), default=0)
    whole = {i: np.pad(v, (0, dim - len(v))) for i, v in whole.items()}
    out = []
    for q in filter(is_query, whole):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("seed,spread", [(1, 0.0), (2, 1.5), (3, 3.0)])
def test_top_k_against_brute_force(spark, monkeypatch, seed, spread):
    monkeypatch.setattr(topk, "TILE", 40)
    monkeypatch.setattr(topk, "BLOCK", 7)
    pick = np.random.default_rng(seed)
    lengths = np.exp(pick.normal(0, spread, 400))
    vecs = (pick.normal(0, 1, (400, 8)) * lengths[:, None]).astype(np.float32)
    vecs[100:220] = vecs[7]  # a common vector
    vecs[50] = vecs[100] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)] + [
        (400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (410, [0.0] * 8), (420, [2.0, 1.0]), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    assert got == plain_top([(i, None if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 10 == 0, 5)


def test_top_k_few_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert topk.top_k(make([]), F.col("vec_id") % 50 == 0).collect() == []
    assert topk.top_k(make([(0, [1.0])]), F.col("vec_id") % 50 == 0).collect() == []
    assert sorted(map(tuple, topk.top_k(make([(0, [1.0]), (1, [-1.0]), (2, [-1.0])]), F.col("vec_id") == 0).collect())) == [
        (0, 1, 1, -65536), (0, 2, 2, -65536)]


def test_top_k_rows_that_share_an_identifier(spark, monkeypatch):
    """All of them are searched; the answers are the best of all pairs, as the registered SQL ranks them."""
    monkeypatch.setattr(topk, "TILE", 16)
    monkeypatch.setattr(topk, "BLOCK", 4)
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    few = make([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0])])
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") == 0, k=2).collect())) == [(0, 1, 2, 131072), (0, 2, 1, 65536)]
    pick = np.random.default_rng(4)
    ids = np.where(pick.random(300) < 0.33, 0, pick.integers(0, 40, 300)).tolist()  # one identifier holds a third
    vecs = pick.integers(-4, 5, (300, 3)).tolist()
    vecs[:60] = [vecs[0]] * 60
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, vecs)]
    whole = [(i, 256 * np.array(v, int)) for i, v in zip(ids, vecs)]
    want = []
    for q in {i for i in ids if i % 10 == 0}:
        best = sorted((-int(a @ b), j) for i, a in whole if i == q for j, b in whole if j != q)[:5]
        want += [(q, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert sorted(map(tuple, topk.top_k(make(rows), F.col("vec_id") % 10 == 0).collect())) == sorted(want)


def test_top_k_sends_no_pair_that_all_its_queries_skip(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", 32)
    monkeypatch.setattr(topk, "BLOCK", 8)
    sent, shipped = [], topk._shipped

    def spy(queries, tiles, buckets):
        pairs = shipped(queries, tiles, buckets)
        sent.append((pairs, queries, tiles))
        return pairs

    monkeypatch.setattr(topk, "_shipped", spy)
    pick = np.random.default_rng(8)
    vecs = pick.normal(0, 1, (4000, 8)) * np.exp(pick.normal(0, 1.5, 4000))[:, None]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0).collect()))
    assert got == plain_top(rows, lambda i: i % 50 == 0, 5)
    pairs, queries, tiles = sent[0]
    met = (pairs.join(queries.select("band", "block", "bounds", *topk._side(queries, "q")), ["band", "block"])
           .join(tiles.select("bucket", "tile", "longest"), ["bucket", "tile"]).collect())
    for p in met:
        _, q = topk.matrix(p.asDict(), "q")
        bound, length = np.frombuffer(p.bounds, np.float64), np.sqrt(np.square(q.astype(float)).sum(axis=1))
        assert (bound <= length * p.longest * (1 + 1e-6)).any()
    assert 4 * len(met) < queries.count() * tiles.count()


def test_pruned_vectors_cannot_win():
    pick = np.random.default_rng(5)
    units = pick.normal(0, 1, (2000, 16))
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    q = pick.normal(0, 1, 16)
    cosines = units @ q / np.linalg.norm(q)
    for threshold in (0.3, 0.6, 0.9):
        kept = topk.feasible(q, units, threshold)
        assert not (cosines >= threshold)[~kept].any() and (threshold < 0.5 or not kept.all())


def test_best_fit_decreasing():
    items = [(5, 0), (7, 1), (5, 2), (2, 3), (4, 4), (2, 5), (5, 6)]
    bins = defaultdict(int)
    for item, b in shards.best_fit(items, 10):
        bins[b] += dict((i, s) for s, i in items)[item]
    assert sorted(bins.values()) == [2, 9, 9, 10]
    # The tightest bin that holds an item: 3 goes to the rest of 3, not of 4.
    assert dict(shards.best_fit([(6, 0), (7, 1), (3, 2)], 10))[2] == dict(shards.best_fit([(6, 0), (7, 1)], 10))[1]
    pick = random.Random(1)
    items = [(pick.randint(1, 1000), i) for i in range(500)]
    total = defaultdict(int)
    for item, b in shards.pack_into(items, 8):
        total[b] += items[item][0]
    assert len(total) == 8 and max(total.values()) <= -(-sum(s for s, _ in items) // 8) + 2
    assert shards.pack_into([], 8) == []


def check_shards(rows, texts):
    slots, where = defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and 0 <= r.shard < 8
        slots[r.shard].append(r.slot)
        where[raw].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return where


def test_shards_keep_groups_and_sizes(docs):
    pick = random.Random(2)
    rows = [(i, f"text {i % 700} " + "x" * (i % 700 * 7 % 400)) for i in range(1500)] + [(5000, None), (5001, "")]
    df = docs(rows)
    got = shards.shard(df, 8).collect()
    where = check_shards(got, dict(rows))
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert sorted(map(tuple, got)) == sorted(map(tuple, shards.shard(df.repartition(7), 8).collect()))


def test_oversized_group_is_dealt_out(docs):
    rows = [(i, "the same long text " * 5) for i in range(1000)] + [(2000 + i, f"other {i} " * 9) for i in range(1000)]
    got = shards.shard(docs(rows), 8).collect()
    check_shards(got, dict(rows))
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 8 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_shards_odd_rows(docs):
    got = shards.shard(docs(), 8).collect()
    assert len(got) == docs().count() and shards.shard(docs([]), 8).count() == 0
