import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendline.llm import crosspolytope, queries

KIND = "vec_id long, embedding array<float>"


def plain_nearest(rows, is_query, k):
    """Brute force, after the docstring: an id names the row with its least vector; zeros and faulty vectors take no part."""
    whole = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            whole[i] = min(whole.get(i, v), v)
    dim = max(map(len, whole.values()), default=0)
    whole = {i: np.pad(np.array(v, float), (0, dim - len(v))) for i, v in whole.items()}
    out = {}
    for q in filter(is_query, whole):
        best = sorted((-float(np.cumsum(whole[q] * v)[-1]), i) for i, v in whole.items() if i != q)[:k]
        out[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect()):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def test_hadamard_keeps_lengths_and_products():
    pick = np.random.default_rng(1)
    x = pick.normal(size=(5, 16))
    matrix = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)]) / 4
    assert np.allclose(crosspolytope.hadamard(x), x @ matrix.T)


@pytest.mark.parametrize("turns", [1, 2, 3])
def test_probes_come_in_order_of_their_gaps(turns):
    index = crosspolytope.Index(dim=4, tables=2, turns=turns)
    rows = np.random.default_rng(2).normal(size=(3, 4))
    got = index.probes(rows, 40)
    assert (got[:, :, 0] == index.keys(rows)).all()
    for table, turned in index.rotated(rows):
        for r in range(len(rows)):
            gap = np.square(turned[r].max(axis=1, keepdims=True) - turned[r])
            cost = {int(index.key(table, np.array(axes))): sum(gap[t, a] for t, a in enumerate(axes))
                    for axes in itertools.product(range(8), repeat=turns)}
            best = sorted(cost.values())[:40]
            assert np.allclose([cost[int(b)] for b in got[r, table]], best) and len(set(got[r, table].tolist())) == len(best)


def odd_rows(seed, spread):
    pick = np.random.default_rng(seed)
    vecs = (pick.normal(0, 1, (400, 8)) * np.exp(pick.normal(0, spread, 400))[:, None]).astype(np.float32)
    vecs[100:220] = vecs[7]  # a common vector, of queries too
    vecs[50] = vecs[100] * 3
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return rows + [(400, None), (401, []), (402, [1.0, None]), (403, [float("nan")] * 8), (404, [float("inf")] * 8), (410, [0.0] * 8),
                   (420, [2.0, 1.0]), (None, [1.0] * 8), (30, [0.5] * 8), rows[60]]


@pytest.mark.parametrize("seed,spread,turns", [(1, 0.0, 1), (2, 1.5, 2)])
def test_all_is_found_where_the_target_asks_for_all(spark, monkeypatch, seed, spread, turns):
    """The sample holds every query and the target is one, so that the result is that of brute force; small tiles and blocks."""
    for name, value in (("TILE", 20), ("BLOCK", 6), ("GROUP", 2), ("BUCKET", 400 if turns == 1 else 20)):
        monkeypatch.setattr(crosspolytope, name, value)
    rows = odd_rows(seed, spread)
    df = spark.createDataFrame([(*r, "x") for r in rows], KIND + ", Bucket string")
    got = found(crosspolytope.nearest(df, F.col("vec_id") % 10 == 0, k=5, target=1.0))
    assert got == plain_nearest(rows, lambda i: i % 10 == 0, 5)


def test_few_and_no_rows(spark):
    make = lambda rows: spark.createDataFrame(rows, KIND)
    assert crosspolytope.nearest(make([]), F.col("vec_id") % 20 == 0).collect() == []
    assert crosspolytope.nearest(make([(0, [1.0])]), F.col("vec_id") % 20 == 0).collect() == []
    few = make([(0, [1.0, 0.0]), (1, [0.5, 0.0]), (2, [0.5, 0.0]), (3, [-1.0, 0.0])])
    assert found(crosspolytope.nearest(few, F.col("vec_id") == 0, target=1.0)) == {0: [(1, 1, 0.5), (2, 2, 0.5), (3, 3, -1.0)]}


def test_recall_on_the_given_table(spark, sf):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows, lambda i: i % 20 == 0, 20)
    got = found(queries.op11_cross_polytope(spark, sf))
    hits = sum(len({i for _, i, _ in got[q]} & {i for _, i, _ in best}) for q, best in want.items())
    assert hits >= 0.9 * sum(map(len, want.values())) and all(len(x) == 20 for x in got.values())
    scores = {(q, i): s for q in want for _, i, s in plain_nearest(rows, lambda i: i == q, len(rows))[q]}
    assert all(scores[q, i] == s for q, x in got.items() for _, i, s in x)
